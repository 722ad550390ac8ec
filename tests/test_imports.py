"""Historic imports on hand-made lists."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from quietcount.operators import imports, revenue

NOW = datetime(2024, 6, 15, 12)
SINCE = NOW - timedelta(days=730)
KNOWN = "site_id long, customer_id string, external_id string, processor_id string, email_hash string, " + ", ".join(f"{f} string" for f in imports.FIELDS) + ", first_seen_at timestamp, identified_at timestamp"
CHANGE = "site_id long, customer_id string, subscription_id string, event_id string, event_at timestamp, received_at timestamp, status string, mrr_cents long, currency string, canceled_at timestamp"
CASH = "site_id long, customer_id string, kind string, amount_cents long, currency string, mrr_delta_cents long, object_id string, occurred_at timestamp"


def epoch(days):
    return int((NOW - timedelta(days=days) - datetime(1970, 1, 1)).total_seconds())


@pytest.fixture(scope="module")
def frames(spark):
    class Frames:
        live = spark.createDataFrame([(1, None), (2, NOW)], "site_id long, revoked_at timestamp")
        sites = spark.createDataFrame([(1, "USD"), (2, "EUR")], "site_id long, base_currency string")

        @staticmethod
        def listed(*objects, site=1):
            rows = [(site, o if o is None or isinstance(o, str) else json.dumps(o)) for o in objects]
            return spark.createDataFrame(rows, "site_id long, payload string")

        @staticmethod
        def known(*rows):
            blank = dict.fromkeys(KNOWN.replace(",", "").split(" ")[::2])
            return spark.createDataFrame([tuple({**blank, "site_id": 1, **r}.values()) for r in rows], KNOWN)

        def customers(self, listed, known=None):
            return imports.customers(listed, known or self.known(), self.live, SINCE, NOW)

    return Frames()


def customer(number=1, email=None, days=90, **metadata):
    return {"id": f"cus_{number}", "email": email, "created": epoch(days), "metadata": {f"tst_{k}": v for k, v in metadata.items()}}


def subscription(number=1, owner="cus_1", status="active", cents=4000, **more):
    item = {"price": {"unit_amount": cents, "recurring": {"interval": "month", "interval_count": 1}}, "quantity": 1}
    return {"id": f"sub_{number}", "customer": owner, "status": status, "currency": "usd", "start_date": epoch(60), "created": epoch(60), "items": {"data": [item]}, **more}


def test_customers_are_matched_made_and_marked(frames):
    known = frames.known({"customer_id": "a", "processor_id": "cus_1", "attribution_source": "reddit"}, {"customer_id": "b", "email_hash": _hash("b@x.org")}, {"customer_id": "c", "email_hash": _hash("c@x.org")}, {"customer_id": "d", "email_hash": _hash("c@x.org")})
    listed = frames.listed(
        customer(1, source="Google", medium="cpc"), customer(2, " B@x.org"), customer(3, "c@x.org"), customer(4, "new@x.org", days=80), customer(5, "new@x.org", days=85, campaign="launch"),
        customer(6, days=800), "{broken", None, {"email": "no id"}, customer(7, source="reddit", first_seen_at="2020-01-02T00:00:00Z"), customer(7, source="reddit", first_seen_at="2020-01-02T00:00:00Z"),
    )
    got = {r.customer_id: r for r in frames.customers(listed, known).collect()}
    assert set(got) == {"a", "b", "c", "d", "cus_3", "cus_5", "cus_7"}
    assert (got["a"].attribution_source, got["a"].attribution_medium) == ("reddit", "cpc")
    assert (got["b"].processor_id, got["b"].attribution_source, got["b"].first_seen_at) == ("cus_2", revenue.PRE_INSTALL, None)
    # two share an address nobody had: the earlier makes the customer; the mark of the other gives no source to lose
    assert (got["cus_5"].attribution_campaign, got["cus_5"].attribution_source) == ("launch", revenue.PRE_INSTALL)
    assert got["cus_5"].first_seen_at == NOW - timedelta(days=85)
    assert (got["cus_7"].attribution_source, got["cus_7"].first_seen_at) == ("reddit", datetime(2020, 1, 2))
    assert got["c"].processor_id is None and got["cus_3"].email_hash == _hash("c@x.org")


def _hash(mail):
    import hashlib

    return hashlib.sha256(mail.encode()).hexdigest()


def test_repeats_change_nothing_and_later_sources_win_over_the_mark(frames):
    listed = frames.listed(customer(1), customer(2, "m@x.org"), customer(3, "m@x.org", days=70))
    once = frames.customers(listed)
    assert sorted(frames.customers(listed, once).collect()) == sorted(once.collect())
    real = frames.customers(frames.listed(customer(1, source="reddit", medium="social")), once).where("customer_id = 'cus_1'").first()
    assert (real.attribution_source, real.attribution_medium) == ("reddit", "social")
    held = frames.known({"customer_id": "cus_1", "processor_id": "cus_1", "attribution_source": "reddit"})
    assert frames.customers(listed, held).where("customer_id = 'cus_1'").first().attribution_source == "reddit"


def test_subscriptions_and_invoices(frames, spark):
    held = frames.customers(frames.listed(customer(1), customer(2)))
    listed = frames.listed(subscription(1), subscription(2, {"id": "cus_2"}, "canceled", canceled_at=epoch(10)), subscription(3, "cus_unknown"), subscription(4, None), subscription(5, currency=None, start_date=None))
    new = imports.subscription_changes(listed, held, frames.live, frames.sites, NOW)
    got = {r.subscription_id: r for r in new.collect()}
    assert set(got) == {"sub_1", "sub_2", "sub_5"}
    assert (got["sub_1"].mrr_cents, got["sub_1"].event_at, got["sub_5"].currency) == (4000, NOW - timedelta(days=60), "USD")
    assert (got["sub_2"].status, got["sub_2"].event_at) == ("canceled", NOW - timedelta(days=10))
    at = NOW - timedelta(days=30)
    known = spark.createDataFrame([(1, "cus_1", "sub_1", "e1", at, at, "active", 9000, "USD", None), (1, "cus_2", "sub_2", "e2", at, at, "active", 500, "USD", None)], CHANGE)
    both = imports.merged_changes(known, new)
    assert sorted(r.event_id for r in both.collect() if r.event_id.startswith("backfill")) == sorted([got["sub_2"].event_id, got["sub_5"].event_id])  # sub_1's is stale
    assert imports.merged_changes(both, new).count() == both.count()
    made = sorted((r.customer_id, r.kind, r.amount_cents) for r in revenue.movements(both).collect())
    # the first start converts, so that of sub_5 comes before sub_1's
    assert made == [("cus_1", "new", 4000), ("cus_1", "reactivation", 9000), ("cus_2", "churn", -4000), ("cus_2", "new", 500)]

    bill = {"customer": "cus_1", "currency": "usd", "status": "paid", "amount_paid": 4000, "created": epoch(31), "status_transitions": {"paid_at": epoch(30)}}
    bills = frames.listed(
        {**bill, "id": "in_1", "subscription": "sub_1"}, {**bill, "id": "in_2", "parent": {"subscription_details": {"subscription": "sub_1"}}}, {**bill, "id": "in_3", "status_transitions": None}, {**bill, "id": "in_4", "amount_paid": 0},
        {**bill, "id": "in_5", "status": "open"}, {**bill, "id": "in_6", "created": epoch(900)}, {**bill, "id": "in_7", "customer": "cus_9"}, {**bill, "id": "in_8", "parent": {"subscription_details": {"subscription": {"id": "sub_1"}}}},
    )
    cash = revenue.cash_events(imports.invoices(bills, held, frames.live, frames.sites, SINCE))
    booked = spark.createDataFrame([(1, "cus_1", "payment", 1, "USD", 0, "in_2", at)], CASH)
    merged = {r.object_id: r for r in imports.merged_cash(booked, cash).collect()}
    assert {k: (r.kind, r.amount_cents) for k, r in merged.items()} == {"in_1": ("payment", 4000), "in_2": ("payment", 1), "in_3": ("one_time", 4000), "in_8": ("payment", 4000)}
    assert merged["in_3"].occurred_at == NOW - timedelta(days=31)


def test_revoked_connections_and_empty_lists(frames):
    assert frames.customers(frames.listed(customer(1), site=2)).count() == 0
    empty = frames.listed()
    held = frames.customers(empty)
    assert held.count() == 0
    counts = {"customers": imports.objects(frames.listed(customer(1), customer(1)), frames.live), "invoices": imports.invoices(empty, held, frames.live, frames.sites, SINCE)}
    got = {r.site_id: r for r in imports.report(frames.live, counts, NOW).collect()}
    assert (got[1].customers, got[1].invoices, got[1].refused, got[1].backfilled_at) == (1, 0, False, NOW)
    assert (got[2].customers, got[2].refused, got[2].backfilled_at) == (0, True, None)
