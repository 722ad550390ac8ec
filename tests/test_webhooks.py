"""Webhook dispatch and replay on hand-made deliveries."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from quietcount.operators import revenue, webhooks

START = datetime(2024, 6, 1)
LOG = "site_id long, payload string, received_at timestamp, processed_at timestamp"


def event(number, type_, object_, hours=0, processed=True, site=1):
    at = START + timedelta(hours=hours)
    body = {"id": f"evt_{number}", "type": type_, "created": int((at - datetime(1970, 1, 1)).total_seconds()), "data": {"object": object_}}
    return (site, json.dumps(body), at, at if processed else None)


def subscription(cents, status="active", customer="cus_1", **more):
    price = {"unit_amount": cents, "recurring": {"interval": "month"}}
    return {"id": "sub_1", "customer": customer, "status": status, "currency": "usd", "items": {"data": [{"price": price}]}, **more}


def run(spark, rows):
    sites = spark.createDataFrame([(1, "USD"), (2, "EUR")], "site_id long, base_currency string")
    out = webhooks.replayed(webhooks.dispatched(webhooks.deliveries(spark.createDataFrame(rows, LOG)), sites))
    return out, {r.event_id: r for r in out.collect()}


def test_every_type_has_its_handler(spark):
    rows = [
        event(1, "customer.created", {"id": "cus_1"}), event(2, "checkout.session.completed", {"id": "cs_1", "customer": {"id": "cus_2"}}),
        event(3, "customer.subscription.deleted", subscription(900, "canceled")), event(4, "invoice.paid", {"id": "in_1", "customer": "cus_1", "amount_paid": 500, "subscription": "sub_1", "currency": "gbp"}),
        event(5, "invoice.paid", {"id": "in_2", "customer": "cus_1", "amount_paid": 700}, site=2), event(6, "invoice.paid", {"id": "in_3", "customer": "cus_1", "amount_paid": 0}),
        event(7, "charge.refunded", {"id": "ch_1", "customer": "cus_1", "amount_refunded": 300}), event(8, "charge.dispute.created", {"id": "dp_1", "customer": "cus_1", "amount": 250}),
        event(9, "invoice.payment_failed", {"id": "in_9"}), event(10, "something.else", {"id": "x"}), event(11, "invoice.paid", {"id": "in_4", "customer": "", "amount_paid": 5}),
        event(12, "invoice.paid", {"id": "in_5", "customer": "cus_1", "amount_paid": 900, "parent": {"subscription_details": {"subscription": "sub_7"}}}), (1, "no json", START, None), (1, None, START, None),
    ]
    out, got = run(spark, rows)
    assert {k: r.outcome for k, r in got.items() if k.startswith("evt")} == {
        "evt_1": "applied", "evt_2": "applied", "evt_3": "applied", "evt_4": "applied", "evt_5": "applied", "evt_6": "zero", "evt_7": "applied", "evt_8": "applied", "evt_9": "noted",
        "evt_10": "ignored", "evt_11": "no_customer", "evt_12": "applied",
    }
    assert sorted(r.outcome for k, r in got.items() if k.startswith("malformed")) == ["malformed"] * 2
    assert got["evt_2"].processor_id == "cus_2" and got["evt_3"].mrr_cents == 900
    booked = sorted((r.kind, r.amount_cents, r.currency) for r in webhooks.cash(out).collect())
    assert booked == [("dispute", -250, "USD"), ("one_time", 700, "EUR"), ("payment", 500, "GBP"), ("payment", 900, "USD"), ("refund", -300, "USD")]


def test_failed_deliveries_follow_in_event_order(spark):
    rows = [
        event(1, "customer.subscription.created", subscription(4000), 0), event(4, "customer.subscription.deleted", subscription(9000, "canceled"), 3, processed=False),
        event(3, "customer.subscription.updated", subscription(9000), 2, processed=False), event(2, "customer.subscription.updated", subscription(1000), 1, processed=False),
    ]
    out, got = run(spark, rows)
    assert all(r.outcome == "applied" for r in got.values())
    made = revenue.movements(webhooks.changes(out)).orderBy("occurred_at").collect()
    assert [(r.kind, r.amount_cents) for r in made] == [("new", 4000), ("contraction", -3000), ("expansion", 8000), ("churn", -9000)]
    report = webhooks.sweep_report(out).collect()
    assert [tuple(r) for r in report] == [(1, 3, 3, 0)]


def test_replay_that_repeats_changes_nothing(spark):
    first = event(1, "customer.subscription.created", subscription(4000), 0, processed=False)
    late = event(2, "customer.subscription.updated", subscription(100), 5)
    paid = event(3, "invoice.paid", {"id": "in_1", "customer": "cus_1", "amount_paid": 500, "subscription": "sub_1"}, 1, processed=False)
    out, got = run(spark, [first, late, paid])
    assert (got["evt_1"].outcome, got["evt_3"].outcome) == ("stale", "applied")  # a newer state was applied already
    again = [first, late, paid, paid, event(3, "invoice.paid", {"id": "in_1", "customer": "cus_1", "amount_paid": 500, "subscription": "sub_1"}, 1), event(9, "invoice.paid", {"id": "in_1", "customer": "cus_1", "amount_paid": 500, "subscription": "sub_1"}, 2)]
    more, got = run(spark, again)
    assert sorted(map(tuple, webhooks.cash(more).collect())) == sorted(map(tuple, webhooks.cash(out).collect()))
    assert got["evt_9"].outcome == "duplicate" and got["evt_3"].n_deliveries == 3 and not got["evt_3"].attempted
    assert run(spark, [])[1] == {}
