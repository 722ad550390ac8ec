"""Behaviour of the analytics operators on hand-made rows."""

from __future__ import annotations

import hashlib
import hmac
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quietcount.functions import filters, hosts, identity, paths
from quietcount.functions.matchers import Matcher
from quietcount.functions.period import site_bounds
from quietcount.functions.suppression import suppress
from quietcount.operators import goals, ingest, lifecycle, metering, reports, revenue, rollups, sequences
from quietcount.sources import requests_adapter, tables

START = datetime(2024, 6, 15, 10)


def events(spark, rows):
    """rows: (visitor, minutes after START, name or path, {more columns})"""
    out = []
    for n, (who, minute, what, *more) in enumerate(rows):
        page = what.startswith("/")
        row = {
            "event_id": n, "site_id": 1, "k": 0, "timezone": "Etc/UTC", "visitor_hash": who, "session_hash": who, "is_entry": False, "occurred_at": START + timedelta(minutes=minute),
            "event_name": "pageview" if page else what, "path": what if page else "/", "referrer_source": "Direct", "country_code": "DE", "browser": "Firefox", "revenue_cents": None, "currency": None, "props": None,
        } | (more[0] if more else {})
        out.append(tuple(row.values()))
        names = list(row)
    types = "event_id long, site_id long, k long, timezone string, visitor_hash string, session_hash string, is_entry boolean, occurred_at timestamp, event_name string, path string, referrer_source string, country_code string, browser string, revenue_cents long, currency string, props map<string,string>"
    df = spark.createDataFrame(out, types)
    assert df.columns == names
    return df


P, E = (lambda v: (Matcher("pageview", "exact", v),)), (lambda v: (Matcher("event", "exact", v),))
STEPS = (P("/"), P("/pricing"), E("Signup"))


@pytest.mark.parametrize(
    "rows,window,want",
    [
        ([("a", 0, "/"), ("a", 1, "/pricing"), ("a", 2, "Signup")], 3_600, [1, 1, 1]),
        ([("a", 0, "/"), ("a", 1, "/pricing"), ("a", 2, "Signup"), ("b", 0, "/"), ("c", 3, "/")], 3_600, [3, 1, 1]),
        ([("a", 0, "/pricing"), ("a", 1, "/"), ("a", 2, "/pricing"), ("a", 3, "Signup")], 3_600, [1, 1, 1]),
        ([("a", 0, "/"), ("a", 1, "Signup"), ("a", 2, "/pricing")], 3_600, [1, 1, 0]),
        ([("a", 0, "/"), ("a", 120, "/pricing"), ("a", 121, "Signup")], 3_600, [1, 0, 0]),
        ([("a", 0, "/"), ("a", 50, "/pricing"), ("a", 100, "Signup")], 3_600, [1, 1, 1]),
        ([("a", 0, "/"), ("a", 0, "/pricing"), ("a", 0, "Signup")], 60, [1, 1, 1]),
    ],
)
def test_funnel_fold_and_joins_agree(spark, rows, window, want):
    ev, funnel = events(spark, rows), sequences.Funnel(1, STEPS, window)
    for form in (sequences.funnel_counts, sequences.funnel_counts_by_joins):
        got = {r.step: r.visitors for r in form(ev, ev, funnel).collect()}
        assert [got[i] for i in range(3)] == want
    report = {r.step: r for r in sequences.funnel_report(sequences.funnel_counts(ev, ev, funnel)).collect()}
    assert report[0].conversion == 100.0 and report[2].overall == round(100 * want[2] / want[0], 1)


def test_funnel_window_from_the_first_step(spark):
    ev = events(spark, [("a", 0, "/"), ("a", 50, "/pricing"), ("a", 100, "Signup")])
    got = {r.step: r.visitors for r in sequences.funnel_counts(ev, ev, sequences.Funnel(1, STEPS, 3_600), window_from="first").collect()}
    assert [got[i] for i in range(3)] == [1, 1, 0]
    assert not sequences.Funnel(1, STEPS[:1]).valid and sequences.Funnel(1, STEPS, 90_000).exceeds_identity


def test_flow_collapses_repeats_and_counts_leavers(spark):
    ev = events(spark, [("a", 0, "/"), ("a", 1, "/"), ("a", 2, "/x"), ("b", 0, "/"), ("c", 0, "/x"), ("c", 1, "/"), ("c", 2, "/y"), ("c", 3, "/"), ("c", 4, "/x")])
    got = {(r.value, r.visitors, r.total) for r in sequences.flow(sequences.steps(ev), [("pageview", "/")]).collect()}
    assert got == {("/x", 1, 3), (None, 1, 3), ("/y", 1, 3)}
    back = {(r.value, r.visitors) for r in sequences.flow(sequences.steps(ev), [("pageview", "/")], "backward").collect()}
    assert back == {(None, 2), ("/x", 1)}


def test_event_filter_counts_matching_rows(spark):
    ev = events(spark, [("a", 0, "/"), ("a", 1, "Signup"), ("a", 7, "Signup"), ("b", 0, "/p"), ("b", 0.5, "Signup"), ("c", 0, "/")]).withColumn("window", F.lit("cur"))
    frame = spark.sql("SELECT 1L AS site_id")
    row = reports.summary(ev, frame, {"event": "Signup"}).where("window = 'cur'").first()
    assert (row.volume, row.visitors, row.sessions, row.bounce_rate) == (3, 2, 2, 100.0)
    assert row.avg_duration == 225


def test_suppression_never_leaves_one_row_to_be_told(spark):
    rows = spark.createDataFrame([("a", 10, 3), ("b", 8, 9), ("c", 2, 1)], "value string, visitors long, volume long").withColumns({"k": F.lit(5), "p": F.lit(1)})
    got = suppress(rows, ["p"], [F.col("volume").desc(), F.col("value").asc()]).collect()
    assert [r.value for r in got if not r.withheld] == ["a"] and {(r.withheld_rows, r.withheld_visitors) for r in got} == {(2, 10)}


def test_batch_panels_equal_single_ones(spark):
    ev = events(spark, [(f"v{i % 7}", i, f"/{i % 3}", {"country_code": [None, "DE", "US"][i % 3], "is_entry": i % 4 == 0}) for i in range(60)])
    batch = reports.panels(ev, ["page", "country", "entry_page"])
    for d in ("page", "country", "entry_page"):
        assert sorted(map(str, batch.where(F.col("dimension") == d).collect())) == sorted(map(str, reports.breakdown(ev, d).collect()))


def test_filters_are_an_allow_list():
    kept = filters.cleaned({"page": "/", "nothing": 1, "props:plan": "pro", "props:" + "x" * 61: 1, "country": ["DE"], "source": ""})
    assert kept == {"page": "/", "props:plan": "pro"}


def test_period_bounds_follow_the_zone(spark):
    sites = spark.sql("SELECT * FROM VALUES (1L, 'Etc/UTC'), (2L, 'Europe/Berlin') AS t(site_id, timezone)")
    got = {r.site_id: r for r in site_bounds(sites, "7d", datetime(2024, 4, 2, 23, 30)).collect()}
    assert got[1].from_ts == datetime(2024, 3, 27) and got[1].to_ts == datetime(2024, 4, 3) and got[1].unit == "day"
    assert got[2].from_ts == datetime(2024, 3, 27, 23) and got[2].to_ts == datetime(2024, 4, 3, 22)
    swapped = site_bounds(sites, "custom", START, date(2024, 5, 2), date(2020, 5, 1)).first()
    assert swapped.from_ts == datetime(2020, 5, 1) and (swapped.to_ts - swapped.from_ts).days == 731 and swapped.unit == "month"
    assert site_bounds(sites, "bogus", START).first().from_ts == datetime(2024, 5, 17)


@pytest.mark.parametrize(
    "path,want",
    [
        ("/", "/"), ("", "/"), ("/a/", "/a"), ("/user/jane@x.org/edit", "/user/:email/edit"), ("/player/51", "/player/:id"), ("/2026/07/15/x", "/2026/07/15/x"),
        ("/section/07", "/section/:id"), ("/2026/99", "/2026/:id"), ("/" + "a" * 400, "/:hash"), ("/o/550e8400-e29b-41d4-a716-446655440000", "/o/:uuid"),
        ("/t/abc123def456ghi789", "/t/:token"), ("/t/deadbeefdeadbeef", "/t/:hash"), ("/jane%40x.org", "/:email"), ("/blog/2024/5/6/7", "/blog/2024/5/6/:id"),
    ],
)
def test_scrubbed_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "path string").select(paths.scrub_path().alias("p")).first().p == want


def test_query_parameters(spark):
    q = "utm_source=a&utm_source=b+c&utm_medium=x%40y&ref=" + "z" * 30 + "&token=1&utm_term=%zz&utm_campaign="
    got = spark.createDataFrame([(q,)], "query string").select(*[c.alias(k) for k, c in paths.query_params().items()]).first()
    assert got.asDict() == {"utm_source": "b c", "utm_medium": None, "utm_campaign": None, "utm_term": None, "utm_content": None, "ref": None}


def test_route_templates_are_greedy():
    trie = paths.compile_templates(["/en/:page/edit", "/en/new"])
    assert paths.apply_templates(trie, ["", "en", "new", "edit"]) == (["", "en", "new"], 3)
    assert paths.apply_templates(trie, ["", "en", "x", "edit", "9"]) == (["", "en", ":page", "edit"], 4)
    assert paths.apply_templates(trie, ["", "fr"]) == ([""], 1)


def test_matchers():
    assert Matcher("pageview", "wildcard", "/a/*").matches("/a/b") and not Matcher("pageview", "wildcard", "/a/*").matches("/a/b/c")
    assert Matcher("pageview", "wildcard", "/a/**").matches("/a/b/c") and Matcher("pageview", "wildcard", "/a/*", "like").matches("/a/b/c")
    live = goals.convertible([goals.Goal(1, Matcher("event", "prefix", "Sign")), goals.Goal(2, Matcher("pageview", "exact", "Signup"))], {"event": "Signup"})
    assert [g.goal_id for g in live] == [1]


def test_visitor_hash_is_hmac(spark):
    table = identity.salts(spark.range(7, 8).select(F.col("id").alias("site_id")), date(2024, 6, 15), 1, "s")
    key = hashlib.sha256(b"s:7:2024-06-15").digest()
    want = hmac.new(key, b"7\x001.2.3.4\x00agent \xc3\xa9", hashlib.sha256).hexdigest()[:32]
    row = table.withColumns({"ip": F.lit("1.2.3.4"), "user_agent": F.lit("agent é")}).select(identity.visitor_hash().alias("h")).first()
    assert row.h == want


def test_addresses_and_agents(spark):
    assert identity.normal_address("2001:db8:1:2:3:4:5:6") == "2001:db8:1:2::" and identity.normal_address("1.2.3.4") == "1.2.3.4" and identity.normal_address("x") == "x"
    rows = spark.createDataFrame([(a,) for a in (*requests_adapter.AGENTS, None, "")], "user_agent string")
    got = [tuple(r) for r in rows.select(*[c.alias(k) for k, c in identity.agent_profile().items()]).collect()]
    assert got[0] == ("Firefox", "128", "GNU/Linux", None, "desktop", False) and got[1][:4] == ("Chrome", "126", "Windows", "10")
    assert got[2] == ("Safari", "17", "iOS", "17", "mobile", False) and got[3][2:5] == ("Android", "14", "mobile")
    assert [g[5] for g in got[4:]] == [True, True, True]


def test_contract_and_privacy(spark):
    import json

    base = {"s": "x" * 16, "u": "https://a.org/", "w": "12", "v": "5", "c": "usd"}
    bad = {"s": base | {"s": "x"}, "u": base | {"u": "ftp://a"}, "n": base | {"n": "x" * 121}, "w": base | {"w": "20001"}, "p": base | {"p": {str(i): "v" for i in range(25)}},
           "c": base | {"c": "euro"}, "c:required": {k: v for k, v in base.items() if k != "c"}, "u:null_byte": base | {"u": "https://a.org/\u0000"}}
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in ({"ok": base, "lenient": base | {"w": "wide"}} | bad).items()], "name string, body string")
    got = {r["name"]: r.e for r in ingest.parsed(rows).withColumn("e", ingest.contract_errors()).collect()}
    assert got.pop("ok") == [] and got.pop("lenient") == [] and all(k in e for k, e in got.items())
    props = {"nested": {"k": {"n": 1}}, "list": {"k": [1, 2]}, "plain": {"k": "v", "n": 1.5, "b": True, "z": None}}
    rows = spark.createDataFrame([(k, json.dumps(base | {"p": v})) for k, v in props.items()], "name string, body string")
    got = {r["name"]: r.e for r in ingest.parsed(rows).withColumn("e", ingest.contract_errors()).collect()}
    assert got == {"nested": ["p"], "list": ["p"], "plain": []}
    flags = spark.createDataFrame([("1", None, None), (None, "1", None), (None, None, "prefetch"), (None, "0", None)], "sec_gpc string, dnt string, sec_purpose string")
    assert [r[0] for r in flags.select(ingest.privacy_drop()).collect()] == [True, True, True, False]


def test_beacon_of_a_query_string(spark):
    q = "s=tok&u=https%3A%2F%2Fa.org%2Fx%3Fy%3D1&w=10&n=Sign+up&p[plan]=pro&p%5Bplan%5D=max&p[x]=&u=https%3A%2F%2Fb.org%2F"
    rows = spark.createDataFrame([(None, q), ("{}", q), ("not json", q), ('{"s": "body"}', q), (None, None)], "body string, qs string")
    got = ingest.parsed(rows, query="qs").collect()
    for r in got[:3]:
        assert (r.s, r.u, r.n, r.w, r.v, r.p) == ("tok", "https://b.org/", "Sign up", 10, None, {"plan": "max", "x": ""})
    assert (got[3].s, got[3].u) == ("body", None) and (got[4].s, got[4].p) == (None, None)


@pytest.mark.parametrize("path,want", [("/a//", "/a"), ("/a/", "/a"), ("//", "/"), ("/", "/"), ("", "/"), ("/a//b/", "/a//b")])
def test_trailing_slashes(spark, path, want):
    assert spark.createDataFrame([(path,)], "path string").select(paths.scrub_path().alias("p")).first().p == want


def test_cleansed_text(spark):
    rows = spark.createDataFrame([("a\u0000b",), ("é" * 3_000,), ("x",), (None,)], "t string").select(ingest.cleansed(F.col("t")).alias("t"))
    assert [r.t for r in rows.collect()] == ["ab", "é" * 2_048, "x", None]


@pytest.mark.parametrize("interval,count,cents,want", [("year", 1, 48_000, 4_000), ("week", 1, 1_000, 4_333), ("day", 1, 100, 3_041), ("month", 2, 8_000, 4_000), ("year", 1, 10_000, 833), ("once", 1, 9, 0)])
def test_monthly_value(spark, interval, count, cents, want):
    rows = spark.createDataFrame([([(cents, 1, interval, count)],)], "items array<struct<unit_amount: long, quantity: long, interval: string, interval_count: int>>")
    assert rows.select(revenue.monthly_value("items").alias("m")).first().m == want


def test_movements_of_subscriptions(spark):
    def change(n, sub, status, mrr):
        return (1, 5, sub, n, START + timedelta(days=n), START + timedelta(days=n), status, mrr, "USD")

    rows = [change(1, "a", "trialing", 4000), change(2, "a", "active", 4000), change(3, "a", "active", 9000), change(4, "a", "past_due", 1000), change(5, "a", "canceled", 1000), change(6, "b", "active", 700), change(7, "b", "active", 700)]
    late = (1, 5, "a", 99, START, START + timedelta(days=9), "active", 1, "USD")
    log = spark.createDataFrame([*rows, rows[0], late], "site_id long, customer_id long, subscription_id string, event_id long, event_at timestamp, received_at timestamp, status string, mrr_cents long, currency string")
    got = [(r.kind, r.amount_cents) for r in revenue.movements(revenue.change_log(log)).orderBy("occurred_at").collect()]
    assert got == [("new", 4000), ("expansion", 5000), ("contraction", -8000), ("churn", -1000), ("reactivation", 700)]


def test_attribution_uses_the_local_day(spark):
    sites = spark.sql("SELECT 1L AS site_id, 'Europe/Berlin' AS timezone, 'EUR' AS base_currency")
    schema = "site_id long, customer_id long, attribution_source string, attribution_medium string, attribution_campaign string, identified_at timestamp, converted_at timestamp, lifetime_revenue_cents long"
    customers = spark.createDataFrame([(1, 5, "Ads", "", None, datetime(2024, 6, 15, 23, 30), None, 100)], schema)
    subs = spark.createDataFrame([(1, 5, "active", START), (1, 5, "active", START)], "site_id long, customer_id long, status string, created_at timestamp")
    money = spark.createDataFrame([(1, 5, "new", 4000, "EUR", START), (1, 5, "churn", -1000, "EUR", START), (1, 5, "new", 7, "USD", START)], "site_id long, customer_id long, kind string, amount_cents long, currency string, occurred_at timestamp")
    none = spark.createDataFrame([], "site_id long, occurred_at timestamp, visitor_hash string, utm_source string, utm_medium string, utm_campaign string, referrer_source string")
    rows = {str(r.date): r for r in revenue.attribution_rollup(none, customers, subs, revenue.normalised(money, sites), sites).collect()}
    assert rows["2024-06-16"].signups == 1 and rows["2024-06-16"].source == "Ads" and rows["2024-06-16"].medium == "(none)"
    paid = rows["2024-06-15"]
    assert (paid.new_mrr_cents, paid.churned_mrr_cents, paid.net_mrr_cents, paid.unconverted_events, paid.lifetime_revenue_cents) == (4000, 1000, 3000, 1, 100)
    compat = {str(r.date): r for r in revenue.attribution_rollup(none, customers, subs, revenue.normalised(money, sites), sites, compat=True).collect()}
    assert compat["2024-06-16"].signups == 2


def test_checkout_attribution(spark):
    rows = spark.createDataFrame([({"tst_source": "ads", "tst_medium": "", "tst_first_seen_at": "2024-01-02T03:04:05", "source": "no"},)], "metadata map<string,string>")
    got = rows.select(*revenue.checkout_attribution()).first()
    assert (got.source, got.medium, got.first_seen_at) == ("ads", None, datetime(2024, 1, 2, 3, 4, 5))


def test_event_table_round_trip_purge_and_rerun(spark, tmp_path):
    ev = events(spark, [(f"v{i}", i * 600, f"/p/{i % 3}") for i in range(12)])
    tables.write_events(ev, str(tmp_path / "events"))
    back = tables.scan_events(spark, str(tmp_path / "events"), site_ids=[1], start=START + timedelta(hours=5), end=START + timedelta(days=2))
    assert back.count() == sum(5 * 60 <= i * 600 < 2 * 1440 for i in range(12))
    assert "event_date" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    kept, gone = tables.purge(ev, 1, START, START + timedelta(days=9), "/p/1")
    assert kept.count() + sum(r.n for r in gone.collect()) == 12 and kept.where("path = '/p/1'").count() == 0
    days = rollups.visitor_days(ev).withColumn("day", F.to_date("bucket"))
    for _ in range(2):
        tables.replace_days(days, str(tmp_path / "rollup"), ["day"])
    assert spark.read.parquet(str(tmp_path / "rollup")).count() == days.count()


def test_dead_letters_retention_and_reconcile(spark):
    ev = events(spark, [("a", 0, "/"), ("b", 1440 * 3, "/x", {"country_code": "xx"}), ("c", 1440 * 6, "/y")])
    good, dead = tables.split_storable(ev, tables.row_errors())
    assert good.count() == 2 and dead.first().errors == ["country_code"]
    limits = spark.createDataFrame([(1, 9, START + timedelta(days=2))], "site_id long, account_id long, cutoff timestamp")
    kept, gone = lifecycle.enforced(ev, limits)
    assert kept.count() == 2 and gone.first().n == 1
    after = lifecycle.reconciled(rollups.visitor_days(ev), kept, START, START + timedelta(days=1), rollups.visitor_days)
    assert sorted(after.exceptAll(rollups.visitor_days(kept)).collect()) == [] and after.count() == 2
    assert rollups.drift(rollups.visitor_days(ev), rollups.visitor_days(kept)).first().side == "only_rollup"


def test_webhook_log_backfill_and_retry(spark):
    raw = spark.createDataFrame([(1, '{"id": "e1", "type": "invoice.paid", "created": 1718445600, "data": {"object": "{}"}}'), (1, '{"id": "e1", "type": "invoice.paid", "created": 1718445600}'), (1, "broken")], "site_id long, payload string")
    log = tables.webhook_log(raw)
    assert [(r.event_id, r.occurred_at) for r in log.collect()] == [("e1", datetime(2024, 6, 15, 10))]
    waiting = log.withColumn("processed_at", F.lit(None).cast("timestamp"))
    assert tables.unprocessed(waiting).count() == 1
    subs = spark.createDataFrame([("s", None, START, START - timedelta(days=1))], "subscription_id string, canceled_at timestamp, started_at timestamp, created_at timestamp")
    assert tables.backfilled_changes(subs).first().event_at == START


def test_notices_are_sent_once(spark):
    used = spark.createDataFrame([(1, "2024-06", 90), (2, "2024-06", 101), (3, "2024-06", 5)], "account_id long, month string, used long")
    limits = spark.createDataFrame([(1, 100), (2, 100), (3, None)], "account_id long, monthly_event_limit long")
    snap = metering.snapshot(used, limits, START)
    sent = spark.createDataFrame([(2, "2024-06", "exceeded")], "account_id long, month string, level string")
    assert [tuple(r) for r in metering.notices(snap, sent).collect()] == [(1, "2024-06", "approaching")]
    rows = {r.account_id: r for r in snap.collect()}
    assert (rows[2].refused, rows[1].remaining, rows[3].percent, rows[1].days_to_reset) == (1, 10, None, 16)


def test_referrers(spark):
    rows = spark.createDataFrame(
        [("https://www.google.com/", None, None), ("https://a.b.old.reddit.com/x", None, None), ("https://shop.me.org/", None, None), (None, None, None), ("https://t.co/", " News ", "CPC"), ("https://com/", None, "email")],
        "r string, utm_source string, utm_medium string",
    ).withColumn("domain", F.lit("me.org"))
    out = hosts.with_known(rows.withColumn("referrer_host", hosts.referrer_host("r", "domain"))).select("r", hosts.source().alias("s"), hosts.channel().alias("c"))
    got = {r.r: (r.s, r.c) for r in out.collect()}
    assert got["https://www.google.com/"] == ("Google", "Organic Search") and got["https://a.b.old.reddit.com/x"] == ("Reddit", "Social")
    assert got["https://shop.me.org/"] == got[None] == ("Direct", "Direct")
    assert got["https://t.co/"] == ("News", "Paid") and got["https://com/"] == ("com", "Email")
