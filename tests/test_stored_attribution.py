"""Attribution under the manifest, quota numbers by second, and scans that open only their days."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quietcount.functions.period import within
from quietcount.operators import metering, reports, revenue
from quietcount.sources import tables
from quietcount.sources.snapshots import Snapshots

START = datetime(2024, 3, 5)
ROLLUP = "site_id long, date date, source string, medium string, campaign string, " + ", ".join(f"{c} long" for c in [*revenue.SUMMED, "lifetime_revenue_cents"])


def rows(spark, *cells):
    """(day, source, visitors, net)"""
    blank = dict.fromkeys([*revenue.SUMMED, "lifetime_revenue_cents"], 0)
    return spark.createDataFrame([(1, date(2024, 3, d), s, "(none)", "(none)", *{**blank, "visitors": v, "net_mrr_cents": n}.values()) for d, s, v, n in cells], ROLLUP)


def test_days_are_replaced_and_emptied_in_one_swap(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    revenue.write_rollup(store, rows(spark, (1, "a", 5, 1), (2, "a", 6, 1), (3, "b", 7, 1)))
    revenue.write_rollup(store, rows(spark, (3, "b", 9, 1)), date(2024, 3, 2), date(2024, 3, 5))
    seen = lambda **k: sorted((r.date.day, r.source, r.visitors) for r in revenue.read_rollup(store, **k).collect())
    assert seen() == [(1, "a", 5), (3, "b", 9)]  # the second day has lost all that it had
    assert seen(start=date(2024, 3, 2)) == [(3, "b", 9)] and seen(end=date(2024, 3, 1)) == []
    assert store.read(revenue.ATTRIBUTION, number=1).count() == 3  # a reader of the old version sees it whole
    revenue.write_rollup(store, rows(spark), date(2024, 3, 3), date(2024, 3, 4))
    assert seen() == [(1, "a", 5)]


def test_a_report_tells_whether_it_was_cut(spark):
    held = rows(spark, *[(1 + n % 3, f"s{n:03d}", n, n) for n in range(40)], (20, "late", 1000, 1000))
    got = revenue.attribution_report(held, "2024-03-01", "2024-03-10", limit=5).orderBy("rank").collect()
    assert [r.source for r in got] == ["s039", "s038", "s037", "s036", "s035"] and all(r.truncated for r in got)
    assert {(r.total_visitors, r.total_net_mrr_cents) for r in got} == {(780, 780)}
    assert not any(r.truncated for r in revenue.attribution_report(held, "2024-03-01", "2024-03-10", limit=40).collect())
    plan = revenue.attribution_report(held, "2024-03-01", "2024-03-10", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_quota_numbers_equal_one_sort(spark):
    """Ties of a second and of an instant, two accounts, a change of month."""
    at = [START + timedelta(milliseconds=(n * 7919) % 5000) for n in range(200)] + [datetime(2024, 3, 31, 23, 59, 59), datetime(2024, 4, 1), datetime(2024, 3, 5, 0, 0, 2)]
    events = spark.createDataFrame([(n, 1 + n % 2, t) for n, t in enumerate(at)], "event_id long, account_id long, occurred_at timestamp")
    want, counts = {}, {}
    for n, t in sorted(enumerate(at), key=lambda x: (x[1], x[0])):
        key = (1 + n % 2, t.month)
        counts[key] = want[n] = counts.get(key, 0) + 1
    assert {r.event_id: r.seq for r in metering.numbered(events).collect()} == want


@pytest.mark.parametrize("report", [lambda e, now: reports.realtime(e, now), lambda e, now: metering.recent_total(e, now), lambda e, now: metering.opt_outs(e, now - timedelta(hours=3), now), lambda e, now: metering.rejections(e, now, 1)])
def test_scans_open_only_their_days(spark, tmp_path, report):
    times = [START + timedelta(hours=6 * n) for n in range(40)]
    events = spark.createDataFrame([(1, f"v{n}", t, n % 2 == 0, "bad") for n, t in enumerate(times)], "site_id long, visitor_hash string, occurred_at timestamp, opted_out boolean, reason string")
    tables.write_events(events, str(tmp_path / "events"))
    held = spark.read.parquet(str(tmp_path / "events"))
    now = START + timedelta(days=5, hours=1)
    out = report(held, now)
    assert sorted(out.collect()) == sorted(report(events, now).collect())
    plan = out._jdf.queryExecution().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_within_is_half_open(spark):
    rows = spark.createDataFrame([(START + timedelta(hours=n),) for n in range(4)], "occurred_at timestamp").withColumn("event_date", F.to_date("occurred_at"))
    assert within(rows, START + timedelta(hours=1), START + timedelta(hours=3)).count() == 2
    assert within(rows).count() == 4 and within(rows, end=START).count() == 0
