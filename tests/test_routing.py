"""Rollup-first reports equal raw ones on random events, zones and periods; the raw scan is limited to the edges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quietcount.functions.period import site_bounds
from quietcount.operators import lifecycle, reports, rollups, routing
from quietcount.sources.snapshots import Snapshots

ZONES = ["Etc/UTC", "Europe/Berlin", "Asia/Kolkata", "America/New_York", "Pacific/Chatham"]
NOW = datetime(2024, 4, 2, 3)


def made(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = datetime(2024, 3, 1) + timedelta(seconds=rng.randrange(33 * 86_400))
        visitor = rng.randrange(60)
        # sessions of visitors go on over midnights and cuts
        rows.append((at, rng.randrange(5), f"v{visitor}", f"s{visitor}-{(at - datetime(2024, 3, 1)).days // 3}", rng.choice(["pageview", "pageview", "Signup"])))
    events = spark.createDataFrame(rows, "occurred_at timestamp, site_id long, visitor_hash string, session_hash string, event_name string")
    return events.withColumns({"is_entry": F.lit(False), "revenue_cents": F.lit(None).cast("long")})


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('routing')}/events"
    made(spark).write.parquet(path)
    return spark.read.parquet(path)


def sites(spark):
    return spark.createDataFrame([(i, z) for i, z in enumerate(ZONES)] + [(9, "Asia/Tokyo")], "site_id long, timezone string").withColumn("k", F.lit(0))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("preset", ["today", "7d", "30d", "month"])
def test_summaries(spark, events, preset):
    bounds = site_bounds(sites(spark), preset, NOW)
    want = reports.summary(reports.scoped(events, bounds, True), bounds)
    got = routing.summary(events, rollups.visitor_days(events), rollups.session_days(events), bounds)
    assert rows_of(got) == rows_of(want.select(*got.columns)) and sum(r.visitors for r in got.collect()) > 0


@pytest.mark.parametrize(("preset", "unit"), [("30d", "week"), ("30d", "day"), ("12mo", "month"), ("today", "hour"), ("30d", None), ("12mo", None)])
def test_series(spark, events, preset, unit):
    bounds = site_bounds(sites(spark), preset, NOW)
    want = reports.timeseries(reports.scoped(events, bounds), bounds, unit)
    got = routing.timeseries(events, rollups.visitor_days(events), bounds, unit)
    assert rows_of(got) == rows_of(want)


def test_every_site_has_its_own_width(spark, events):
    presets = ["today", "7d", "30d", "12mo", "month"]
    parts = [site_bounds(sites(spark).where(F.col("site_id") == i), p, NOW) for i, p in enumerate(presets)]
    bounds = parts[0]
    for p in parts[1:]:
        bounds = bounds.unionByName(p)
    units = {r.site_id: r.unit for r in bounds.collect()}
    assert units == {0: "hour", 1: "day", 2: "day", 3: "week", 4: "hour"}  # April has two days so far
    mixed = reports.timeseries(reports.scoped(events, bounds), bounds)
    assert rows_of(routing.timeseries(events, rollups.visitor_days(events), bounds)) == rows_of(mixed)
    for i, part in enumerate(parts):
        alone = reports.timeseries(reports.scoped(events, part), part, units[i])
        assert rows_of(mixed.where(F.col("site_id") == i)) == rows_of(alone)


def test_the_raw_scan_reads_edges_only(spark, events, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    lifecycle.loaded(store, events)
    zoned = sites(spark).where("timezone = 'Europe/Berlin'")
    bounds = site_bounds(zoned, "7d", NOW)
    days = routing.edges(bounds, routing.windows, "prev_from_ts")
    assert [str(d) for d in days] == ["2024-03-26", "2024-04-02"]  # 23:00 and, after the change of clocks, 22:00; the window before is an hour shorter and begins at 00:00
    report = routing.summary(store.read("events"), store.read("visitor_days"), store.read("session_days"), bounds)
    want = reports.summary(reports.scoped(events, bounds, True), bounds)
    assert rows_of(report) == rows_of(want.select(*report.columns))
    plan = report._jdf.queryExecution().executedPlan().toString()
    raw = [line for line in plan.splitlines() if "PartitionFilters" in line and "occurred_at" in line]
    assert raw and all("event_date" in line.split("PartitionFilters")[1].split("]")[0] and " IN (" in line.split("PartitionFilters")[1] for line in raw)
    assert routing.edges(site_bounds(sites(spark).where("timezone = 'Etc/UTC'"), "7d", NOW), routing.windows, "prev_from_ts") == []
