"""Bounded tops against windows over all values; plans of panels and funnels."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.matchers import Matcher
from quietcount.functions.period import widest
from quietcount.functions.suppression import suppress, top
from quietcount.operators import reports, sequences
from quietcount.plans import traffic
from quietcount.sources import adapter

DATA = "/root/testdata/sf0.001"


def by_windows(rows, panel, limit, values):
    ties = [F.col("volume").desc(), *[F.col(v).asc_nulls_last() for v in values]]
    kept = suppress(rows, panel, ties).where("NOT withheld")
    w = Window.partitionBy(*panel)
    kept = kept.withColumn("kept_visitors", F.sum("visitors").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("visitors").desc(), *ties)))
    return kept.where(F.col("rank") <= limit)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_top_of_random_panels(spark, limit):
    rng = random.Random(limit)
    rows = []
    for panel in range(60):
        k = rng.choice([0, 2, 5])
        for v in range(rng.randrange(1, 9)):
            value = None if v == 0 and rng.random() < 0.5 else f"v{v}"
            rows += [(panel % 7, f"d{panel}", value, kind, rng.randrange(8), rng.randrange(4), k) for kind in (None, "page")[: rng.randrange(1, 3)]]
    df = spark.createDataFrame(rows, "site_id long, dimension string, value string, kind string, visitors long, volume long, k long")
    panel, values = ["site_id", "dimension"], ("value", "kind")
    got = top(df, panel, limit, values=values)
    want = by_windows(df, panel, limit, values).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50


def test_the_total_rides_along(spark):
    rows = [(1, "", None, 9, 9, 2), (1, "page", "/a", 5, 5, 2), (1, "page", "/b", 1, 1, 2), (1, "page", "/c", 4, 6, 2), (1, "page", "/d", 4, 7, 2), (1, "os", "x", 1, 1, 2), (2, "", None, 3, 3, 0), (2, "os", "y", 3, 3, 0)]
    df = spark.createDataFrame(rows, "site_id long, dimension string, value string, visitors long, volume long, k long")
    got = {(r.site_id, r.dimension, r.value): (r["rank"], r.withheld_rows, r.withheld_visitors, r.total_visitors) for r in top(df, ["site_id", "dimension"], 10, total_in="dimension").collect()}
    # /b is small and alone, so the smallest other goes with it: of equal ones that of the larger volume
    assert got == {(1, "page", "/a"): (1, 2, 5, 9), (1, "page", "/c"): (2, 2, 5, 9), (2, "os", "y"): (1, 0, 0, 3)}
    assert top(df.limit(0), ["site_id", "dimension"], 10).collect() == []


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["property_breakdown", "breakdown_batch"])
def test_no_window_sees_all_values_of_a_panel(spark, name):
    plan = executed(traffic.QUERIES[name](spark, DATA))
    lines = plan.splitlines()
    ranked = [i for i, line in enumerate(lines) if "Window [" in line and "row_number" in line and "visitors" in line]
    assert ranked and all(any("WindowGroupLimit" in line for line in lines[i : i + 3]) for i in ranked)
    assert plan.count("WindowGroupLimit") >= 2  # each task keeps its own first rows before they meet


def test_all_funnels_in_one_scan(spark):
    kind = [Matcher("pageview", "exact", f"/p/{i}") for i in range(12)]
    funnels = [sequences.Funnel(n, tuple((kind[(n + i) % 12],) for i in range(2 + n % 7)), 3_600 * (1 + n % 5)) for n in range(9)]
    assert sum(len(f.steps) for f in funnels) > 32  # more than one word of bits
    events, bounds = adapter.events(spark, DATA), traffic.bounds(spark)
    got = sequences.all_counts(events, bounds, funnels, widest("30d", traffic.NOW))
    rows = {(r.site_id, r.funnel_id, r.step): r.visitors for r in got.collect()}
    scope = reports.scoped(events, bounds)
    for f in funnels:
        want = {(r.site_id, f.funnel_id, r.step): r.visitors for r in sequences.funnel_counts(events, scope, f).collect()}
        assert {k: v for k, v in rows.items() if k[1] == f.funnel_id and k in want} == want
        assert all(v == 0 for k, v in rows.items() if k[1] == f.funnel_id and k not in want)
    summaries = sequences.funnel_summaries_at_once(events, bounds, funnels)
    assert executed(summaries).count("FileScan") == 1


def test_filters_hold_for_the_entry_only(spark):
    funnel = sequences.Funnel(1, ((Matcher("pageview", "exact", "/p/1"),), (Matcher("pageview", "prefix", "/p/"),)), 86_400)
    events, bounds = adapter.events(spark, DATA), traffic.bounds(spark)
    filters = {"browser": "Firefox"}
    want = {(r.site_id, r.step): r.visitors for r in sequences.funnel_counts(events, reports.scoped(events, bounds), funnel, filters).collect()}
    got = {(r.site_id, r.step): r.visitors for r in sequences.all_counts(events, bounds, [funnel], filters=filters).collect()}
    assert got == want
