"""Rollup-first reports of any period: whole UTC days from the rollups, only what is left from raw events.

A report deals times into cells: the period and the one before it, or the buckets of a series in each site's zone. A UTC
day that lies whole in one cell is answered by its rollup rows; the other days of a site are its edges (the cut ends of a period, and
for buckets the days over which a local bucket ends), and raw events of these alone are read. Which days are edges of
some site is known from the bounds, so it reaches the scan as literals.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.operators.reports import bucket, grid, session_metrics, summed
from quietcount.schema import PAGEVIEW

#: SQL of a time's cell, null outside of the report.
Cell = Callable[[str], str]
DAY_OF = "date_trunc('DAY', occurred_at)"


def windows(at: str) -> str:
    """The period and the one before it."""
    return f"CASE WHEN {at} >= from_ts AND {at} < to_ts THEN 'cur' WHEN {at} >= prev_from_ts AND {at} < from_ts THEN 'prev' END"


def buckets(unit: str | None) -> Cell:
    """The buckets of a period, of one width or of each site's own."""
    return lambda at: f"CASE WHEN {at} >= from_ts AND {at} < to_ts THEN {bucket(unit, at)} END"


def whole(cell: Cell, day: str) -> str:
    """SQL: whether a UTC day (its midnight) lies in one cell."""
    return f"coalesce(({cell(day)}) = ({cell(f'({day} + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)')}), false)"


def edges(bounds: DataFrame, cell: Cell, first: str = "from_ts") -> list[date]:
    """UTC days that are no whole day of some site whose period holds a part of them; at most the days of the longest period."""
    days = f"sequence(date_trunc('DAY', {first}), date_trunc('DAY', to_ts - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)"
    rows = bounds.select("*", F.explode(F.expr(days)).alias("day")).where(f"NOT {whole(cell, 'day')}")
    return [r[0] for r in rows.select(F.to_date("day")).distinct().orderBy(F.to_date("day")).collect()]


def only_days(events: DataFrame, days: list[date]) -> DataFrame:
    """Events of these UTC days, as filters that the scan takes: on the day partition if there is one, and on the time."""
    spans: list[list[date]] = []
    for d in days:
        if spans and d == spans[-1][1]:
            spans[-1][1] = d + timedelta(days=1)
        else:
            spans.append([d, d + timedelta(days=1)])
    at = F.col("occurred_at")
    test = reduce(lambda a, b: a | b, [(at >= F.lit(a).cast("timestamp")) & (at < F.lit(b).cast("timestamp")) for a, b in spans], F.lit(False))
    return events.where(F.col("event_date").isin(days) & test) if "event_date" in events.columns else events.where(test)


def sides(events: DataFrame, rollup: DataFrame, bounds: DataFrame, cell: Cell, first: str = "from_ts") -> tuple[DataFrame, DataFrame]:
    """(rollup rows of whole days, raw events of the rest), both with the column cell."""
    kept = ["site_id", "timezone", "from_ts", "to_ts", *[c for c in ("prev_from_ts", "unit") if c in bounds.columns]]
    ranges = bounds.select(*kept)
    low, high = ranges.agg(F.min(first), F.max("to_ts")).first()
    inner = rollup if low is None else rollup.where((F.col("bucket") >= F.lit(low)) & (F.col("bucket") < F.lit(high)))
    if low is not None and "event_date" in rollup.columns:
        inner = inner.where((F.col("event_date") >= F.lit(low.date())) & (F.col("event_date") <= F.lit(high.date())))
    inner = inner.join(ranges, "site_id").where(whole(cell, "bucket")).withColumn("cell", F.expr(cell("bucket")))
    raw = only_days(events, edges(bounds, cell, first)).drop(*[c for c in kept if c != "site_id"])
    raw = raw.join(ranges, "site_id").where(f"NOT {whole(cell, DAY_OF)}").withColumn("cell", F.expr(cell("occurred_at")))
    return inner, raw.where("cell IS NOT NULL")


def summary(events: DataFrame, visitors: DataFrame, session_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """reports.summary without filters, of any periods. Fragments of a session on both sides of a cut are put together: its
    pageviews add up, and its first and last time come from whichever side has them."""
    keys = ["site_id", "window"]
    held, raw = sides(events, session_rows, bounds, windows, "prev_from_ts")
    page = F.count_if(F.col("event_name") == PAGEVIEW).alias("pageviews")
    fragments = held.select("site_id", F.col("cell").alias("window"), "session_hash", "pageviews", "started_at", "ended_at").unionByName(
        raw.groupBy("site_id", F.col("cell").alias("window"), "session_hash").agg(page, F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"))
    )
    whole_sessions = fragments.groupBy(*keys, "session_hash").agg(
        F.sum("pageviews").alias("pageviews"), (F.max("ended_at").cast("double") - F.min("started_at").cast("double")).alias("seconds")
    )
    held, raw = sides(events, visitors, bounds, windows, "prev_from_ts")
    people = held.select("site_id", F.col("cell").alias("window"), "visitor_hash", "pageviews").unionByName(
        raw.groupBy("site_id", F.col("cell").alias("window"), "visitor_hash").agg(page)
    )
    # a visitor counts once per window, and only sums meet in the second step
    people = people.groupBy(*keys, "visitor_hash").agg(F.sum("pageviews").alias("pageviews"))
    totals = people.groupBy(*keys).agg(F.sum("pageviews").alias("volume"), F.count("visitor_hash").alias("visitors"))
    return summed(bounds, totals, session_metrics(whole_sessions, keys))


def timeseries(events: DataFrame, visitors: DataFrame, bounds: DataFrame, unit: str | None = None) -> DataFrame:
    """reports.timeseries without filters, of any periods and zones."""
    held, raw = sides(events, visitors, bounds, buckets(unit))
    parts = held.select("site_id", F.col("cell").alias("bucket"), "visitor_hash", "pageviews").unionByName(
        raw.groupBy("site_id", F.col("cell").alias("bucket"), "visitor_hash").agg(F.count_if(F.col("event_name") == PAGEVIEW).alias("pageviews"))
    )
    people = parts.groupBy("site_id", "bucket", "visitor_hash").agg(F.sum("pageviews").alias("pageviews"))
    counted = people.groupBy("site_id", "bucket").agg(F.count("visitor_hash").alias("visitors"), F.sum("pageviews").alias("volume"))
    return grid(bounds, unit).join(counted, ["site_id", "bucket"], "left").na.fill(0, ["visitors", "volume"])
