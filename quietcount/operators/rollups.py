"""Hourly, visitor-day and session-day rollups, reports from them, and their checks against raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.operators.reports import session_metrics
from quietcount.schema import PAGEVIEW



def is_page():
    return F.col("event_name") == PAGEVIEW


def hourly(events: DataFrame) -> DataFrame:
    """Per hour and site: pageviews, custom_events, visitors, sessions, entries, revenue_cents."""
    return events.groupBy(F.date_trunc("hour", "occurred_at").alias("bucket"), "site_id").agg(
        F.count_if(is_page()).alias("pageviews"),
        F.count_if(~is_page()).alias("custom_events"),
        F.countDistinct("visitor_hash").alias("visitors"),
        F.countDistinct("session_hash").alias("sessions"),
        F.count_if("is_entry").alias("entries"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).alias("revenue_cents"),
    )


def visitor_days(events: DataFrame) -> DataFrame:
    """Per UTC day, site and visitor: events, pageviews, first_seen, last_seen."""
    return events.groupBy(F.date_trunc("day", "occurred_at").alias("bucket"), "site_id", "visitor_hash").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_page()).alias("pageviews"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")
    )


def session_days(events: DataFrame) -> DataFrame:
    """Per UTC day, site and session: pageviews, started_at, ended_at."""
    return events.groupBy(F.date_trunc("day", "occurred_at").alias("bucket"), "site_id", "session_hash").agg(
        F.count_if(is_page()).alias("pageviews"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at")
    )


def within(rollup: DataFrame, bounds: DataFrame) -> DataFrame:
    joined = rollup.join(bounds.select("site_id", "from_ts", "to_ts"), "site_id")
    return joined.where("bucket >= from_ts AND bucket < to_ts").drop("from_ts", "to_ts")


def summary_from_rollups(hours: DataFrame, visitors: DataFrame, session_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """The unfiltered summary of UTC-aligned periods: volume, visitors and session metrics."""
    volume = within(hours, bounds).groupBy("site_id").agg(F.sum("pageviews").alias("volume"))
    people = within(visitors, bounds).groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("visitors"))
    spans = within(session_rows, bounds).groupBy("site_id", "session_hash").agg(
        F.sum("pageviews").alias("pageviews"), (F.max("ended_at").cast("double") - F.min("started_at").cast("double")).alias("seconds")
    )
    out = bounds.select("site_id").join(volume, "site_id", "left").join(people, "site_id", "left")
    return out.join(session_metrics(spans, ["site_id"]), "site_id", "left").na.fill(0)


def hourly_series(hours: DataFrame, bounds: DataFrame) -> DataFrame:
    """visitors and volume per UTC hour, straight from the hourly rollup."""
    return within(hours, bounds).select("site_id", "bucket", "visitors", F.col("pageviews").alias("volume"))


def daily_series(hours: DataFrame, visitors: DataFrame, bounds: DataFrame, unit: str = "day") -> DataFrame:
    """Buckets of distinct visitors (from visitor days) beside summed pageviews (from hours)."""
    at = F.date_trunc(unit, "bucket").alias("bucket")
    people = within(visitors, bounds).groupBy("site_id", at).agg(F.countDistinct("visitor_hash").alias("visitors"))
    volume = within(hours, bounds).groupBy("site_id", at).agg(F.sum("pageviews").alias("volume"))
    return people.join(volume, ["site_id", "bucket"], "full").na.fill(0, ["visitors", "volume"])


def site_totals(hours: DataFrame, sites: DataFrame) -> DataFrame:
    """Lifetime pageviews, custom events and visits of the listed sites, and their sum (site_id null)."""
    listed = sites.select("site_id").distinct()
    sums = hours.join(listed, "site_id", "left_semi").groupBy("site_id").agg(
        F.sum("pageviews").alias("pageviews"), F.sum("custom_events").alias("custom_events"), F.sum("entries").alias("visits")
    )
    filled = listed.join(sums, "site_id", "left").na.fill(0)
    return filled.rollup("site_id").agg(F.sum("pageviews").alias("pageviews"), F.sum("custom_events").alias("custom_events"), F.sum("visits").alias("visits"))


def aligned(bounds: DataFrame, unit: str) -> bool:
    """Whether every period of bounds starts and ends on a UTC bucket edge (bounds has a row per site)."""
    off = bounds.where((F.date_trunc(unit, "from_ts") != F.col("from_ts")) | (F.date_trunc(unit, "to_ts") != F.col("to_ts")))
    return off.isEmpty()


def visitors_rollup_first(events: DataFrame, visitors: DataFrame, bounds: DataFrame) -> DataFrame:
    """Exact distinct visitors of any period: whole UTC days from the rollup, only the edges from raw events."""
    edges = bounds.withColumn("lo", F.date_trunc("day", F.col("from_ts") + F.expr("INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"))).withColumn("hi", F.date_trunc("day", "to_ts"))
    few = edges.select("site_id", "from_ts", "to_ts", "lo", "hi")
    inner = visitors.join(few, "site_id").where("bucket >= lo AND bucket < hi").select("site_id", "visitor_hash")
    outer = events.join(few, "site_id").where("occurred_at >= from_ts AND occurred_at < to_ts AND (occurred_at < lo OR occurred_at >= hi OR lo > hi)")
    both = inner.unionByName(outer.select("site_id", "visitor_hash").distinct())
    return both.groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("visitors"))


def drift(rollup: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a rollup that raw events don't give, and the other way, per site and day."""
    sides = rollup.exceptAll(recomputed).withColumn("side", F.lit("only_rollup")).unionByName(recomputed.exceptAll(rollup).withColumn("side", F.lit("only_raw")))
    return sides.groupBy("site_id", F.to_date("bucket").alias("day"), "side").agg(F.count(F.lit(1)).alias("n"))


def live(materialised: DataFrame, events: DataFrame, watermark, aggregate) -> DataFrame:
    """The rollup below the watermark, and raw events from it on, aggregated now."""
    tail = aggregate(events.where(F.col("occurred_at") >= F.lit(watermark)))
    return materialised.where(F.col("bucket") < F.lit(watermark)).unionByName(tail)
