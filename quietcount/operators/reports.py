"""Traffic reports for all sites in one job: panels, properties, summary, time series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.filters import DIMENSIONS, cleaned, predicate, qualified, volume
from quietcount.functions.period import within
from quietcount.functions.suppression import percent, top
from quietcount.schema import PAGEVIEW

NULLS_LAST = "value"


def scoped(events: DataFrame, bounds: DataFrame, previous: bool = False, pruned: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Events of each site's period, with the site's columns; previous: also the window before, told by `window`.

    bounds is a small dimension (a row per site of the report). pruned adds plain literals that
    reach the scan.
    """
    if pruned:
        events = within(events, *pruned)
    lower = F.col("prev_from_ts" if previous else "from_ts")
    shared = [c for c in bounds.columns if c not in events.columns or c == "site_id"]
    joined = events.join(bounds.select(*shared), "site_id")
    out = joined.where((F.col("occurred_at") >= lower) & (F.col("occurred_at") < F.col("to_ts")))
    return out.withColumn("window", F.when(F.col("occurred_at") >= F.col("from_ts"), "cur").otherwise("prev")) if previous else out


def dimension_value(name: str) -> Column:
    column = F.col(DIMENSIONS[name])
    if name == "entry_page":
        return F.when(F.col("is_entry"), column)
    return F.when(column != PAGEVIEW, column) if name == "event" else column


def panels(scope: DataFrame, dimensions: list[str], filters: dict | None = None, limit: int = 10) -> DataFrame:
    """Breakdowns by several dimensions in one pass: per site, dimension and value.

    Every event is dealt into a row per dimension and counted once; the grand total rides along as a
    dimension of its own. Percentages are of the scope's visitors. Rows come after
    suppression and are cut to `limit` per panel.
    """
    limit = min(max(limit, 1), 500)
    rows = scope.where(predicate(filters))
    conditional = [d for d in dimensions if d in ("entry_page", "event")]
    cells = [F.struct(F.lit(d).alias("dimension"), dimension_value(d).alias("value")) for d in dimensions]
    total = F.struct(F.lit("").alias("dimension"), F.lit(None).cast("string").alias("value"))
    long = rows.select("site_id", "k", "visitor_hash", "event_name", F.explode(F.array(*cells, total)).alias("c"))
    long = long.select("site_id", "k", "visitor_hash", "event_name", "c.dimension", "c.value")
    if conditional:
        long = long.where(~(F.col("dimension").isin(*conditional) & F.col("value").isNull()))
    # two steps: a visitor counts once per value, and only sums meet in the second
    by_visitor = long.groupBy("site_id", "k", "dimension", "value", "visitor_hash").agg(volume(filters).alias("n"))
    counted = by_visitor.groupBy("site_id", "k", "dimension", "value").agg(F.count(F.lit(1)).alias("visitors"), F.sum("n").alias("volume"))
    return ranked(counted, ["site_id", "dimension"], limit, "dimension")


def ranked(counted: DataFrame, panel: list[str], limit: int, total_in: str | None = None) -> DataFrame:
    """Suppression, percentages and the top rows of each panel (total_in: see `top`; else rows have total_visitors)."""
    rows = top(counted, panel, limit, total_in=total_in)
    share = percent(F.col("visitors"), F.col("total_visitors")).alias("percentage")
    return rows.select(*panel, "value", "visitors", "volume", share, "rank", "withheld_rows", "withheld_visitors")


def breakdown(scope: DataFrame, dimension: str, filters: dict | None = None, limit: int = 10) -> DataFrame:
    """One panel. Entry pages under a filter are the entries of the sessions that the filter qualifies."""
    if dimension == "entry_page" and cleaned(filters):
        rows = qualified(scope, filters)
        entries = rows.where("is_entry").groupBy("site_id", "k", F.col("path").alias("value")).agg(
            F.countDistinct("visitor_hash").alias("visitors"), F.count_if(F.col("event_name") == PAGEVIEW).alias("volume")
        )
        total = scope.where(predicate(filters)).groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("total_visitors"))
        counted = entries.join(total, "site_id").withColumn("dimension", F.lit("entry_page"))
        return ranked(counted, ["site_id", "dimension"], min(max(limit, 1), 500))
    return panels(scope, [dimension], filters, limit)


def property_breakdown(scope: DataFrame, filters: dict | None = None, limit: int = 10) -> DataFrame:
    """Visitors and events per property key and value; keys are ranked by their kept visitors."""
    rows = scope.where(predicate(filters)).select("site_id", "k", "visitor_hash", F.explode("props").alias("key", "value"))
    by_visitor = rows.groupBy("site_id", "k", "key", "value", "visitor_hash").agg(F.count(F.lit(1)).alias("n"))
    counted = by_visitor.groupBy("site_id", "k", "key", "value").agg(F.count(F.lit(1)).alias("visitors"), F.sum("n").alias("volume"))
    kept = top(counted, ["site_id", "key"], limit)
    # limit rows of each key at most are numbered
    keys = Window.partitionBy("site_id").orderBy(F.col("kept_visitors").desc(), "key")
    kept = kept.withColumn("key_rank", F.dense_rank().over(keys))
    return kept.select("site_id", "key", "key_rank", "value", "visitors", "volume", "rank", "withheld_rows", "withheld_visitors")


def known_values(scope: DataFrame, limit: int = 250) -> DataFrame:
    """Paths and custom events that a site's filters may offer, suppressed, without blanks."""
    return panels(scope, ["page", "event"], None, limit).where("coalesce(value, '') <> ''")


def sessions(scope: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session: pageviews, seconds from first to last event."""
    return scope.groupBy(*keys, "session_hash").agg(
        F.count_if(F.col("event_name") == PAGEVIEW).alias("pageviews"),
        (F.max("occurred_at").cast("double") - F.min("occurred_at").cast("double")).alias("seconds"),
    )


def session_metrics(by_session: DataFrame, keys: list[str]) -> DataFrame:
    """sessions, bounces, bounce_rate, average duration in whole seconds."""
    out = by_session.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("pageviews") <= 1).alias("bounces"),
        F.floor(F.coalesce(F.avg(F.round(F.col("seconds") * 1_000_000).cast("decimal(20,0)")), F.lit(0)) / 1_000_000 + F.expr("0.5")).cast("long").alias("avg_duration"),
    )
    return out.withColumn("bounce_rate", percent(F.col("bounces"), F.col("sessions")))


def summary(scope: DataFrame, bounds: DataFrame, filters: dict | None = None) -> DataFrame:
    """Totals and session metrics of each site's period and the one before, zero where a site had none.

    scope must tell its windows (scoped(previous=True)): both are measured in the same pass.
    """
    keys = ["site_id", "window"]
    totals = scope.where(predicate(filters)).groupBy(*keys).agg(volume(filters).alias("volume"), F.countDistinct("visitor_hash").alias("visitors"))
    return summed(bounds, totals, session_metrics(sessions(qualified(scope, filters), keys), keys))


def summed(bounds: DataFrame, totals: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals and session metrics of both windows of every site, zero where there are none."""
    keys = ["site_id", "window"]
    frame = bounds.select("site_id").crossJoin(bounds.sparkSession.sql("SELECT explode(array('cur', 'prev')) AS window"))
    both = frame.join(totals, keys, "left").join(metrics, keys, "left").na.fill(0)
    per_visit = F.when(F.col("sessions") > 0, F.floor((F.col("volume") * 200 + F.col("sessions")) / (F.col("sessions") * 2)) / 100.0).otherwise(F.lit(0.0))
    return both.withColumn("views_per_visit", per_visit)


def compared(summary_rows: DataFrame) -> DataFrame:
    """Each metric of the period beside its change in percent; null where it was 0 before."""
    metrics = ["volume", "visitors", "sessions", "bounce_rate", "avg_duration", "views_per_visit"]
    side = {w: [F.max(F.when(F.col("window") == w, F.col(m))).alias(f"{w}_{m}") for m in metrics] for w in ("cur", "prev")}
    wide = summary_rows.groupBy("site_id").agg(*side["cur"], *side["prev"])
    change = [
        F.when(F.col(f"prev_{m}") != 0, F.round((F.col(f"cur_{m}") - F.col(f"prev_{m}")) * 100.0 / F.col(f"prev_{m}"), 1)).alias(f"change_{m}")
        for m in metrics
    ]
    return wide.select("site_id", *[F.col(f"cur_{m}").alias(m) for m in metrics], *change)


def bucket(unit: str | None, at: str = "occurred_at") -> str:
    """SQL: a time's bucket in site-local time; hours step in absolute time, so a repeated hour stays two. None: the width is the column unit."""
    offset = f"unix_timestamp(from_utc_timestamp({at}, timezone)) - unix_timestamp({at})"
    shift = f"pmod({offset}, 3600)"
    hour = f"from_utc_timestamp(timestamp_seconds((unix_timestamp({at}) + {shift}) div 3600 * 3600 - {shift}), timezone)"
    if unit is None:
        return f"CASE WHEN unit = 'hour' THEN {hour} ELSE date_trunc(unit, from_utc_timestamp({at}, timezone)) END"
    return hour if unit == "hour" else f"date_trunc('{unit}', from_utc_timestamp({at}, timezone))"


def grid(bounds: DataFrame, unit: str | None) -> DataFrame:
    """site_id and every bucket of its period, of one width or of each site's own (column unit)."""
    width = "unit" if unit is None else f"'{unit}'"
    first = f"date_trunc({width}, from_utc_timestamp(from_ts, timezone))"
    last = "from_utc_timestamp(to_ts, timezone) - INTERVAL 1 SECOND"
    days = f"CASE {width} WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END"
    buckets = f"CASE WHEN {width} = 'month' THEN sequence({first}, {last}, INTERVAL 1 MONTH) ELSE sequence({first}, {last}, {days}) END"
    return bounds.select("site_id", F.explode(F.expr(buckets)).alias("bucket"))


def timeseries(scope: DataFrame, bounds: DataFrame, unit: str | None = None, filters: dict | None = None) -> DataFrame:
    """Visitors and volume per bucket of a period, with zeros where nothing happened. Without a unit, each site's bounds tell its own."""
    counted = scope.where(predicate(filters)).groupBy("site_id", F.expr(bucket(unit)).alias("bucket")).agg(
        F.countDistinct("visitor_hash").alias("visitors"), volume(filters).alias("volume")
    )
    return grid(bounds, unit).join(counted, ["site_id", "bucket"], "left").na.fill(0, ["visitors", "volume"])


def realtime(events: DataFrame, now: datetime, seconds: int = 300) -> DataFrame:
    """Distinct visitors since `seconds` (an hour at most) before now."""
    since = now - timedelta(seconds=min(max(seconds, 1), 3600))
    return within(events, since).groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("visitors"))
