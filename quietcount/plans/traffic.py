"""Registered traffic queries and their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.functions.period import site_bounds, widest
from quietcount.operators import reports, rollups
from quietcount.sources import adapter
from quietcount.sources.adapter import CTES

NOW = datetime(2024, 1, 30, 12)
PANELS = ["page", "source", "country", "browser", "device", "utm_medium", "entry_page", "event"]
FILTER = {"country": "DE", "props:k": "7"}
EVENT_FILTER = {"event": "Signup"}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def stamp(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column)


def bounds(spark: SparkSession, preset: str = "30d") -> DataFrame:
    return site_bounds(adapter.sites(spark), preset, NOW)


def scope(spark: SparkSession, sf_dir: str, preset: str = "30d", previous: bool = False) -> DataFrame:
    return reports.scoped(adapter.events(spark, sf_dir), bounds(spark, preset), previous, widest(preset, NOW))


def bounds_sql(preset: str = "30d") -> str:
    today = "date_trunc('day', (TIMESTAMP '2024-01-30 12:00:00' AT TIME ZONE 'UTC') AT TIME ZONE timezone)"
    first = f"date_trunc('month', {today} - INTERVAL 11 MONTH)" if preset == "12mo" else f"{today} - INTERVAL {({'30d': 29, '7d': 6, 'today': 0}[preset])} DAY"
    return f"""bounds AS (
  SELECT *, to_ts - from_ts AS span FROM (SELECT *, (({first}) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS from_ts,
    (({today} + INTERVAL 1 DAY) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS to_ts FROM sites)
)"""


def scope_sql(preset: str = "30d") -> str:
    return f"""{CTES}, {bounds_sql(preset)}, sc AS (
  SELECT ev.*, b.k, b.from_ts, b.to_ts, CASE WHEN occurred_at >= from_ts THEN 'cur' ELSE 'prev' END AS win
  FROM ev JOIN bounds b USING (site_id) WHERE occurred_at >= from_ts - span AND occurred_at < to_ts
), cur AS (SELECT * FROM sc WHERE win = 'cur')"""


PCT = "CASE WHEN {w} > 0 THEN ((2000 * {v} + {w}) // (2 * {w})) / 10.0 ELSE 0.0 END"


def ranked_sql(counted: str, panel: str, limit: int) -> str:
    """Suppression and ranking of `counted` (panel columns, value, visitors, volume, total_visitors, k)."""
    return f"""
    s1 AS (SELECT *, visitors < k AS small, count(*) FILTER (visitors < k) OVER (PARTITION BY {panel}) AS ns FROM {counted}),
    s2 AS (SELECT *, small OR (ns = 1 AND row_number() OVER (PARTITION BY {panel} ORDER BY small, visitors, volume DESC, value NULLS LAST) = 1) AS withheld FROM s1),
    s3 AS (SELECT *, count(*) FILTER (withheld) OVER (PARTITION BY {panel}) AS withheld_rows,
      coalesce(sum(visitors) FILTER (withheld) OVER (PARTITION BY {panel}), 0)::BIGINT AS withheld_visitors FROM s2),
    s4 AS (SELECT *, row_number() OVER (PARTITION BY {panel} ORDER BY visitors DESC, volume DESC, value NULLS LAST) AS rank FROM s3 WHERE NOT withheld)
    SELECT {panel}, value, visitors, volume::BIGINT AS volume, {PCT.format(v='visitors', w='total_visitors')} AS percentage, rank, withheld_rows, withheld_visitors
    FROM s4 WHERE rank <= {limit}"""


_VALUE = {
    "page": "path", "source": "referrer_source", "country": "country_code", "browser": "browser", "device": "device_type", "utm_medium": "utm_medium",
    "os": "os", "utm_campaign": "utm_campaign", "entry_page": "CASE WHEN is_entry THEN path END", "event": "CASE WHEN event_name <> 'pageview' THEN event_name END",
}


def panels_sql(dimensions: list[str], where: str, volume: str, limit: int, preset: str = "30d") -> str:
    unions = " UNION ALL ".join(
        f"SELECT site_id, k, '{d}' AS dimension, {_VALUE[d]} AS value, visitor_hash, event_name FROM f"
        + (f" WHERE {_VALUE[d]} IS NOT NULL" if d in ("entry_page", "event") else "")
        for d in dimensions
    )
    return f"""WITH {scope_sql(preset)}, f AS (SELECT * FROM cur WHERE {where}), l AS ({unions}),
    t AS (SELECT site_id, count(DISTINCT visitor_hash) AS total_visitors FROM f GROUP BY 1),
    c AS (SELECT site_id, dimension, value, any_value(k) AS k, count(DISTINCT visitor_hash) AS visitors, {volume} AS volume, any_value(total_visitors) AS total_visitors
      FROM l JOIN t USING (site_id) GROUP BY 1, 2, 3), {ranked_sql('c', 'site_id, dimension', limit)}"""


PAGES, ALL = "count(*) FILTER (event_name = 'pageview')", "count(*)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("breakdown_batch", panels_sql(PANELS, "true", PAGES, 10))
def breakdown_batch(spark, sf_dir):
    return reports.panels(scope(spark, sf_dir), PANELS)


@query("breakdown_page", panels_sql(["page"], "true", PAGES, 500))
def breakdown_page(spark, sf_dir):
    return reports.breakdown(scope(spark, sf_dir), "page", None, 500)


@query("breakdown_filtered", panels_sql(["page", "source"], "country_code = 'DE'", PAGES, 10))
def breakdown_filtered(spark, sf_dir):
    return reports.panels(scope(spark, sf_dir), ["page", "source"], {"country": "DE", "unknown": "x"})


@query("breakdown_event_filter", panels_sql(["page", "browser"], "event_name = 'Signup'", ALL, 10))
def breakdown_event_filter(spark, sf_dir):
    return reports.panels(scope(spark, sf_dir), ["page", "browser"], EVENT_FILTER)


@query(
    "entry_pages_filtered",
    f"""WITH {scope_sql()}, f AS (SELECT * FROM cur WHERE browser = 'Firefox'), q AS (SELECT * FROM cur SEMI JOIN f USING (site_id, session_hash)),
    t AS (SELECT site_id, count(DISTINCT visitor_hash) AS total_visitors FROM f GROUP BY 1),
    c AS (SELECT site_id, 'entry_page' AS dimension, path AS value, any_value(k) AS k, count(DISTINCT visitor_hash) AS visitors, {PAGES} AS volume,
      any_value(total_visitors) AS total_visitors FROM q JOIN t USING (site_id) WHERE is_entry GROUP BY 1, 2, 3), {ranked_sql('c', 'site_id, dimension', 10)}""",
)
def entry_pages_filtered(spark, sf_dir):
    return reports.breakdown(scope(spark, sf_dir), "entry_page", {"browser": "Firefox"})


@query(
    "property_breakdown",
    f"""WITH {scope_sql()}, c AS (SELECT site_id, 'k' AS key, prop_k AS value, any_value(k) AS k, count(DISTINCT visitor_hash) AS visitors, count(*) AS volume, 0 AS total_visitors
      FROM cur WHERE prop_k IS NOT NULL GROUP BY 1, 2, 3), {ranked_sql('c', 'site_id, key', 10).replace('percentage, rank', 'p, rank')}
    """.replace("SELECT site_id, key, value, visitors", "SELECT site_id, key, 1 AS key_rank, value, visitors").replace(
        f", {PCT.format(v='visitors', w='total_visitors')} AS p", ""
    ),
)
def property_breakdown(spark, sf_dir):
    return reports.property_breakdown(scope(spark, sf_dir))


@query("known_values", panels_sql(["page", "event"], "true", PAGES, 250))
def known_values(spark, sf_dir):
    return reports.known_values(scope(spark, sf_dir))


def summary_sql(preset: str, where: str, volume: str, qualify: bool) -> str:
    scope_q = "SELECT * FROM sc SEMI JOIN (SELECT DISTINCT site_id, session_hash, win FROM sc WHERE " + where + ") USING (site_id, session_hash, win)" if qualify else "SELECT * FROM sc"
    return f"""WITH {scope_sql(preset)}, q AS ({scope_q}),
    t AS (SELECT site_id, win, {volume} AS volume, count(DISTINCT visitor_hash) AS visitors FROM sc WHERE {where} GROUP BY 1, 2),
    s AS (SELECT site_id, win, session_hash, {PAGES} AS pv, epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)) AS us FROM q GROUP BY 1, 2, 3),
    m AS (SELECT site_id, win, count(*) AS sessions, count(*) FILTER (pv <= 1) AS bounces, floor(sum(us)::DOUBLE / count(*) / 1e6 + 0.5)::BIGINT AS avg_duration FROM s GROUP BY 1, 2),
    z AS (SELECT site_id, w.win FROM sites, (VALUES ('cur'), ('prev')) w(win)), r AS (
    SELECT site_id, win AS "window", coalesce(volume, 0) AS volume, coalesce(visitors, 0) AS visitors, coalesce(sessions, 0) AS sessions, coalesce(bounces, 0) AS bounces,
      coalesce(avg_duration, 0) AS avg_duration FROM z LEFT JOIN t USING (site_id, win) LEFT JOIN m USING (site_id, win))
    SELECT *, {PCT.format(v='bounces', w='sessions')} AS bounce_rate, CASE WHEN sessions > 0 THEN ((200 * volume + sessions) // (2 * sessions)) / 100.0 ELSE 0.0 END AS views_per_visit FROM r"""


@query("summary_7d", summary_sql("7d", "true", PAGES, False))
def summary_7d(spark, sf_dir):
    return reports.summary(scope(spark, sf_dir, "7d", True), bounds(spark, "7d"))


@query("summary_30d", summary_sql("30d", "true", PAGES, False))
def summary_30d(spark, sf_dir):
    return reports.summary(scope(spark, sf_dir, "30d", True), bounds(spark, "30d"))


@query("summary_filtered", summary_sql("7d", "country_code = 'DE'", PAGES, True))
def summary_filtered(spark, sf_dir):
    return reports.summary(scope(spark, sf_dir, "7d", True), bounds(spark, "7d"), {"country": "DE"})


@query("summary_event_filter", summary_sql("7d", "event_name = 'Signup'", ALL, True))
def summary_event_filter(spark, sf_dir):
    return reports.summary(scope(spark, sf_dir, "7d", True), bounds(spark, "7d"), EVENT_FILTER)


_CHANGES = ["volume", "visitors", "sessions", "bounce_rate", "avg_duration", "views_per_visit"]


def compared_sql(where: str, qualify: bool) -> str:
    return f"""WITH r AS ({summary_sql('7d', where, PAGES, qualify)}), w AS (SELECT site_id, {', '.join(f'''max({m}) FILTER ("window" = '{s}') AS {s}_{m}''' for s in ('cur', 'prev') for m in _CHANGES)} FROM r GROUP BY 1)
    SELECT site_id, {', '.join(f'cur_{m} AS {m}' for m in _CHANGES)}, {', '.join(f'CASE WHEN prev_{m} <> 0 THEN round((cur_{m} - prev_{m}) * 100.0 / prev_{m}, 1) END AS change_{m}' for m in _CHANGES)} FROM w"""


@query("summary_compared", compared_sql("true", False))
def summary_compared(spark, sf_dir):
    return reports.compared(summary_7d(spark, sf_dir))


def series_sql(preset: str, unit: str, where: str, volume: str) -> str:
    local = "((occurred_at AT TIME ZONE 'UTC') AT TIME ZONE timezone)"
    return f"""WITH {scope_sql(preset)}, c AS (SELECT site_id, date_trunc('{unit}', {local}) AS bucket, count(DISTINCT visitor_hash) AS visitors, {volume} AS volume FROM cur WHERE {where} GROUP BY 1, 2),
    g AS (SELECT site_id, unnest(generate_series(date_trunc('{unit}', ((from_ts AT TIME ZONE 'UTC') AT TIME ZONE timezone)), ((to_ts AT TIME ZONE 'UTC') AT TIME ZONE timezone) - INTERVAL 1 SECOND, INTERVAL 1 {unit})) AS bucket FROM bounds)
    SELECT site_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, coalesce(visitors, 0) AS visitors, coalesce(volume, 0) AS volume FROM g LEFT JOIN c USING (site_id, bucket)"""


def _series(spark, sf_dir, preset, unit, filters=None):
    out = reports.timeseries(scope(spark, sf_dir, preset), bounds(spark, preset), unit, filters)
    return out.select("site_id", stamp("bucket"), "visitors", "volume")


@query("timeseries_daily", series_sql("30d", "day", "true", PAGES))
def timeseries_daily(spark, sf_dir):
    return _series(spark, sf_dir, "30d", "day")


@query("timeseries_weekly_filtered", series_sql("30d", "week", "event_name = 'Signup'", ALL))
def timeseries_weekly_filtered(spark, sf_dir):
    return _series(spark, sf_dir, "30d", "week", EVENT_FILTER)


@query("timeseries_hourly", series_sql("today", "hour", "true", PAGES))
def timeseries_hourly(spark, sf_dir):
    return _series(spark, sf_dir, "today", "hour")


@query("realtime", f"WITH {CTES} SELECT site_id, count(DISTINCT visitor_hash) AS visitors FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3600 SECOND GROUP BY 1")
def realtime(spark, sf_dir):
    return reports.realtime(adapter.events(spark, sf_dir), NOW, 3600)


_HOURLY = f"""SELECT date_trunc('hour', occurred_at) AS bucket, site_id, {PAGES} AS pageviews, count(*) FILTER (event_name <> 'pageview') AS custom_events, count(DISTINCT visitor_hash) AS visitors,
  count(DISTINCT session_hash) AS sessions, count(*) FILTER (is_entry) AS entries, coalesce(sum(revenue_cents), 0)::BIGINT AS revenue_cents FROM ev GROUP BY 1, 2"""
_TEXT = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query("rollup_hourly", f"WITH {CTES}, r AS ({_HOURLY}) SELECT * REPLACE ({_TEXT.format(c='bucket')}) FROM r")
def rollup_hourly(spark, sf_dir):
    return rollups.hourly(adapter.events(spark, sf_dir)).withColumn("bucket", stamp("bucket"))


@query(
    "rollup_visitor_days",
    f"""WITH {CTES} SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d %H:%M:%S') AS bucket, site_id, visitor_hash, count(*) AS events, {PAGES} AS pageviews,
    strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM ev GROUP BY date_trunc('day', occurred_at), site_id, visitor_hash""",
)
def rollup_visitor_days(spark, sf_dir):
    out = rollups.visitor_days(adapter.events(spark, sf_dir))
    return out.withColumns({c: stamp(c) for c in ("bucket", "first_seen", "last_seen")})


@query(
    "rollup_session_days",
    f"""WITH {CTES} SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d %H:%M:%S') AS bucket, site_id, session_hash, {PAGES} AS pageviews,
    strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS ended_at FROM ev GROUP BY date_trunc('day', occurred_at), site_id, session_hash""",
)
def rollup_session_days(spark, sf_dir):
    out = rollups.session_days(adapter.events(spark, sf_dir))
    return out.withColumns({c: stamp(c) for c in ("bucket", "started_at", "ended_at")})


_UTC_WEEK = "SELECT site_id, TIMESTAMP '2024-01-08' AS from_ts, TIMESTAMP '2024-01-22' AS to_ts FROM sites"


def utc_bounds(spark: SparkSession) -> DataFrame:
    return adapter.sites(spark).withColumn("from_ts", F.expr("timestamp '2024-01-08'")).withColumn("to_ts", F.expr("timestamp '2024-01-22'"))


@query(
    "summary_from_rollups",
    f"""WITH {CTES}, b AS ({_UTC_WEEK}), e AS (SELECT ev.* FROM ev JOIN b USING (site_id) WHERE occurred_at >= from_ts AND occurred_at < to_ts),
    s AS (SELECT site_id, session_hash, {PAGES} AS pv, epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)) AS us FROM e GROUP BY 1, 2),
    m AS (SELECT site_id, count(*) AS sessions, count(*) FILTER (pv <= 1) AS bounces, floor(sum(us)::DOUBLE / count(*) / 1e6 + 0.5)::BIGINT AS avg_duration FROM s GROUP BY 1),
    t AS (SELECT site_id, {PAGES} AS volume, count(DISTINCT visitor_hash) AS visitors FROM e GROUP BY 1)
    SELECT *, {PCT.format(v='bounces', w='sessions')} AS bounce_rate FROM t JOIN m USING (site_id)""",
)
def summary_from_rollups(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    return rollups.summary_from_rollups(rollups.hourly(ev), rollups.visitor_days(ev), rollups.session_days(ev), utc_bounds(spark))


@query(
    "timeseries_from_rollups",
    f"""WITH {CTES}, b AS ({_UTC_WEEK}) SELECT site_id, strftime(date_trunc('week', occurred_at), '%Y-%m-%d %H:%M:%S') AS bucket, count(DISTINCT visitor_hash) AS visitors, {PAGES} AS volume
    FROM ev JOIN b USING (site_id) WHERE occurred_at >= from_ts AND occurred_at < to_ts GROUP BY site_id, date_trunc('week', occurred_at)""",
)
def timeseries_from_rollups(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    return rollups.daily_series(rollups.hourly(ev), rollups.visitor_days(ev), utc_bounds(spark), "week").withColumn("bucket", stamp("bucket"))


@query(
    "timeseries_hourly_from_rollup",
    f"""WITH {CTES}, h AS ({_HOURLY}), b AS ({_UTC_WEEK}) SELECT site_id, {_TEXT.format(c='bucket')}, visitors, pageviews AS volume FROM h JOIN b USING (site_id) WHERE bucket >= from_ts AND bucket < to_ts""",
)
def timeseries_hourly_from_rollup(spark, sf_dir):
    return rollups.hourly_series(rollups.hourly(adapter.events(spark, sf_dir)), utc_bounds(spark)).withColumn("bucket", stamp("bucket"))


@query(
    "site_totals",
    f"""WITH {CTES}, h AS ({_HOURLY}), t AS (SELECT site_id, sum(pageviews)::BIGINT AS pageviews, sum(custom_events)::BIGINT AS custom_events, sum(entries)::BIGINT AS visits FROM h GROUP BY 1)
    SELECT * FROM t UNION ALL SELECT NULL, sum(pageviews)::BIGINT, sum(custom_events)::BIGINT, sum(visits)::BIGINT FROM t""",
)
def site_totals(spark, sf_dir):
    return rollups.site_totals(rollups.hourly(adapter.events(spark, sf_dir)), adapter.sites(spark))


@query("visitors_rollup_first", f"WITH {scope_sql('7d')} SELECT site_id, count(DISTINCT visitor_hash) AS visitors FROM cur GROUP BY 1")
def visitors_rollup_first(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    return rollups.visitors_rollup_first(ev, rollups.visitor_days(ev), bounds(spark, "7d"))


@query(
    "rollup_drift",
    f"WITH {CTES} SELECT site_id, date_trunc('day', occurred_at)::DATE AS day, 'only_raw' AS side, count(DISTINCT visitor_hash) AS n FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3",
)
def rollup_drift(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    stale = rollups.visitor_days(ev.where("occurred_at < timestamp '2024-01-29'"))
    return rollups.drift(stale, rollups.visitor_days(ev))


@query("rollup_live", f"WITH {CTES}, h AS ({_HOURLY}) SELECT * REPLACE ({_TEXT.format(c='bucket')}) FROM h")
def rollup_live(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    mark = datetime(2024, 1, 25)
    return rollups.live(rollups.hourly(ev), ev, mark, rollups.hourly).withColumn("bucket", stamp("bucket"))
