"""Registered queries on stored tables: deletes that happen, and reports that read rollups first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.functions.period import site_bounds, widest
from quietcount.operators import lifecycle, reports, rollups, routing
from quietcount.plans.intake import _CUT
from quietcount.plans.traffic import NOW, PAGES, bounds, series_sql, stamp, summary_sql
from quietcount.sources import adapter, tables
from quietcount.sources.adapter import CTES
from quietcount.sources.shared import folder, stored
from quietcount.sources.snapshots import DAY, Snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def store_of(spark, sf_dir) -> Snapshots:
    """The given events and their rollups as stored tables."""
    store = Snapshots(spark, folder(spark))
    lifecycle.loaded(store, adapter.events(spark, sf_dir))
    return store


def held(store: Snapshots) -> DataFrame:
    """What the stored events and each rollup hold, per day and site."""
    keys = [DAY, "site_id"]
    out = store.read("events").groupBy(*keys).agg(F.count("*").alias("n_events"), F.sum("event_id").alias("event_ids"))
    hours = store.read("hourly").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pageviews", "custom_events", "entries", "revenue_cents")])
    people = store.read("visitor_days").groupBy(*keys).agg(F.count("*").alias("visitors"), F.sum("events").alias("visitor_events"))
    visits = store.read("session_days").groupBy(*keys).agg(F.count("*").alias("sessions"), F.max("ended_at").alias("last_at"))
    for rollup in (hours, people, visits):
        out = out.join(rollup, keys, "full")
    return out.withColumns({DAY: F.col(DAY).cast("string"), "last_at": stamp("last_at")})


def held_sql(where: str) -> str:
    return f"""SELECT occurred_at::DATE::VARCHAR AS event_date, site_id, count(*) AS n_events, sum(event_id)::BIGINT AS event_ids, {PAGES} AS pageviews,
    count(*) FILTER (event_name <> 'pageview') AS custom_events, count(*) FILTER (is_entry) AS entries, coalesce(sum(revenue_cents), 0)::BIGINT AS revenue_cents,
    count(DISTINCT visitor_hash) AS visitors, count(*) AS visitor_events, count(DISTINCT session_hash) AS sessions, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_at
    FROM ev {where} GROUP BY occurred_at::DATE, site_id"""


@query("purge_stored", f"WITH {CTES} {held_sql('''WHERE NOT (site_id = 1 AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-09 15:00:00' AND starts_with(path, '/p/1'))''')}")
def purge_stored(spark, sf_dir):
    store = store_of(spark, sf_dir)
    lifecycle.purge_stored(store, 1, datetime(2024, 1, 3), datetime(2024, 1, 9, 15), "/p/1", now=NOW)
    return held(store)


@query("retention_stored", f"WITH {CTES}, {_CUT} {held_sql('JOIN cut USING (site_id) WHERE occurred_at >= cutoff')}")
def retention_stored(spark, sf_dir):
    store = store_of(spark, sf_dir)
    lifecycle.retention_stored(store, adapter.sites(spark), adapter.accounts(spark), NOW)
    return held(store)


@query("erasure_stored", f"WITH {CTES} {held_sql('WHERE site_id <> 2')}")
def erasure_stored(spark, sf_dir):
    store = store_of(spark, sf_dir)
    lifecycle.erase_stored(store, [2])
    return held(store)


@query(
    "backstop_stored",
    f"WITH {CTES}, h AS ({held_sql('')}) SELECT * REPLACE (" + ", ".join(f"CASE WHEN event_date >= '2024-01-20' THEN {c} END AS {c}" for c in ("n_events", "event_ids", "visitors", "visitor_events", "sessions", "last_at")) + ") FROM h WHERE event_date >= '2024-01-10'",
)
def backstop_stored(spark, sf_dir):
    store = store_of(spark, sf_dir)
    lifecycle.backstop_stored(store, NOW, {"events": 10, "hourly": 20, "visitor_days": 10, "session_days": 10})
    return held(store)


@query("summary_routed", summary_sql("30d", "true", PAGES, False))
def summary_routed(spark, sf_dir):
    """Periods of three zones, none of them whole UTC days but one."""
    ev = adapter.events(spark, sf_dir)
    return routing.summary(ev, stored(rollups.visitor_days(ev), "visitor_days"), stored(rollups.session_days(ev), "session_days"), bounds(spark))


@query("timeseries_routed", series_sql("30d", "week", "true", PAGES))
def timeseries_routed(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    out = routing.timeseries(ev, stored(rollups.visitor_days(ev), "visitor_days"), bounds(spark), "week")
    return out.select("site_id", stamp("bucket"), "visitors", "volume")


def mixed_bounds(spark) -> DataFrame:
    """Each site with a period of its own: today in hours, 30 days in days, 12 months in weeks."""
    presets = {1: "today", 2: "30d", 3: "12mo"}
    out = None
    for site, preset in presets.items():
        rows = site_bounds(adapter.sites(spark).where(F.col("site_id") == site), preset, NOW)
        out = rows if out is None else out.unionByName(rows)
    return out


_MIXED = " UNION ALL ".join(
    f"(SELECT * FROM ({series_sql(preset, unit, 'true', PAGES)}) WHERE site_id = {site})" for site, preset, unit in ((1, "today", "hour"), (2, "30d", "day"), (3, "12mo", "week"))
)


@query("timeseries_site_units", _MIXED)
def timeseries_site_units(spark, sf_dir):
    by_site = mixed_bounds(spark)
    out = reports.timeseries(reports.scoped(adapter.events(spark, sf_dir), by_site, pruned=widest("12mo", NOW)), by_site)
    return out.select("site_id", stamp("bucket"), "visitors", "volume")


@query("timeseries_routed_site_units", _MIXED)
def timeseries_routed_site_units(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    out = routing.timeseries(ev, stored(rollups.visitor_days(ev), "visitor_days"), mixed_bounds(spark))
    return out.select("site_id", stamp("bucket"), "visitors", "volume")


@query(
    "events_scanned",
    f"WITH {CTES} SELECT event_id, site_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, visitor_hash, path FROM ev WHERE site_id IN (1, 3) AND occurred_at >= TIMESTAMP '2024-01-05 06:00:00' AND occurred_at < TIMESTAMP '2024-01-08 18:00:00'",
)
def events_scanned(spark, sf_dir):
    """Events written by day and site, and read back for two sites and a range of times."""
    path = f"{folder(spark)}/events"
    ev = adapter.events(spark, sf_dir).drop("local_date")
    tables.write_events(ev, path)
    rows = tables.scan_events(spark, path, ev.schema, [1, 3], datetime(2024, 1, 5, 6), datetime(2024, 1, 8, 18))
    return rows.select("event_id", "site_id", stamp("occurred_at"), "visitor_hash", "path")


@query(
    "dead_letters",
    f"""WITH {CTES}, b AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN occurred_at END AS occurred_at, CASE WHEN event_id % 11 <> 0 THEN site_id END AS site_id,
      CASE WHEN event_id % 5 = 0 THEN lower(country_code) ELSE country_code END AS country_code, CASE WHEN event_id % 13 = 0 THEN 'US' ELSE currency END AS currency FROM ev),
    e AS (SELECT event_id, concat_ws(',', CASE WHEN occurred_at IS NULL THEN 'occurred_at' END, CASE WHEN site_id IS NULL THEN 'site_id' END,
      CASE WHEN NOT regexp_matches(country_code, '^[A-Z]{{2}}$') THEN 'country_code' END, CASE WHEN NOT regexp_matches(currency, '^[A-Z]{{3}}$') THEN 'currency' END) AS errors FROM b)
    SELECT errors, count(*) AS n, sum(event_id)::BIGINT AS event_ids FROM e GROUP BY 1""",
)
def dead_letters(spark, sf_dir):
    """Rows with faults put in, split into those that can be stored and those that can't; each row is in one table."""
    bad = lambda n: F.col("event_id") % n == 0
    rows = adapter.events(spark, sf_dir).select(
        "event_id", F.when(~bad(7), F.col("occurred_at")).alias("occurred_at"), F.when(~bad(11), F.col("site_id")).alias("site_id"),
        F.when(bad(5), F.lower("country_code")).otherwise(F.col("country_code")).alias("country_code"), F.when(bad(13), "US").otherwise(F.col("currency")).alias("currency"),
    )
    good, dead = tables.split_storable(rows, tables.row_errors())
    both = good.select("event_id", F.lit("").alias("errors")).unionByName(dead.select("event_id", F.array_join("errors", ",").alias("errors")))
    return both.groupBy("errors").agg(F.count("*").alias("n"), F.sum("event_id").alias("event_ids"))
