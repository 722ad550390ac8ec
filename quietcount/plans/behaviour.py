"""Registered queries on sequences, goals, dashboards and metering, and their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.functions.matchers import Matcher
from quietcount.functions.period import widest
from quietcount.operators import goals, metering, reports, rollups, sequences
from quietcount.plans.traffic import _CHANGES, _HOURLY, NOW, PAGES, PCT, bounds, compared_sql, panels_sql, scope, scope_sql, series_sql, stamp
from quietcount.plans.traffic import ORACLES as ORACLES_OF_TRAFFIC
from quietcount.sources import adapter
from quietcount.sources.adapter import CTES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FUNNEL = sequences.Funnel(
    1,
    ((Matcher("pageview", "prefix", "/p/1"),), (Matcher("event", "exact", "Signup"), Matcher("event", "exact", "Error")), (Matcher("pageview", "wildcard", "/p/*"),)),
    7_200,
)
SHORT = sequences.Funnel(2, ((Matcher("pageview", "exact", "/p/2"),),), 3_600)
LONG = sequences.Funnel(3, ((Matcher("pageview", "exact", "/p/2"),), (Matcher("event", "prefix", "Pur"),)), 200_000)
_MASKS = ["event_name = 'pageview' AND starts_with(path, '/p/1')", "event_name IN ('Signup', 'Error')", "event_name = 'pageview' AND regexp_full_match(path, '/p/[^/]*')"]


def chain_sql(masks: list[str], window: int, where: str = "true") -> str:
    out = f"j0 AS (SELECT site_id, visitor_hash, min(occurred_at) AS t FROM cur WHERE {masks[0]} AND {where} GROUP BY 1, 2)"
    for i, m in enumerate(masks[1:], 1):
        out += f""", j{i} AS (SELECT e.site_id, e.visitor_hash, min(e.occurred_at) AS t FROM ev e JOIN j{i - 1} p USING (site_id, visitor_hash)
          WHERE {m} AND e.occurred_at >= p.t AND e.occurred_at <= p.t + INTERVAL {window} SECOND GROUP BY 1, 2)"""
    counts = " UNION ALL ".join(f"SELECT s.site_id, {i} AS step, count(p.visitor_hash) AS visitors FROM (SELECT DISTINCT site_id FROM j0) s LEFT JOIN j{i} p USING (site_id) GROUP BY 1" for i in range(len(masks)))
    return f"{out}, counts AS ({counts})"


_REPORT = f"""SELECT site_id, step, visitors, {PCT.format(v='visitors', w='e')} AS conversion, coalesce(b - visitors, 0) AS dropped,
  CASE WHEN b IS NULL THEN 0.0 ELSE {PCT.format(v='(b - visitors)', w='b')} END AS drop_off, {PCT.format(v='l', w='e')} AS overall
  FROM (SELECT *, first_value(visitors) OVER w AS e, lag(visitors) OVER w AS b, last_value(visitors) OVER (PARTITION BY site_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM counts WINDOW w AS (PARTITION BY site_id ORDER BY step))"""


@query("funnel_ordered", f"WITH {scope_sql()}, {chain_sql(_MASKS, 7200)} {_REPORT}")
def funnel_ordered(spark, sf_dir):
    return sequences.funnel_report(sequences.funnel_counts(adapter.events(spark, sf_dir), scope(spark, sf_dir), FUNNEL, period=widest("30d", NOW)))


@query("funnel_filtered", f"WITH {scope_sql('7d')}, {chain_sql(_MASKS, 7200, chr(39).join(['browser = ', 'Firefox', '']))} {_REPORT}")
def funnel_filtered(spark, sf_dir):
    return sequences.funnel_report(sequences.funnel_counts(adapter.events(spark, sf_dir), scope(spark, sf_dir, "7d"), FUNNEL, {"browser": "Firefox"}, period=widest("7d", NOW)))


@query("funnel_by_joins", f"WITH {scope_sql()}, {chain_sql(_MASKS, 7200)} SELECT * FROM counts")
def funnel_by_joins(spark, sf_dir):
    return sequences.funnel_counts_by_joins(adapter.events(spark, sf_dir), scope(spark, sf_dir), FUNNEL)


def _summary_sql(fid: int, masks: list[str], window: int, long: bool) -> str:
    return f"""(WITH {chain_sql(masks, window)} SELECT s.site_id, {fid} AS funnel_id, true AS valid, {str(long).lower()} AS exceeds_identity, coalesce(a.visitors, 0) AS entered, coalesce(b.visitors, 0) AS completed,
      {PCT.format(v='coalesce(b.visitors, 0)', w='coalesce(a.visitors, 0)')} AS rate FROM sites s LEFT JOIN counts a ON a.site_id = s.site_id AND a.step = 0 LEFT JOIN counts b ON b.site_id = s.site_id AND b.step = {len(masks) - 1})"""


@query(
    "funnel_summaries",
    f"""WITH {scope_sql()} SELECT * FROM {_summary_sql(1, _MASKS, 7200, False)} UNION ALL
    SELECT site_id, 2, false, false, NULL, NULL, NULL FROM sites UNION ALL
    SELECT * FROM {_summary_sql(3, ["event_name = 'pageview' AND path = '/p/2'", "event_name <> 'pageview' AND starts_with(event_name, 'Pur')"], 200000, True)}""",
)
def funnel_summaries(spark, sf_dir):
    return sequences.funnel_summaries_at_once(adapter.events(spark, sf_dir), bounds(spark), [FUNNEL, SHORT, LONG], widest("30d", NOW))


@query("funnel_summaries_one_by_one", ORACLES["funnel_summaries"])
def funnel_summaries_one_by_one(spark, sf_dir):
    return sequences.funnel_summaries(adapter.events(spark, sf_dir), scope(spark, sf_dir), adapter.sites(spark), [FUNNEL, SHORT, LONG], widest("30d", NOW))


def steps_sql(events: bool, rows: str = "cur") -> str:
    order = "PARTITION BY site_id, session_hash ORDER BY occurred_at, kind DESC, value, visitor_hash"
    return f"""lab AS (SELECT site_id, k, session_hash, visitor_hash, occurred_at, CASE WHEN event_name = 'pageview' THEN 'pageview' ELSE 'event' END AS kind,
      CASE WHEN event_name = 'pageview' THEN path ELSE event_name END AS value FROM {rows} {'' if events else "WHERE event_name = 'pageview'"}),
    chg AS (SELECT *, lag(kind) OVER ({order}) AS pk, lag(value) OVER ({order}) AS pv FROM lab),
    stp AS (SELECT site_id, k, session_hash, visitor_hash, kind, value, row_number() OVER ({order}) AS n FROM chg WHERE pk IS DISTINCT FROM kind OR pv IS DISTINCT FROM value)"""


def flow_sql(prefix: list[tuple[str, str]], backward: bool = False, limit: int = 8, level: int | None = None) -> str:
    size, w = len(prefix), "PARTITION BY site_id, session_hash ORDER BY n"
    leads = ", ".join(f"lead(kind, {i}) OVER ({w}) AS k{i}, lead(value, {i}) OVER ({w}) AS v{i}" for i in range(1, size + 1))
    back = f", lag(kind) OVER ({w}) AS k0, lag(value) OVER ({w}) AS v0"
    tests = " AND ".join([f"k{i} = '{k}' AND v{i} = '{v}'" for i, (k, v) in enumerate(prefix) if i] or ["true"])
    at, ties = (0 if backward else size), "sessions DESC, value NULLS LAST, kind NULLS LAST"
    return f"""(WITH l AS (SELECT *, {leads}{back} FROM stp), a AS (SELECT * FROM l WHERE kind = '{prefix[0][0]}' AND value = '{prefix[0][1]}' QUALIFY row_number() OVER ({w}) = 1),
      m AS (SELECT * FROM a WHERE {tests}), t AS (SELECT site_id, count(DISTINCT visitor_hash) AS total FROM m GROUP BY 1),
      b AS (SELECT site_id, k, k{at} AS kind, v{at} AS value, count(DISTINCT visitor_hash) AS visitors, count(*) AS sessions, any_value(total) AS total FROM m JOIN t USING (site_id) GROUP BY 1, 2, 3, 4),
      s1 AS (SELECT *, visitors < k AS small, count(*) FILTER (visitors < k) OVER (PARTITION BY site_id) AS ns FROM b),
      s2 AS (SELECT *, small OR (ns = 1 AND row_number() OVER (PARTITION BY site_id ORDER BY small, visitors, {ties}) = 1) AS withheld FROM s1),
      s3 AS (SELECT *, count(*) FILTER (withheld) OVER (PARTITION BY site_id) AS withheld_rows, coalesce(sum(visitors) FILTER (withheld) OVER (PARTITION BY site_id), 0)::BIGINT AS withheld_visitors FROM s2),
      s4 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY visitors DESC, {ties}) AS rank FROM s3 WHERE NOT withheld)
      SELECT site_id, kind, value, visitors, sessions, total, {PCT.format(v='visitors', w='total')} AS percentage, rank, withheld_rows, withheld_visitors{'' if level is None else f', {level} AS level'} FROM s4 WHERE rank <= {limit})"""


PATH = [("pageview", "/p/3"), ("pageview", "/p/5")]


@query("page_flow_forward", f"WITH {scope_sql()}, {steps_sql(False)} SELECT * FROM {flow_sql(PATH[:1])}")
def page_flow_forward(spark, sf_dir):
    return sequences.flow(sequences.steps(scope(spark, sf_dir)), PATH[:1])


@query("page_flow_backward", f"WITH {scope_sql()}, {steps_sql(True)} SELECT * FROM {flow_sql(PATH[:1], True)}")
def page_flow_backward(spark, sf_dir):
    return sequences.flow(sequences.steps(scope(spark, sf_dir), True), PATH[:1], "backward")


@query(
    "page_flow_filtered",
    f"""WITH {scope_sql()}, q AS (SELECT * FROM cur SEMI JOIN (SELECT site_id, session_hash FROM cur WHERE country_code = 'DE') USING (site_id, session_hash)), {steps_sql(True, 'q')} SELECT * FROM {flow_sql(PATH[:1])}""",
)
def page_flow_filtered(spark, sf_dir):
    return sequences.flow(sequences.steps(scope(spark, sf_dir), True, {"country": "DE"}), PATH[:1])


@query("journey", f"WITH {scope_sql()}, {steps_sql(False)} SELECT * FROM {flow_sql(PATH[:1], level=1)} UNION ALL SELECT * FROM {flow_sql(PATH, level=2)}")
def journey(spark, sf_dir):
    return sequences.journey(sequences.steps(scope(spark, sf_dir)), PATH)


_TOP = panels_sql(["entry_page"], "true", PAGES, 1).removeprefix(f"WITH {scope_sql()}, ")
_FROM_TOP = flow_sql([("pageview", "@")], level=1).replace("value = '@'", "value = (SELECT tp.value FROM tp WHERE tp.site_id = l.site_id)")


@query("journey_default", f"WITH {scope_sql()}, {steps_sql(False)}, tp AS (WITH {_TOP}) SELECT * FROM {_FROM_TOP}")
def journey_default(spark, sf_dir):
    return sequences.default_journey(scope(spark, sf_dir))


GOALS = [
    goals.Goal(1, Matcher("pageview", "exact", "/p/4")),
    goals.Goal(2, Matcher("event", "exact", "Purchase")),
    goals.Goal(3, Matcher("event", "prefix", "S")),
    goals.Goal(4, Matcher("pageview", "wildcard", "/*/1*")),
]
_GOAL_SQL = {
    1: "event_name = 'pageview' AND path = '/p/4'", 2: "event_name = 'Purchase'", 3: "event_name <> 'pageview' AND starts_with(event_name, 'S')",
    4: "event_name = 'pageview' AND regexp_full_match(path, '/[^/]*/1[^/]*')",
}


def goals_sql(ids: list[int], where: str) -> str:
    hits = " UNION ALL ".join(f"SELECT site_id, {i} AS goal_id, visitor_hash, currency, revenue_cents FROM gf WHERE {_GOAL_SQL[i]}" for i in ids)
    return f"""gf AS (SELECT * FROM cur WHERE {where}), gt AS (SELECT site_id, count(DISTINCT visitor_hash) AS total FROM gf GROUP BY 1), gh AS ({hits}),
    gc AS (SELECT site_id, goal_id, count(*) AS conversions, count(DISTINCT visitor_hash) AS visitors FROM gh GROUP BY 1, 2),
    gm AS (SELECT site_id, goal_id, currency, sum(revenue_cents)::BIGINT AS cents FROM gh WHERE coalesce(currency, '') <> '' GROUP BY 1, 2, 3 HAVING sum(revenue_cents) > 0),
    gr AS (SELECT site_id, goal_id, string_agg(currency || ':' || cents, ',' ORDER BY currency) AS revenue FROM gm GROUP BY 1, 2),
    gg AS (SELECT site_id, goal_id, coalesce(conversions, 0) AS conversions, coalesce(visitors, 0) AS visitors, {PCT.format(v='coalesce(visitors, 0)', w='total')} AS conversion_rate, coalesce(revenue, '') AS revenue
      FROM gt CROSS JOIN (SELECT unnest({ids}) AS goal_id) LEFT JOIN gc USING (site_id, goal_id) LEFT JOIN gr USING (site_id, goal_id))"""


@query("goal_report", f"WITH {scope_sql()}, {goals_sql([1, 2, 3, 4], 'true')} SELECT * FROM gg")
def goal_report(spark, sf_dir):
    return goals.goal_report(scope(spark, sf_dir), GOALS)


@query("goal_report_event_filter", f"WITH {scope_sql()}, {goals_sql([3], chr(39).join(['event_name = ', 'Signup', '']))} SELECT * FROM gg")
def goal_report_event_filter(spark, sf_dir):
    return goals.goal_report(scope(spark, sf_dir), GOALS, {"event": "Signup"})


def json_sql(part: str, rows: str, **columns: str) -> str:
    """Rows of a query as JSON objects, as Spark writes them: nulls are left out. columns: number, text or time of each, in order."""
    form = {"number": "{c}::VARCHAR", "text": "'\"' || {c} || '\"'", "time": "'\"' || replace({c}, ' ', 'T') || '.000Z\"'"}
    cells = ", ".join(f"CASE WHEN \"{c}\" IS NOT NULL THEN '\"{c}\":' || {form[kind].format(c=chr(34) + c + chr(34))} END" for c, kind in columns.items())
    return f"SELECT '{part}' AS part, '{{' || concat_ws(',', {cells}) || '}}' AS \"row\" FROM ({rows})"


_ON_PAGE = "path = '/p/3'"
_SHOWN = dict(site_id="number", dimension="text", value="text", visitors="number", volume="number", percentage="number", rank="number", withheld_rows="number", withheld_visitors="number")
_DASHBOARD = " UNION ALL ".join((
    json_sql("summary", compared_sql(_ON_PAGE, True), site_id="number", **{m: "number" for m in _CHANGES}, **{f"change_{m}": "number" for m in _CHANGES}),
    json_sql("timeseries", series_sql("7d", "day", _ON_PAGE, PAGES), site_id="number", bucket="time", visitors="number", volume="number"),
    json_sql("panels", panels_sql(goals.PANELS, _ON_PAGE, PAGES, 10, "7d"), **_SHOWN),
    json_sql("events", panels_sql(["event"], _ON_PAGE, PAGES, 10, "7d"), **_SHOWN),
    json_sql("goals", f"WITH {scope_sql('7d')}, {goals_sql([1, 2, 3, 4], _ON_PAGE)} SELECT * FROM gg", site_id="number", goal_id="number", conversions="number", visitors="number", conversion_rate="number", revenue="text"),
    json_sql("realtime", ORACLES_OF_TRAFFIC["realtime"], site_id="number", visitors="number"),
    json_sql(
        "next_steps", f"WITH {scope_sql('7d')}, q AS (SELECT * FROM cur SEMI JOIN (SELECT site_id, session_hash FROM cur WHERE {_ON_PAGE}) USING (site_id, session_hash)), {steps_sql(True, 'q')} SELECT * FROM {flow_sql(PATH[:1])}",
        site_id="number", kind="text", value="text", visitors="number", sessions="number", total="number", percentage="number", rank="number", withheld_rows="number", withheld_visitors="number",
    ),
))


@query("dashboard_default", _DASHBOARD)
def dashboard_default(spark, sf_dir):
    parts = goals.dashboard(
        scope(spark, sf_dir, "7d", True), bounds(spark, "7d"), GOALS, {"page": "/p/3"}, "day", reports.realtime(adapter.events(spark, sf_dir), NOW, 3_600)
    )
    rows = [df.select(F.lit(k).alias("part"), F.to_json(F.struct(*df.columns)).alias("row")) for k, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, rows)


WIDGETS = [
    goals.Widget(1, "stat"), goals.Widget(2, "breakdown", "page"), goals.Widget(3, "breakdown", "country", {}, 3), goals.Widget(4, "goals", row_limit=2),
    goals.Widget(5, "stat", filters={"country": "DE"}), goals.Widget(6, "breakdown", "nothing"),
    goals.Widget(7, "timeseries"), goals.Widget(8, "funnel", funnel=FUNNEL), goals.Widget(9, "funnel"), goals.Widget(10, "funnel", funnel=SHORT),
]


@query(
    "dashboard_saved",
    f"""WITH {scope_sql('7d')}, {chain_sql(_MASKS, 7200)}, {goals_sql([1, 2, 3, 4], 'true')}, p AS (SELECT * FROM ({panels_sql(['page', 'country'], 'true', PAGES, 5, '7d')})), n AS (SELECT NULL::BIGINT AS x)
    SELECT 2 AS widget_id, 'ok' AS status, site_id, value AS label, visitors, volume FROM p WHERE dimension = 'page' UNION ALL
    SELECT 3, 'ok', site_id, value, visitors, volume FROM p WHERE dimension = 'country' AND rank <= 3 UNION ALL
    SELECT 1, 'ok', site_id, NULL, count(DISTINCT visitor_hash), {PAGES} FROM cur GROUP BY site_id UNION ALL
    SELECT 5, 'ok', site_id, NULL, count(DISTINCT visitor_hash), {PAGES} FROM cur WHERE country_code = 'DE' GROUP BY site_id UNION ALL
    SELECT 4, 'ok', site_id, goal_id::VARCHAR, visitors, conversions FROM (SELECT * FROM gg QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY visitors DESC, goal_id) <= 2) UNION ALL
    SELECT 7, 'ok', site_id, bucket, visitors, volume FROM ({series_sql('7d', 'day', 'true', PAGES)}) UNION ALL
    SELECT 8, 'ok', site_id, step::VARCHAR, visitors, dropped FROM ({_REPORT}) UNION ALL
    SELECT DISTINCT 9, 'missing_funnel', site_id, NULL, NULL::BIGINT, NULL::BIGINT FROM cur UNION ALL
    SELECT DISTINCT i, 'invalid', site_id, NULL, NULL::BIGINT, NULL::BIGINT FROM cur, (VALUES (6), (10)) t(i)""",
)
def dashboard_saved(spark, sf_dir):
    return goals.saved_dashboard(scope(spark, sf_dir, "7d"), WIDGETS, GOALS, bounds(spark, "7d"), adapter.events(spark, sf_dir))


_STATS = [goals.Widget(1, "stat"), goals.Widget(5, "stat", filters={"country": "DE"}), goals.Widget(6, "stat", filters={"country": "DE", "unknown": "x"}), goals.Widget(2, "breakdown", "page")]


@query(
    "dashboard_stats",
    " UNION ALL ".join(f"SELECT {i} AS widget_id, * FROM ({sql})" for i, sql in ((1, compared_sql("true", False)), (5, compared_sql("country_code = 'DE'", True)), (6, compared_sql("country_code = 'DE'", True)))),
)
def dashboard_stats(spark, sf_dir):
    return goals.stat_widgets(scope(spark, sf_dir, "7d", True), _STATS, bounds(spark, "7d"))


_USED = f"h AS ({_HOURLY}), u AS (SELECT account_id, strftime(bucket, '%Y-%m') AS month, sum(pageviews + custom_events)::BIGINT AS used FROM h JOIN sites USING (site_id) GROUP BY 1, 2)"
_SNAP = """sn AS (SELECT account_id, month, used, monthly_event_limit::BIGINT AS monthly_event_limit,
  CASE WHEN monthly_event_limit > 0 THEN floor(least(used / monthly_event_limit, 1.0) * 100)::BIGINT END AS percent, coalesce(used > monthly_event_limit, false) AS exceeded,
  coalesce(used / monthly_event_limit >= 0.8 AND used <= monthly_event_limit, false) AS approaching,
  CASE WHEN monthly_event_limit IS NULL THEN 0 ELSE greatest(used - monthly_event_limit, 0) END AS refused,
  CASE WHEN monthly_event_limit IS NULL THEN 0 ELSE greatest(monthly_event_limit - used, 0) END AS remaining, 2 AS days_to_reset FROM u JOIN accounts USING (account_id))"""


def _usage(spark, sf_dir):
    return metering.usage(rollups.hourly(adapter.events(spark, sf_dir)), adapter.sites(spark))


@query("usage_by_account", f"WITH {CTES}, {_USED} SELECT * FROM u")
def usage_by_account(spark, sf_dir):
    return _usage(spark, sf_dir)


@query("usage_snapshot", f"WITH {CTES}, {_USED}, {_SNAP} SELECT * FROM sn")
def usage_snapshot(spark, sf_dir):
    return metering.snapshot(_usage(spark, sf_dir), adapter.accounts(spark), NOW)


@query("usage_notices", f"WITH {CTES}, {_USED}, {_SNAP} SELECT account_id, month, 'exceeded' AS level FROM sn WHERE exceeded UNION ALL SELECT account_id, month, 'approaching' FROM sn WHERE approaching")
def usage_notices(spark, sf_dir):
    sent = spark.sql("SELECT * FROM VALUES (9L, '2024-01', 'exceeded') AS t(account_id, month, level)")
    return metering.notices(usage_snapshot(spark, sf_dir), sent)


@query("usage_repair", f"WITH {CTES}, {_USED} SELECT account_id, month, greatest(greatest(coalesce(c.used, 0), u.used) - CASE account_id WHEN 2 THEN 100 ELSE 0 END, 0) AS used FROM u LEFT JOIN (VALUES (1, '2024-01', 10)) c(account_id, month, used) USING (account_id, month)")
def usage_repair(spark, sf_dir):
    counters = spark.sql("SELECT * FROM VALUES (1L, '2024-01', 10L) AS t(account_id, month, used)")
    credits = spark.sql("SELECT * FROM VALUES (2L, '2024-01', 100L) AS t(account_id, month, credit)")
    return metering.repaired(counters, _usage(spark, sf_dir), credits)


@query(
    "event_quota",
    f"""WITH {CTES} SELECT event_id, account_id, row_number() OVER (PARTITION BY account_id, date_trunc('month', occurred_at) ORDER BY occurred_at, event_id) AS seq,
    coalesce(row_number() OVER (PARTITION BY account_id, date_trunc('month', occurred_at) ORDER BY occurred_at, event_id) > monthly_event_limit, false) AS refused FROM ev JOIN sites USING (site_id) JOIN accounts USING (account_id)""",
)
def event_quota(spark, sf_dir):
    return metering.over_quota(adapter.events(spark, sf_dir), adapter.sites(spark), adapter.accounts(spark))


@query("opt_outs_hourly", f"WITH {CTES} SELECT site_id, strftime(date_trunc('hour', occurred_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM ev WHERE event_id % 7 = 0 AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-25' GROUP BY site_id, date_trunc('hour', occurred_at)")
def opt_outs_hourly(spark, sf_dir):
    requests = adapter.events(spark, sf_dir).withColumn("opted_out", F.col("event_id") % 7 == 0)
    return metering.opt_outs(requests, datetime(2024, 1, 5), datetime(2024, 1, 25)).withColumn("hour", stamp("hour"))


@query("first_events", f"WITH {CTES}, s AS (SELECT site_id FROM sites UNION ALL SELECT 99) SELECT s.site_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_event_at FROM s LEFT JOIN ev USING (site_id) GROUP BY 1")
def first_events(spark, sf_dir):
    listed = adapter.sites(spark).select("site_id").union(spark.sql("SELECT 99L"))
    return metering.first_events(adapter.events(spark, sf_dir), listed).withColumn("first_event_at", stamp("first_event_at"))


@query("instance_events_24h", f"WITH {CTES} SELECT count(*) AS events FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-29 12:00:00'")
def instance_events_24h(spark, sf_dir):
    return metering.recent_total(adapter.events(spark, sf_dir), NOW)
