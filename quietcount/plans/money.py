"""Registered revenue queries and their DuckDB SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.operators import revenue
from quietcount.plans.traffic import NOW, stamp
from quietcount.sources import adapter
from quietcount.sources import revenue_adapter as money
from quietcount.sources.adapter import CTES as EVENT_CTES
from quietcount.sources.revenue_adapter import CTES
from quietcount.sources.shared import folder, stored
from quietcount.sources.snapshots import Snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


WITH = f"WITH {EVENT_CTES}, {CTES}"
_T = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def log(spark, sf_dir) -> DataFrame:
    return revenue.change_log(money.subscription_changes(money.orders(spark, sf_dir)))


def all_revenue(spark, sf_dir) -> DataFrame:
    rows = money.orders(spark, sf_dir)
    made = revenue.movements(revenue.change_log(money.subscription_changes(rows)))
    cash = revenue.cash_events(money.invoices(spark, sf_dir, rows))
    return revenue.normalised(made.unionByName(cash), adapter.sites(spark))


def last_states(changes: DataFrame) -> DataFrame:
    """The last state of each subscription; created_at is its first change."""
    w = Window.partitionBy("site_id", "subscription_id")
    last = changes.withColumn("created_at", F.min("event_at").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("event_at").desc(), F.col("event_id").desc())))
    return last.where("_r = 1").withColumn("canceled_at", F.when(F.col("status") == "canceled", F.col("event_at"))).drop("_r")


@query("subscription_mrr", f"{WITH} SELECT site_id, subscription_id, event_id, status, mrr_cents FROM slog")
def subscription_mrr(spark, sf_dir):
    return log(spark, sf_dir).select("site_id", "subscription_id", "event_id", "status", "mrr_cents")


@query("revenue_movements", f"{WITH} SELECT site_id, kind, currency, count(*) AS n, sum(amount_cents)::BIGINT AS amount_cents FROM mvd GROUP BY 1, 2, 3")
def revenue_movements(spark, sf_dir):
    return revenue.movements(log(spark, sf_dir)).groupBy("site_id", "kind", "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("amount_cents"))


@query("revenue_events", f"{WITH} SELECT site_id, customer_id, kind, amount_cents, normalized_cents, object_id, {_T.format(c='occurred_at')} FROM rev")
def revenue_events(spark, sf_dir):
    return all_revenue(spark, sf_dir).select("site_id", "customer_id", "kind", "amount_cents", "normalized_cents", "object_id", stamp("occurred_at"))


_LAST = """lst AS (SELECT *, min(event_at) OVER (PARTITION BY site_id, subscription_id) AS created_at FROM slog QUALIFY row_number() OVER (PARTITION BY site_id, subscription_id ORDER BY event_at DESC, event_id DESC) = 1),
subs AS (SELECT site_id, customer_id, coalesce(sum(mrr_cents) FILTER (status IN ('active', 'past_due')), 0)::BIGINT AS current_mrr_cents, bool_or(status IN ('trialing', 'active', 'past_due')) AS live,
  max(CASE WHEN status = 'canceled' THEN event_at END) AS canceled FROM lst GROUP BY 1, 2),
mon AS (SELECT site_id, customer_id, coalesce(sum(amount_cents) FILTER (kind IN ('payment', 'one_time', 'refund', 'dispute')), 0)::BIGINT AS lifetime_revenue_cents,
  min(occurred_at) FILTER (kind IN ('new', 'reactivation')) AS converted_at, max(occurred_at) FILTER (kind = 'churn') AS churned FROM rev GROUP BY 1, 2),
cu AS (SELECT cust.*, coalesce(current_mrr_cents, 0) AS current_mrr_cents, coalesce(lifetime_revenue_cents, 0) AS lifetime_revenue_cents, converted_at,
  CASE WHEN NOT coalesce(live, false) THEN coalesce(canceled, churned) END AS churned_at FROM cust LEFT JOIN subs USING (site_id, customer_id) LEFT JOIN mon USING (site_id, customer_id))"""


def recalculated(spark, sf_dir) -> DataFrame:
    return revenue.recalculated(money.customers(spark, sf_dir), last_states(log(spark, sf_dir)), all_revenue(spark, sf_dir))


@query("customers_recalculated", f"{WITH}, {_LAST} SELECT site_id, customer_id, current_mrr_cents, lifetime_revenue_cents, {_T.format(c='converted_at')}, {_T.format(c='churned_at')} FROM cu")
def customers_recalculated(spark, sf_dir):
    out = recalculated(spark, sf_dir)
    return out.select("site_id", "customer_id", "current_mrr_cents", "lifetime_revenue_cents", stamp("converted_at"), stamp("churned_at"))


@query(
    "customer_ranking",
    f"""{WITH}, {_LAST} SELECT site_id, customer_id, current_mrr_cents, lifetime_revenue_cents, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY current_mrr_cents DESC, lifetime_revenue_cents DESC, customer_id) AS rank
    FROM cu WHERE current_mrr_cents > 0 AND (external_id ILIKE '%#0000%' OR processor_id ILIKE '%#0000%')) WHERE rank BETWEEN 51 AND 100""",
)
def customer_ranking(spark, sf_dir):
    return revenue.customer_ranking(recalculated(spark, sf_dir), "#0000", True, 2).select("site_id", "customer_id", "current_mrr_cents", "lifetime_revenue_cents", "rank")


@query(
    "customer_matching",
    f"""{WITH}, ask AS (SELECT site_id, o_orderkey AS ask_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS external_id,
      CASE WHEN o_orderkey % 3 < 2 THEN 'cus_' || o_custkey % 1000 END AS processor_id, sha256('BUILDING' || o_custkey) AS email_hash FROM ord),
    x AS (SELECT site_id, external_id, min(customer_id) AS c FROM cust WHERE external_id <> '' GROUP BY 1, 2), p AS (SELECT site_id, processor_id, min(customer_id) AS c FROM cust WHERE processor_id <> '' GROUP BY 1, 2),
    m AS (SELECT site_id, email_hash, min(customer_id) AS c FROM cust GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT a.site_id, ask_id, coalesce(x.c, p.c, m.c) AS customer_id FROM ask a LEFT JOIN x USING (site_id, external_id) LEFT JOIN p USING (site_id, processor_id) LEFT JOIN m USING (site_id, email_hash)""",
)
def customer_matching(spark, sf_dir):
    ask = money.orders(spark, sf_dir).select(
        "site_id", F.col("o_orderkey").alias("ask_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("external_id"),
        F.when(F.col("o_orderkey") % 3 < 2, F.concat(F.lit("cus_"), F.col("o_custkey") % 1000)).alias("processor_id"),
        F.sha2(F.concat(F.lit("BUILDING"), "o_custkey"), 256).alias("email_hash"),
    )
    return revenue.matched(ask, money.customers(spark, sf_dir)).select("site_id", "ask_id", "customer_id")


@query(
    "customers_identified",
    f"""WITH c AS (SELECT 1 + o_custkey % 3 AS site_id, o_custkey AS customer_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'x' || o_orderkey END AS external_id,
      CASE o_orderkey % 3 WHEN 0 THEN '(pre-install)' WHEN 1 THEN lower(o_orderpriority) ELSE ['Google', 'Google', 'unknown.site.test'][1 + o_orderkey % 5 % 3] END AS s, ['www.google.com', 'news.google.com', 'unknown.site.test'][1 + o_orderkey % 5 % 3] AS referrer_host, CASE WHEN o_orderkey % 2 = 0 THEN ' A' || o_orderkey || '@X.org ' END AS email, o_orderdate AS seen_at FROM orders)
    SELECT site_id, customer_id, arg_min(external_id, seq) FILTER (trim(external_id) <> '') AS external_id,
      coalesce(arg_min(s, seq) FILTER (trim(s) <> '' AND s <> '(pre-install)'), max(s) FILTER (s = '(pre-install)')) AS attribution_source, arg_min(referrer_host, seq) AS referrer_host,
      arg_min(sha256(lower(trim(email))), seq) FILTER (email IS NOT NULL) AS email_hash, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM c GROUP BY 1, 2""",
)
def customers_identified(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.lit(None).cast("string")
    calls = o.select(
        (1 + F.col("o_custkey") % 3).alias("site_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit("x"), "o_orderkey")).alias("external_id"), none.alias("processor_id"),
        F.when(F.col("o_orderkey") % 3 == 0, revenue.PRE_INSTALL).when(F.col("o_orderkey") % 3 == 1, F.lower("o_orderpriority")).otherwise("").alias("attribution_source"),
        none.alias("attribution_medium"), none.alias("attribution_campaign"),
        F.expr("element_at(array('www.google.com', 'news.google.com', 'unknown.site.test'), cast(1 + o_orderkey % 5 % 3 AS int))").alias("referrer_host"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" A"), "o_orderkey", F.lit("@X.org "))).alias("email"), F.col("o_orderdate").cast("timestamp").alias("seen_at"),
    )
    out = revenue.identified(calls)
    return out.select("site_id", "customer_id", "external_id", "attribution_source", "referrer_host", "email_hash", stamp("first_seen_at"))


_CH = "coalesce(nullif(attribution_source, ''), 'Direct') AS source, coalesce(nullif(attribution_medium, ''), '(none)') AS medium, coalesce(nullif(attribution_campaign, ''), '(none)') AS campaign"
_LD = "(({c} AT TIME ZONE 'UTC') AT TIME ZONE timezone)::DATE"
_ROLL = f"""cc AS (SELECT cu.*, timezone, {_CH} FROM cu JOIN sites USING (site_id)),
tr AS (SELECT site_id, {_LD.format(c='occurred_at')} AS date, coalesce(nullif(utm_source, ''), nullif(referrer_source, ''), 'Direct') AS source, coalesce(nullif(utm_medium, ''), '(none)') AS medium, coalesce(nullif(utm_campaign, ''), '(none)') AS campaign,
  count(DISTINCT visitor_hash) AS visitors FROM ev GROUP BY 1, 2, 3, 4, 5),
mk AS (SELECT site_id, source, medium, campaign, {_LD.format(c='identified_at')} AS date, 1 AS sg, 0 AS tl, 0 AS cv FROM cc WHERE identified_at IS NOT NULL UNION ALL SELECT site_id, source, medium, campaign, {_LD.format(c='converted_at')}, 0, 0, 1 FROM cc WHERE converted_at IS NOT NULL
  UNION ALL SELECT cc.site_id, source, medium, campaign, {_LD.format(c='created_at')}, 0, 1, 0 FROM lst JOIN cc USING (site_id, customer_id) WHERE status = 'trialing'),
fu AS (SELECT site_id, date, source, medium, campaign, sum(sg) AS signups, sum(tl) AS trials, sum(cv) AS conversions FROM mk GROUP BY 1, 2, 3, 4, 5),
mo AS (SELECT cc.site_id, {_LD.format(c='occurred_at')} AS date, source, medium, campaign, {', '.join(f"coalesce(sum(normalized_cents) FILTER (kind = '{k}'), 0) AS {k}" for k in revenue.MRR_KINDS)},
  count(*) FILTER (normalized_cents IS NULL) AS unconverted FROM rev JOIN cc USING (site_id, customer_id) GROUP BY 1, 2, 3, 4, 5),
lf AS (SELECT site_id, source, medium, campaign, sum(lifetime_revenue_cents) AS lifetime FROM cc GROUP BY 1, 2, 3, 4),
rl AS (SELECT site_id, date, source, medium, campaign, coalesce(visitors, 0)::BIGINT AS visitors, coalesce(signups, 0)::BIGINT AS signups, coalesce(trials, 0)::BIGINT AS trials, coalesce(conversions, 0)::BIGINT AS conversions, coalesce("new", 0)::BIGINT AS new_mrr_cents,
  coalesce(expansion, 0)::BIGINT AS expansion_mrr_cents, coalesce(contraction, 0)::BIGINT AS contraction_mrr_cents, abs(coalesce(churn, 0))::BIGINT AS churned_mrr_cents,
  (coalesce("new", 0) + coalesce(expansion, 0) + coalesce(contraction, 0) + coalesce(churn, 0) + coalesce(reactivation, 0))::BIGINT AS net_mrr_cents, coalesce(lifetime, 0)::BIGINT AS lifetime_revenue_cents, coalesce(unconverted, 0)::BIGINT AS unconverted_events
  FROM tr FULL JOIN fu USING (site_id, date, source, medium, campaign) FULL JOIN mo USING (site_id, date, source, medium, campaign) LEFT JOIN lf USING (site_id, source, medium, campaign))"""


def facts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, subscriptions, revenue): tables of their own, since several parts of the rollup read them."""
    rows = money.orders(spark, sf_dir)
    changes = stored(revenue.change_log(money.subscription_changes(rows)), "changes")
    cash = revenue.cash_events(money.invoices(spark, sf_dir, rows))
    events = stored(revenue.normalised(revenue.movements(changes).unionByName(cash), adapter.sites(spark)), "revenue")
    states = last_states(changes)
    return stored(revenue.recalculated(money.customers(spark, sf_dir), states, events), "customers"), states, events


def rollup(spark, sf_dir, start: date | None = None, end: date | None = None) -> DataFrame:
    return revenue.attribution_rollup(adapter.events(spark, sf_dir), *facts(spark, sf_dir), adapter.sites(spark), start=start, end=end)


@query("attribution_rollup", f"{WITH}, {_LAST}, {_ROLL} SELECT * REPLACE (date::VARCHAR AS date) FROM rl")
def attribution_rollup(spark, sf_dir):
    return rollup(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query(
    "attribution_report",
    f"""{WITH}, {_LAST}, {_ROLL}, g AS (SELECT site_id, source, medium, campaign, {', '.join(f'sum({c})::BIGINT AS {c}' for c in revenue.SUMMED)}, arg_max(lifetime_revenue_cents, date) AS lifetime_revenue_cents,
      source || CASE WHEN medium <> '(none)' THEN ' / ' || medium ELSE '' END || CASE WHEN campaign <> '(none)' THEN ' / ' || campaign ELSE '' END AS channel FROM rl WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-25' GROUP BY 1, 2, 3, 4)
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY net_mrr_cents DESC, channel, source, medium, campaign) AS rank, (sum(visitors) OVER (PARTITION BY site_id))::BIGINT AS total_visitors,
      (sum(net_mrr_cents) OVER (PARTITION BY site_id))::BIGINT AS total_net_mrr_cents, CASE WHEN visitors > 0 THEN round(conversions / visitors, 6) END AS conversion_rate,
      CASE WHEN visitors > 0 THEN floor(lifetime_revenue_cents / visitors)::BIGINT END AS value_per_visitor_cents, false AS truncated FROM g""",
)
def attribution_report(spark, sf_dir):
    """The report of a stored rollup, which holds more days than it asks for."""
    store, days = Snapshots(spark, folder(spark)), (date(2024, 1, 5), date(2024, 1, 25))
    revenue.write_rollup(store, rollup(spark, sf_dir, date(2024, 1, 3), date(2024, 1, 28)))
    return revenue.attribution_report(revenue.read_rollup(store, *days), *map(str, days))


@query("attribution_nightly", f"{WITH}, {_LAST}, {_ROLL} SELECT * REPLACE (date::VARCHAR AS date) FROM rl WHERE date < DATE '2024-01-31'")
def attribution_nightly(spark, sf_dir):
    """The stored rollup after a backfill of the days before the 29th and two nightly runs, which replace their days."""
    sites, known, store = adapter.sites(spark), facts(spark, sf_dir), Snapshots(spark, folder(spark))
    days = [(None, date(2024, 1, 29)), *[revenue.sliding_days(sites, n) for n in (NOW - timedelta(days=1), NOW)]]
    for start, end in days:
        revenue.write_rollup(store, revenue.attribution_rollup(adapter.events(spark, sf_dir), *known, sites, start=start, end=end), start, end)
    return revenue.read_rollup(store).withColumn("date", F.col("date").cast("string"))
