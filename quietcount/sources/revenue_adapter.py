"""Customers, subscription changes and cash of the given customer, orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.operators import revenue


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer per row of `customer`; sites by nation, channels by market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        (F.col("c_nationkey") % 3 + 1).cast("long").alias("site_id"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("external_id"),
        F.concat(F.lit("cus_"), F.col("c_custkey") % 1000).alias("processor_id"),
        F.sha2(F.concat("c_mktsegment", F.col("c_custkey").cast("string")), 256).alias("email_hash"),
        F.initcap("c_mktsegment").alias("attribution_source"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN '' END").alias("attribution_medium"), F.lit(None).cast("string").alias("attribution_campaign"),
        F.expr("CASE WHEN c_custkey % 4 > 0 THEN timestamp '2024-01-01 20:00:00' + make_interval(0, 0, 0, cast(c_custkey % 30 AS int)) END").alias("identified_at"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's site; times are moved into January 2024."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3 + 1).cast("long").alias("site_id"))
    at = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(datediff(o_orderdate, date '1992-01-01') % 30 AS int), cast(o_orderkey % 24 AS int))")
    return o.join(c, "o_custkey").withColumn("at", at).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def subscription_changes(order_rows: DataFrame) -> DataFrame:
    """Orders in state O as changes of their customer's subscription."""
    item = F.struct(
        F.col("cents").alias("unit_amount"), F.lit(1).cast("long").alias("quantity"),
        F.expr("element_at(array('month', 'year', 'week', 'day'), cast(1 + o_orderkey % 4 AS int))").alias("interval"), (1 + F.col("o_orderkey") % 3).alias("interval_count"),
    )
    status = F.expr("element_at(map('1-URGENT', 'active', '2-HIGH', 'active', '3-MEDIUM', 'trialing', '4-NOT SPECIFIED', 'past_due'), o_orderpriority)")
    return order_rows.where("o_orderstatus = 'O'").select(
        "site_id", F.col("o_custkey").alias("customer_id"), F.concat(F.lit("sub_"), "o_custkey").alias("subscription_id"), F.col("o_orderkey").alias("event_id"),
        F.col("at").alias("event_at"), F.col("at").alias("received_at"), F.coalesce(status, F.lit("canceled")).alias("status"), F.array(item).alias("items"),
        F.when(F.col("o_orderkey") % 5 == 0, "EUR").otherwise("USD").alias("currency"),
    ).withColumn("mrr_cents", revenue.monthly_value("items")).drop("items")


def invoices(spark: SparkSession, sf_dir: str, order_rows: DataFrame) -> DataFrame:
    """Orders in state F (subscription payments) and P (one-time), and their returned lines as refunds."""
    currency = F.when(F.col("o_orderkey") % 5 == 0, "EUR").otherwise("USD").alias("currency")
    sold = order_rows.where("o_orderstatus IN ('F', 'P')").select(
        "site_id", F.col("o_custkey").alias("customer_id"), F.concat(F.lit("in_"), "o_orderkey").alias("object_id"), F.lit("invoice").alias("type"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("sub_"), "o_custkey")).alias("subscription_id"), F.col("cents").alias("amount_cents"), currency, F.col("at").alias("occurred_at"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum((F.col("l_extendedprice") * 100).cast("decimal(20,0)"))).cast("long").alias("back")
    )
    back = order_rows.join(lines, "o_orderkey").select(
        "site_id", F.col("o_custkey").alias("customer_id"), F.concat(F.lit("re_"), "o_orderkey").alias("object_id"), F.lit("refund").alias("type"),
        F.lit(None).cast("string").alias("subscription_id"), F.col("back").alias("amount_cents"), currency, F.col("at").alias("occurred_at"),
    )
    return sold.unionByName(back)


_CUR = "CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency"
#: The same in DuckDB, after CTES of the event adapter.
CTES = f"""cust AS (
  SELECT 1 + c_nationkey % 3 AS site_id, c_custkey AS customer_id, c_name AS external_id, 'cus_' || c_custkey % 1000 AS processor_id, sha256(c_mktsegment || c_custkey) AS email_hash,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS attribution_source, CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN '' END AS attribution_medium, NULL::VARCHAR AS attribution_campaign,
    CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-01 20:00:00' + INTERVAL 1 DAY * (c_custkey % 30) END AS identified_at FROM customer
), ord AS (
  SELECT o.*, 1 + c_nationkey % 3 AS site_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (datediff('day', DATE '1992-01-01', o_orderdate::DATE) % 30) + INTERVAL 1 HOUR * (o_orderkey % 24) AS placed, round(o_totalprice * 100)::BIGINT AS cents
  FROM orders o JOIN customer c ON o_custkey = c_custkey
), chg0 AS (
  SELECT site_id, o_custkey AS customer_id, 'sub_' || o_custkey AS subscription_id, o_orderkey AS event_id, placed AS event_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'active' WHEN '3-MEDIUM' THEN 'trialing' WHEN '4-NOT SPECIFIED' THEN 'past_due' ELSE 'canceled' END AS status,
    CASE o_orderkey % 4 WHEN 0 THEN cents // (1 + o_orderkey % 3) WHEN 1 THEN cents // (12 * (1 + o_orderkey % 3)) WHEN 2 THEN cents * 52 // (12 * (1 + o_orderkey % 3)) ELSE cents * 365 // (12 * (1 + o_orderkey % 3)) END AS mrr_cents, {_CUR}
  FROM ord WHERE o_orderstatus = 'O'
), sc1 AS (
  SELECT *, max(event_at) OVER (PARTITION BY site_id, subscription_id ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM chg0
), slog AS (SELECT * FROM sc1 WHERE latest IS NULL OR event_at >= latest
), mv0 AS (
  SELECT *, CASE WHEN status IN ('active', 'past_due') THEN mrr_cents ELSE 0 END AS nw, status IN ('trialing', 'active', 'past_due') AS live FROM slog
), mv1 AS (
  SELECT *, coalesce(lag(nw) OVER w, 0) AS bef, coalesce(lag(live) OVER w, false) AS was FROM mv0 WINDOW w AS (PARTITION BY site_id, subscription_id ORDER BY event_at, event_id)
), mv2 AS (SELECT *, was AND NOT live AS churned, NOT (was AND NOT live) AND nw <> bef AND bef = 0 AS starts FROM mv1
), mv3 AS (
  SELECT *, coalesce(max(starts) OVER (PARTITION BY site_id, customer_id ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS conv FROM mv2
), mv AS (
  SELECT site_id, customer_id, CASE WHEN churned THEN 'churn' WHEN nw = bef THEN NULL WHEN bef = 0 THEN CASE WHEN conv THEN 'reactivation' ELSE 'new' END WHEN nw > bef THEN 'expansion' ELSE 'contraction' END AS kind,
    CASE WHEN churned THEN -abs(mrr_cents) ELSE nw - bef END AS amount_cents, currency, subscription_id || ':' || epoch(event_at)::BIGINT AS object_id, event_at AS occurred_at, event_id FROM mv3
), cash AS (
  SELECT site_id, o_custkey AS customer_id, CASE o_orderstatus WHEN 'F' THEN 'payment' ELSE 'one_time' END AS kind, cents AS amount_cents, {_CUR}, 'in_' || o_orderkey AS object_id, placed AS occurred_at FROM ord WHERE o_orderstatus IN ('F', 'P') AND cents <> 0
  UNION ALL SELECT site_id, o_custkey, 'refund', -abs(back), {_CUR}, 're_' || o_orderkey, placed FROM ord JOIN (SELECT l_orderkey AS o_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (o_orderkey) WHERE back <> 0
), mvd AS (SELECT * EXCLUDE (event_id) FROM mv WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id, object_id, kind ORDER BY occurred_at, event_id) = 1),
rev AS (SELECT r.*, CASE WHEN currency = base_currency THEN amount_cents END AS normalized_cents FROM (SELECT * FROM mvd UNION ALL SELECT * FROM cash) r JOIN sites USING (site_id))"""
