"""Registered queries on raw payment webhooks, made of the given orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.operators import revenue, webhooks
from quietcount.plans.money import WITH
from quietcount.plans.traffic import stamp
from quietcount.sources import adapter
from quietcount.sources import revenue_adapter as money
from quietcount.sources.revenue_adapter import CTES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def raw_log(spark, sf_dir) -> DataFrame:
    """Deliveries as they came: a seventh failed, some came twice, some have no customer, an unknown type or a broken body."""
    rows = money.orders(spark, sf_dir)
    refunds = money.invoices(spark, sf_dir, rows).where("type = 'refund'").select(F.expr("cast(substring(object_id, 4) AS bigint)").alias("o_orderkey"), F.col("amount_cents").alias("back"))
    rows = rows.join(refunds, "o_orderkey", "left")
    currency = F.when(F.col("o_orderkey") % 5 == 0, "eur").when(F.col("o_orderkey") % 3 == 0, "usd")  # else the site's
    customer = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("cus_"), "o_custkey"))
    interval = F.expr("element_at(array('month', 'year', 'week', 'day'), cast(1 + o_orderkey % 4 AS int))")
    price = F.struct(F.col("cents").alias("unit_amount"), F.struct(interval.alias("interval"), (1 + F.col("o_orderkey") % 3).alias("interval_count")).alias("recurring"))
    status = F.expr("coalesce(element_at(map('1-URGENT', 'active', '2-HIGH', 'active', '3-MEDIUM', 'trialing', '4-NOT SPECIFIED', 'past_due'), o_orderpriority), 'canceled')")
    subscription = F.to_json(F.struct(F.concat(F.lit("sub_"), "o_custkey").alias("id"), customer.alias("customer"), status.alias("status"), currency.alias("currency"), F.struct(F.array(F.struct(price.alias("price"), F.lit(1).alias("quantity"))).alias("data")).alias("items")))
    # a customer given as an object
    invoice = F.to_json(F.struct(F.concat(F.lit("in_"), "o_orderkey").alias("id"), F.struct(customer.alias("id")).alias("customer"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("sub_"), "o_custkey")).alias("subscription"), F.col("cents").alias("amount_paid"), currency.alias("currency")))
    refund = F.to_json(F.struct(F.concat(F.lit("re_"), "o_orderkey").alias("id"), customer.alias("customer"), F.abs("back").alias("amount_refunded"), currency.alias("currency")))
    kinds = F.array(
        F.when(F.col("o_orderstatus") == "O", F.struct(F.lit("s").alias("tag"), F.when(F.col("o_orderkey") % 13 == 0, "charge.captured").otherwise("customer.subscription.updated").alias("type"), subscription.alias("object"))),
        F.when(F.col("o_orderstatus") != "O", F.struct(F.lit("i").alias("tag"), F.lit("invoice.paid").alias("type"), invoice.alias("object"))),
        F.when(F.col("back").isNotNull(), F.struct(F.lit("r").alias("tag"), F.lit("charge.refunded").alias("type"), refund.alias("object"))),
    )
    events = rows.select("site_id", "o_orderkey", "at", F.explode(F.array_compact(kinds)).alias("e"))
    event_id = F.concat(F.lit("evt_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "e.tag")
    payload = F.concat(F.lit('{"id":"'), event_id, F.lit('","type":"'), "e.type", F.lit('","created":'), F.unix_timestamp("at").cast("string"), F.lit(',"data":{"object":'), F.when(F.col("o_orderkey") % 17 == 0, F.lit("{}")).otherwise(F.col("e.object")), F.lit("}}"))
    processed = F.when(F.col("o_orderkey") % 7 != 0, F.col("at") + F.expr("INTERVAL 1 MINUTE"))
    log = events.select("site_id", "o_orderkey", payload.alias("payload"), F.col("at").alias("received_at"), processed.alias("processed_at"))
    again = log.where("o_orderkey % 4 = 0").withColumns({"received_at": F.col("received_at") + F.expr("INTERVAL 1 HOUR"), "processed_at": F.lit(None).cast("timestamp")})
    return log.unionByName(again).drop("o_orderkey")


def replayed(spark, sf_dir) -> DataFrame:
    return webhooks.replayed(webhooks.dispatched(webhooks.deliveries(raw_log(spark, sf_dir)), adapter.sites(spark)))


_CUR = "coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 0 THEN 'USD' END, base_currency)"
#: Changes as money.CTES has them, without those that can't be applied, and failed ones behind the others.
_SUBS = CTES.replace("ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM chg0", "ORDER BY event_id % 7 = 0, event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM chg0 WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0")


@query("webhook_movements", f"WITH {adapter.CTES}, {_SUBS} SELECT site_id, 'cus_' || customer_id AS customer_id, kind, amount_cents, currency, object_id FROM mvd")
def webhook_movements(spark, sf_dir):
    return revenue.movements(webhooks.changes(replayed(spark, sf_dir))).select("site_id", "customer_id", "kind", "amount_cents", "currency", "object_id")


@query(
    "webhook_cash",
    f"""{WITH} SELECT cash.site_id, 'cus_' || customer_id AS customer_id, kind, amount_cents, currency, object_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at
    FROM cash WHERE split_part(object_id, '_', 2)::BIGINT % 11 <> 0 AND split_part(object_id, '_', 2)::BIGINT % 17 <> 0""",
)
def webhook_cash(spark, sf_dir):
    return webhooks.cash(replayed(spark, sf_dir)).withColumn("occurred_at", stamp("occurred_at"))


@query(
    "webhook_sweep",
    f"""WITH {adapter.CTES}, {_SUBS}, al AS (SELECT site_id, o_orderkey AS n, 'sub' AS t, o_orderkey % 13 = 0 AS ignored, cents FROM ord WHERE o_orderstatus = 'O'
      UNION ALL SELECT site_id, o_orderkey, 'inv', false, cents FROM ord WHERE o_orderstatus <> 'O'
      UNION ALL SELECT site_id, o_orderkey, 'ref', false, 1 FROM ord WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
    f AS (SELECT al.site_id, NOT ignored AND (n % 17 = 0 OR n % 11 = 0 OR (t = 'sub' AND NOT EXISTS (SELECT 1 FROM slog WHERE slog.event_id = n))) AS bad FROM al WHERE n % 7 = 0)
    SELECT site_id, count(*) AS attempted, count(*) FILTER (NOT bad) AS applied, count(*) FILTER (bad) AS "left" FROM f GROUP BY 1""",
)
def webhook_sweep(spark, sf_dir):
    return webhooks.sweep_report(replayed(spark, sf_dir))


@query(
    "checkout_attribution",
    """SELECT o_orderkey AS order_id, 'user-' || o_custkey AS external_id, CASE o_orderkey % 3 WHEN 0 THEN 'Google' WHEN 1 THEN repeat('s', 500) END AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'cpc' END AS medium,
      NULL::VARCHAR AS campaign, NULL::VARCHAR AS content, NULL::VARCHAR AS term, '/p/' || o_orderkey % 12 AS landing_path, CASE WHEN o_orderkey % 5 = 0 THEN 'google.com' END AS referrer_host,
      CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' END AS first_seen_at FROM orders""",
)
def checkout_attribution(spark, sf_dir):
    """What a checkout's metadata says of its first touch: blanks, values too long and a time that can't be read among them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    fields = {
        "external_id": F.concat(F.lit("user-"), "o_custkey"), "source": F.when(key % 3 == 0, "Google").when(key % 3 == 1, F.repeat(F.lit("s"), F.lit(700))).otherwise(""),
        "medium": F.when(key % 2 == 0, "cpc"), "campaign": F.lit(""), "landing_path": F.concat(F.lit("/p/"), key % 12), "referrer_host": F.when(key % 5 == 0, "google.com").otherwise(""),
        "first_seen_at": F.when(key % 7 == 0, "yesterday").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))),
    }
    cells = [x for name, value in fields.items() for x in (F.lit(f"tst_{name}"), value)]
    rows = o.select(key.alias("order_id"), F.create_map(*cells, F.lit("other"), F.lit("x")).alias("metadata"))
    return rows.select("order_id", *revenue.checkout_attribution()).withColumn("first_seen_at", stamp("first_seen_at"))
