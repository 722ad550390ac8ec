"""Registered queries on the historic import of a payment account, whose lists are made of the given customers and orders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.operators import imports, revenue
from quietcount.plans.traffic import NOW, stamp
from quietcount.sources import adapter
from quietcount.sources import revenue_adapter as money
from quietcount.sources.revenue_adapter import CTES
from quietcount.sources.shared import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SINCE = NOW - timedelta(days=730)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def connections(spark) -> DataFrame:
    """The connection of each site; that of site 3 is revoked."""
    return adapter.sites(spark).select("site_id", F.when(F.col("site_id") == 3, F.lit(NOW)).alias("revoked_at"))


def known_customers(spark, sf_dir) -> DataFrame:
    """Every fourth customer is known: some by the processor's id, some by e-mail only, some with a source."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 4 = 0")
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    return c.select(
        (F.col("c_nationkey") % 3 + 1).cast("long").alias("site_id"), F.concat(F.lit("p-"), key).alias("customer_id"), F.col("c_name").alias("external_id"),
        F.when(key % 8 == 0, F.concat(F.lit("cus_"), key)).alias("processor_id"), F.sha2(F.concat(F.lit("u"), F.floor(key / 6), F.lit("@x.org")), 256).alias("email_hash"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN '(pre-install)' END").alias("attribution_source"), F.when(key % 5 == 0, "social").alias("attribution_medium"),
        *[none.alias(f) for f in imports.FIELDS[2:]], F.lit(NOW - timedelta(days=100)).alias("first_seen_at"), F.when(key % 12 == 0, F.lit(NOW - timedelta(days=50))).alias("identified_at"),
    )


def listed_customers(spark, sf_dir) -> DataFrame:
    """The processor's list: six neighbours share an e-mail address, some are too old, some carry metadata, some come twice, some can't be read."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    metadata = F.struct(
        F.when(key % 5 == 0, "www.google.com").alias("tst_source"), F.when(key % 5 < 2, F.concat(F.lit("c"), key % 7)).alias("tst_campaign"), F.when(key % 10 == 0, "2023-01-05T10:00:00Z").alias("tst_first_seen_at"), F.lit("x").alias("other"),
    )
    mail = F.when(key % 7 != 0, F.concat(F.lit(" U"), F.floor(key / 6), F.lit("@X.org ")))
    payload = F.to_json(F.struct(F.concat(F.lit("cus_"), key).alias("id"), mail.alias("email"), (F.lit(1609459200) + key % 1100 * 86400).alias("created"), F.when(key % 5 < 4, metadata).alias("metadata")))
    rows = c.select((F.col("c_nationkey") % 3 + 1).cast("long").alias("site_id"), key, F.when(key % 17 == 0, F.lit("{broken")).otherwise(payload).alias("payload"))
    return rows.unionByName(rows.where("c_custkey % 9 = 0")).drop("c_custkey")


def listed_subscriptions(spark, sf_dir) -> DataFrame:
    """Orders in state O as subscriptions of their customer, ended ones too."""
    o = money.orders(spark, sf_dir).where("o_orderstatus = 'O'")
    status = F.expr("coalesce(element_at(map('1-URGENT', 'active', '2-HIGH', 'active', '3-MEDIUM', 'trialing', '4-NOT SPECIFIED', 'past_due'), o_orderpriority), 'canceled')")
    price = F.struct(F.col("cents").alias("unit_amount"), F.struct(F.lit("month").alias("interval"), (1 + F.col("o_orderkey") % 3).alias("interval_count")).alias("recurring"))
    seconds = F.unix_timestamp("at")
    object_ = F.struct(
        F.concat(F.lit("sub_"), "o_orderkey").alias("id"), F.struct(F.concat(F.lit("cus_"), "o_custkey").alias("id")).alias("customer"), status.alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "eur").alias("currency"),
        (seconds - 864000).alias("created"), F.when(F.col("o_orderkey") % 2 == 0, seconds).alias("start_date"), F.when(status == "canceled", seconds + 3600).alias("canceled_at"),
        F.struct(F.array(F.struct(price.alias("price"), F.lit(2).alias("quantity"))).alias("data")).alias("items"),
    )
    return o.select("site_id", F.to_json(object_).alias("payload"))


def known_changes(spark, sf_dir) -> DataFrame:
    """What webhooks told of every third of these subscriptions, days before or after the list's own time."""
    o = money.orders(spark, sf_dir).where("o_orderstatus = 'O' AND o_orderkey % 3 = 0")
    moved = F.col("at") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 41 - 20).cast("int") * 24)
    return o.select(
        "site_id", F.concat(F.lit("cus_"), "o_custkey").alias("customer_id"), F.concat(F.lit("sub_"), "o_orderkey").alias("subscription_id"), F.concat(F.lit("a"), "o_orderkey").alias("event_id"),
        moved.alias("event_at"), moved.alias("received_at"), F.lit("active").alias("status"), F.lit(100_000).cast("long").alias("mrr_cents"), F.lit("USD").alias("currency"), F.lit(None).cast("timestamp").alias("canceled_at"),
    )


def listed_invoices(spark, sf_dir) -> DataFrame:
    """Other orders as invoices; a tenth are open, some carry the subscription under their parent, some no time of payment."""
    o = money.orders(spark, sf_dir).where("o_orderstatus <> 'O'")
    key, seconds = F.col("o_orderkey"), F.unix_timestamp("at")
    sub = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("sub_"), key))
    object_ = F.struct(
        F.concat(F.lit("in_"), key).alias("id"), F.concat(F.lit("cus_"), "o_custkey").alias("customer"), F.when(key % 10 == 0, "open").otherwise("paid").alias("status"), F.when(key % 5 == 0, "eur").otherwise("usd").alias("currency"),
        F.when(key % 4 > 0, F.col("cents")).otherwise(0).alias("amount_paid"), F.when(key % 2 == 0, sub).alias("subscription"), F.struct(F.struct(F.when(key % 2 == 1, sub).alias("subscription")).alias("subscription_details")).alias("parent"),
        (seconds - F.when(key % 7 == 0, 70_000_000).otherwise(0)).alias("created"), F.struct(F.when(key % 3 > 0, seconds + 60).alias("paid_at")).alias("status_transitions"),
    )
    return o.select("site_id", F.to_json(object_).alias("payload"))


def known_cash(spark, sf_dir) -> DataFrame:
    """Payments that webhooks had booked: every eighth order, for one cent."""
    o = money.orders(spark, sf_dir).where("o_orderstatus <> 'O' AND o_orderkey % 8 = 1")
    kind = F.when(F.col("o_orderstatus") == "F", "payment").otherwise("one_time")
    return o.select("site_id", F.concat(F.lit("cus_"), "o_custkey").alias("customer_id"), kind.alias("kind"), F.lit(1).cast("long").alias("amount_cents"), F.lit("USD").alias("currency"), F.lit(0).cast("long").alias("mrr_delta_cents"), F.concat(F.lit("in_"), "o_orderkey").alias("object_id"), F.col("at").alias("occurred_at"))


def held(spark, sf_dir) -> DataFrame:
    """The customers after two imports, the second of which changes nothing."""
    once = imported(spark, sf_dir, known_customers(spark, sf_dir))
    return stored(imported(spark, sf_dir, stored(once, "first")), "second")


def imported(spark, sf_dir, known: DataFrame) -> DataFrame:
    return imports.customers(listed_customers(spark, sf_dir), known, connections(spark), SINCE, NOW)


_L = f"""kn AS (SELECT 1 + c_nationkey % 3 AS site_id, 'p-' || c_custkey AS customer_id, c_name AS external_id, CASE WHEN c_custkey % 8 = 0 THEN 'cus_' || c_custkey END AS processor_id, 'u' || c_custkey // 6 AS mail,
    CASE c_custkey % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN '(pre-install)' END AS s, CASE WHEN c_custkey % 5 = 0 THEN 'social' END AS m, CASE WHEN c_custkey % 12 = 0 THEN '2023-12-11 12:00:00' END AS identified_at FROM customer WHERE c_custkey % 4 = 0),
li AS (SELECT 1 + c_nationkey % 3 AS site_id, c_custkey AS n, 'cus_' || c_custkey AS pid, CASE WHEN c_custkey % 7 <> 0 THEN 'u' || c_custkey // 6 END AS mail, TIMESTAMP '2021-01-01' + INTERVAL 1 DAY * (c_custkey % 1100) AS created,
    CASE WHEN c_custkey % 5 = 0 THEN 'Google' WHEN c_custkey % 5 = 1 THEN NULL ELSE '(pre-install)' END AS s, CASE WHEN c_custkey % 5 < 2 THEN 'c' || c_custkey % 7 END AS c, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2023-01-05 10:00:00' END AS seen
    FROM customer WHERE c_custkey % 17 <> 0 AND c_nationkey % 3 <> 2 AND TIMESTAMP '2021-01-01' + INTERVAL 1 DAY * (c_custkey % 1100) >= TIMESTAMP '{SINCE}'),
ma AS (SELECT li.*, coalesce((SELECT min(k.customer_id) FROM kn k WHERE k.site_id = li.site_id AND k.processor_id = pid),
    CASE (SELECT count(*) FROM kn k WHERE k.site_id = li.site_id AND k.mail = li.mail) WHEN 1 THEN (SELECT min(k.customer_id) FROM kn k WHERE k.site_id = li.site_id AND k.mail = li.mail)
      WHEN 0 THEN CASE WHEN li.mail IS NOT NULL THEN (SELECT arg_min(l.pid, (l.created, l.pid)) FROM li l WHERE l.site_id = li.site_id AND l.mail = li.mail
        AND NOT EXISTS (SELECT 1 FROM kn k WHERE k.site_id = l.site_id AND k.processor_id = l.pid)) END END, pid) AS customer_id FROM li),
al AS (SELECT site_id, customer_id, 0 AS t, NULL AS o, '' AS p, external_id, processor_id, mail, s, m, NULL::VARCHAR AS c, TIMESTAMP '{NOW - timedelta(days=100)}' AS seen, identified_at FROM kn
  UNION ALL SELECT site_id, customer_id, 1, created, pid, NULL, pid, CASE WHEN customer_id = pid THEN mail END, s, NULL, c, CASE WHEN customer_id = pid THEN least(created, seen) ELSE seen END, '{NOW}' FROM ma),
he AS (SELECT site_id, customer_id, first(external_id ORDER BY t, o, p) FILTER (external_id IS NOT NULL) AS external_id, first(processor_id ORDER BY t, o, p) FILTER (processor_id IS NOT NULL) AS processor_id,
    sha256(first(mail ORDER BY t, o, p) FILTER (mail IS NOT NULL) || '@x.org') AS email_hash, coalesce(first(s ORDER BY t, o, p) FILTER (s <> '(pre-install)'), max(s)) AS attribution_source,
    first(m ORDER BY t, o, p) FILTER (m IS NOT NULL) AS attribution_medium, first(c ORDER BY t, o, p) FILTER (c IS NOT NULL) AS attribution_campaign, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
    first(identified_at ORDER BY t, o, p) FILTER (identified_at IS NOT NULL) AS identified_at FROM al GROUP BY 1, 2)"""


@query("import_customers", f"WITH {_L} SELECT * FROM he")
def import_customers(spark, sf_dir):
    columns = ["site_id", "customer_id", "external_id", "processor_id", "email_hash", "attribution_source", "attribution_medium", "attribution_campaign"]
    return held(spark, sf_dir).select(*columns, stamp("first_seen_at"), stamp("identified_at"))


def changes(spark, sf_dir, customers: DataFrame) -> DataFrame:
    new = imports.subscription_changes(listed_subscriptions(spark, sf_dir), customers, connections(spark), adapter.sites(spark), NOW)
    return imports.merged_changes(known_changes(spark, sf_dir), new)


def booked(spark, sf_dir, customers: DataFrame) -> DataFrame:
    new = imports.invoices(listed_invoices(spark, sf_dir), customers, connections(spark), adapter.sites(spark), SINCE)
    return imports.merged_cash(known_cash(spark, sf_dir), revenue.cash_events(new))


_ORD = CTES[CTES.index("ord AS (") : CTES.index(", chg0 AS (")]
_MOVES = CTES[CTES.index("mv0 AS (") : CTES.index(", cash AS (")]
_OWN = "ow AS (SELECT site_id, processor_id, min(customer_id) AS customer_id FROM he WHERE site_id <> 3 GROUP BY 1, 2)"
_CHANGES = f"""ka AS (SELECT site_id, 'cus_' || o_custkey AS customer_id, 'sub_' || o_orderkey AS subscription_id, 'a' || o_orderkey AS event_id, placed + INTERVAL 1 DAY * (o_orderkey % 41 - 20) AS event_at, 'active' AS status, 100000 AS mrr_cents, 'USD' AS currency
    FROM ord WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0),
im AS (SELECT ord.*, customer_id, base_currency, o_orderpriority = '5-LOW' AS ended, CASE WHEN o_orderpriority = '5-LOW' THEN placed + INTERVAL 1 HOUR WHEN o_orderkey % 2 = 0 THEN placed ELSE placed - INTERVAL 10 DAY END AS event_at
    FROM ord JOIN ow ON ow.site_id = ord.site_id AND ow.processor_id = 'cus_' || o_custkey JOIN sites ON sites.site_id = ord.site_id WHERE o_orderstatus = 'O'),
slog AS (SELECT * FROM ka UNION ALL SELECT site_id, customer_id, 'sub_' || o_orderkey, 'backfill_sub_' || o_orderkey || '_' || epoch(event_at)::BIGINT, event_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'active' WHEN '3-MEDIUM' THEN 'trialing' WHEN '4-NOT SPECIFIED' THEN 'past_due' ELSE 'canceled' END, cents * 2 // (1 + o_orderkey % 3),
    CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE base_currency END FROM im WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.subscription_id = 'sub_' || o_orderkey AND ka.event_at > im.event_at))"""


@query(
    "import_movements",
    f"""WITH {adapter.CTES}, {_ORD}, {_L}, {_OWN}, {_CHANGES}, {_MOVES} SELECT site_id, customer_id, kind, amount_cents, currency, object_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM mv WHERE kind IS NOT NULL""",
)
def import_movements(spark, sf_dir):
    """Movements of known and imported changes; the list is imported twice."""
    customers = held(spark, sf_dir)
    once = changes(spark, sf_dir, customers)
    again = imports.merged_changes(once, imports.subscription_changes(listed_subscriptions(spark, sf_dir), customers, connections(spark), adapter.sites(spark), NOW))
    return revenue.movements(again).select("site_id", "customer_id", "kind", "amount_cents", "currency", "object_id", stamp("occurred_at"))


_CASH = f"""kc AS (SELECT site_id, 'cus_' || o_custkey AS customer_id, CASE o_orderstatus WHEN 'F' THEN 'payment' ELSE 'one_time' END AS kind, 1::BIGINT AS amount_cents, 'USD' AS currency, 'in_' || o_orderkey AS object_id, placed AS occurred_at
    FROM ord WHERE o_orderstatus <> 'O' AND o_orderkey % 8 = 1),
ic AS (SELECT ord.site_id, customer_id, CASE o_orderstatus WHEN 'F' THEN 'payment' ELSE 'one_time' END AS kind, cents AS amount_cents, CASE WHEN o_orderkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency, 'in_' || o_orderkey AS object_id,
    CASE WHEN o_orderkey % 3 > 0 THEN placed + INTERVAL 1 MINUTE ELSE placed - INTERVAL 1 SECOND * CASE WHEN o_orderkey % 7 = 0 THEN 70000000 ELSE 0 END END AS occurred_at
    FROM ord JOIN ow ON ow.site_id = ord.site_id AND ow.processor_id = 'cus_' || o_custkey WHERE o_orderstatus <> 'O' AND o_orderkey % 10 <> 0 AND o_orderkey % 4 > 0 AND o_orderkey % 8 <> 1 AND cents <> 0
      AND (o_orderkey % 7 <> 0 OR placed - INTERVAL 70000000 SECOND >= TIMESTAMP '{SINCE}'))"""


@query(
    "import_cash",
    f"""WITH {adapter.CTES}, {_ORD}, {_L}, {_OWN}, {_CASH} SELECT r.site_id, customer_id, kind, amount_cents, CASE WHEN currency = base_currency THEN amount_cents END AS normalized_cents, object_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at
    FROM (SELECT * FROM kc UNION ALL SELECT * FROM ic) r JOIN sites USING (site_id)""",
)
def import_cash(spark, sf_dir):
    rows = revenue.normalised(booked(spark, sf_dir, held(spark, sf_dir)), adapter.sites(spark))
    return rows.select("site_id", "customer_id", "kind", "amount_cents", "normalized_cents", "object_id", stamp("occurred_at"))


@query(
    "import_report",
    f"""WITH {adapter.CTES}, {_ORD}, {_L}, {_OWN}, {_CHANGES}, {_CASH} SELECT site_id, site_id = 3 AS refused, CASE WHEN site_id <> 3 THEN '{NOW}' END AS backfilled_at, (SELECT count(*) FROM li WHERE li.site_id = s.site_id) AS customers,
    (SELECT count(*) FROM im WHERE im.site_id = s.site_id) AS subscriptions, (SELECT count(*) FROM ord JOIN ow ON ow.site_id = ord.site_id AND ow.processor_id = 'cus_' || o_custkey WHERE ord.site_id = s.site_id AND o_orderstatus <> 'O' AND o_orderkey % 10 <> 0
      AND o_orderkey % 4 > 0 AND cents <> 0 AND (o_orderkey % 7 <> 0 OR placed - INTERVAL 70000000 SECOND >= TIMESTAMP '{SINCE}')) AS invoices FROM sites s""",
)
def import_report(spark, sf_dir):
    """Rows taken of each list; what was known before counts too."""
    customers, live, sites = held(spark, sf_dir), connections(spark), adapter.sites(spark)
    counts = {
        "customers": imports.objects(listed_customers(spark, sf_dir), live).where(imports.at("$.created") >= F.lit(SINCE)),
        "subscriptions": imports.subscription_changes(listed_subscriptions(spark, sf_dir), customers, live, sites, NOW),
        "invoices": imports.invoices(listed_invoices(spark, sf_dir), customers, live, sites, SINCE).where("amount_cents <> 0"),
    }
    return imports.report(live, counts, NOW).withColumn("backfilled_at", stamp("backfilled_at"))
