"""The event table, sites and accounts as views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an event's columns are drawn from, by its id.
CYCLES = {
    "hostname": ("example.com", "www.example.com", "blog.example.com"),
    "referrer_source": ("Google", "Direct", "Bing", "news.example.org"),
    "utm_source": (None, "newsletter", None, None, "ads"),
    "utm_medium": (None, "email", "cpc"),
    "utm_campaign": (None, "spring", None, "fall"),
    "utm_term": (None, None, "shoes"),
    "utm_content": (None, "banner"),
    "country_code": ("DE", "US", "FR", "IN", None),
    "browser": ("Firefox", "Chrome", "Safari"),
    "browser_version": ("128", "126", None),
    "os": ("GNU/Linux", "Windows", "Mac", "Android"),
    "os_version": ("6", "11", "14", None),
    "device_type": ("desktop", "mobile", "tablet"),
    "screen_class": ("xs", "sm", "md", "lg", "xl"),
}
SESSION_GAP_HOURS = 12
ZONES = {1: "Etc/UTC", 2: "Europe/Berlin", 3: "Asia/Kolkata"}


def _cycle(values: tuple[str | None, ...]) -> Column:
    listed = ", ".join("cast(null AS string)" if v is None else f"'{v}'" for v in values)
    return F.expr(f"element_at(array({listed}), cast(1 + event_id % {len(values)} AS int))")


def sites(spark: SparkSession) -> DataFrame:
    """site_id, account_id, domain, timezone, k, base_currency of the three sites."""
    rows = ", ".join(f"({i}L, {1 + i % 2}L, 'example.com', '{z}', {5 if i != 2 else 25}L, 'USD')" for i, z in ZONES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(site_id, account_id, domain, timezone, k, base_currency)")


def accounts(spark: SparkSession) -> DataFrame:
    """account_id, monthly_event_limit (null: none), data_retention_days."""
    return spark.sql("SELECT * FROM VALUES (1L, 3000L, 20), (2L, cast(NULL AS bigint), 10) AS t(account_id, monthly_event_limit, data_retention_days)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide event table with event_id, user_id and the site-local date."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = raw.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        (F.col("user_id") % 3 + 1).alias("site_id"),
        F.when(F.col("event_type").isin("view", "click"), "pageview").otherwise(F.initcap("event_type")).alias("event_name"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
        "value",
    )
    zone = F.lit(None).cast("string")
    for site, name in ZONES.items():
        zone = F.when(F.col("site_id") == site, name).otherwise(zone)
    base = base.withColumn("timezone", zone).withColumn("local_date", F.expr("to_date(from_utc_timestamp(occurred_at, timezone))"))
    w = Window.partitionBy("user_id").orderBy("occurred_at", "event_id")
    new = F.coalesce(F.col("occurred_at") - F.lag("occurred_at").over(w) >= F.expr(f"INTERVAL {SESSION_GAP_HOURS} HOURS"), F.lit(True))
    purchase = F.col("event_type") == "purchase"
    return base.withColumn("is_entry", new).select(
        "event_id", "user_id", "occurred_at", "site_id", "local_date", "event_name",
        F.md5(F.concat_ws(":", "user_id", "local_date").cast("binary")).alias("visitor_hash"),
        F.md5(F.concat_ws(":s", "user_id", F.sum(F.col("is_entry").cast("int")).over(w)).cast("binary")).alias("session_hash"),
        "is_entry",
        F.concat(F.lit("/p/"), F.col("k") % 12).alias("path"),
        *[_cycle(v).alias(c) for c, v in CYCLES.items()],
        F.lit(None).cast("string").alias("referrer_host"),
        F.when(purchase, F.round(F.col("value") * 100).cast("long")).alias("revenue_cents"),
        F.when(purchase, F.when(F.col("event_id") % 5 == 0, "EUR").otherwise("USD")).alias("currency"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("props"),
    )


def _sql_cycle(values: tuple[str | None, ...]) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}][1 + event_id % {len(values)}]"


_ZONE_SQL = " ".join(f"WHEN {i} THEN '{z}'" for i, z in ZONES.items())

#: The same views as DuckDB common table expressions, for the oracles.
CTES = f"""
sites AS (SELECT * FROM (VALUES {', '.join(f"({i}, {1 + i % 2}, 'example.com', '{z}', {5 if i != 2 else 25}, 'USD')" for i, z in ZONES.items())}) t(site_id, account_id, domain, timezone, k, base_currency)),
accounts AS (SELECT * FROM (VALUES (1, 3000, 20), (2, NULL, 10)) t(account_id, monthly_event_limit, data_retention_days)),
ev0 AS (
  SELECT event_id, user_id, ts AS occurred_at, 1 + user_id % 3 AS site_id, CASE 1 + user_id % 3 {_ZONE_SQL} END AS timezone, event_type, value,
    CASE WHEN event_type IN ('view', 'click') THEN 'pageview' ELSE upper(event_type[1]) || event_type[2:] END AS event_name,
    json_extract_string(props, '$.k')::INT AS kk
  FROM events
), ev1 AS (
  SELECT *, ((occurred_at AT TIME ZONE 'UTC') AT TIME ZONE timezone)::DATE AS local_date,
    coalesce(occurred_at - lag(occurred_at) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) >= INTERVAL {SESSION_GAP_HOURS} HOURS, true) AS is_entry
  FROM ev0
), ev AS (
  SELECT event_id, user_id, occurred_at, site_id, timezone, local_date, event_name, is_entry, md5(user_id || ':' || local_date) AS visitor_hash,
    md5(user_id || ':s' || sum(is_entry::INT) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id)) AS session_hash, '/p/' || kk % 12 AS path,
    {', '.join(f'{_sql_cycle(v)} AS {c}' for c, v in CYCLES.items())},
    CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT END AS revenue_cents,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'EUR' ELSE 'USD' END END AS currency, kk::VARCHAR AS prop_k
  FROM ev1
)"""
