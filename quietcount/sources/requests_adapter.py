"""Beacon requests made from the pages table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.functions.identity import salts

AGENTS = (
    "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.5 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
)
REFERRERS = ("https://www.google.com/search?q=x", "https://news.ycombinator.com/item?id=1", None, "https://a.b.out.reddit.com/r/x", "https://unknown.site.test/a", "https://www.example.com/from")
TEMPLATES = {1: ["/en/:page"], 2: ["/de/:page", "/de/archive/:year"], 3: []}


def _pick(values: tuple[str | None, ...], column: str = "page_id") -> Column:
    listed = ", ".join("cast(null AS string)" if v is None else f"'{v}'" for v in values)
    return F.expr(f"element_at(array({listed}), cast(1 + {column} % {len(values)} AS int))")


def sites(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"({i}L, 'sitetoken000000{i}', '{d}', '{z}', array({x}), {e})"
        for i, d, z, x, e in ((1, "example.com", "Etc/UTC", "'shop.example.org'", "true"), (2, "example.net", "Europe/Berlin", "", "true"), (3, "example.org", "Asia/Kolkata", "", "false"))
    )
    return spark.sql(f"SELECT site_id, public_token, domain, timezone, cast(extra_hostnames AS array<string>) AS extra_hostnames, enforce_hostname FROM VALUES {rows} AS t(site_id, public_token, domain, timezone, extra_hostnames, enforce_hostname)")


def ranges(spark: SparkSession) -> DataFrame:
    """Disjoint address ranges: some /16 of 10.0.0.0/8, one over a /8 edge."""
    rows = ((10 << 24, (10 << 24) + 65_535, "'de'", "'us'"), ((10 << 24) + 65_536, (10 << 24) + 2 * 65_536 - 1, "NULL", "'fr'"), ((10 << 24) + 3 * 65_536, (11 << 24) + 100, "'in'", "NULL"))
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({a}L, {b}L, {c}, {d})' for a, b, c, d in rows)} AS t(first_ip, last_ip, country, registered_country)")


def salt_table(spark: SparkSession) -> DataFrame:
    return salts(sites(spark), date(2023, 12, 31), 23, "test secret")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, body (JSON), received_at and request columns. Some bodies break the contract, each field of it somewhere."""
    breaks = lambda n: F.col("page_id") % n == 0
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    site = F.when(F.col("page_id") % 5 == 0, 1).when(F.col("url").contains("example.net"), 2).when(F.col("url").contains("example.org"), 3).otherwise(1)
    body = F.struct(
        F.when(F.col("page_id") % 23 == 0, "nobody").otherwise(F.concat(F.lit("sitetoken000000"), site)).alias("s"), F.col("url").alias("u"),
        F.when(breaks(29), F.repeat(F.lit("n"), F.lit(121))).when(breaks(9), "Signup").alias("n"),
        F.when(breaks(37), F.concat(F.lit("https://a.test/"), F.repeat(F.lit("r"), F.lit(2048)))).otherwise(_pick(REFERRERS)).alias("r"),
        F.when(breaks(43), "20001").when(F.col("page_id") % 31 == 0, "wide").otherwise((F.col("page_id") * 37 % 1500).cast("string")).alias("w"),
        F.create_map(F.lit("k"), (F.col("page_id") % 10).cast("string")).alias("p"),
        F.when(~breaks(61), F.when(breaks(59), "US1").when(breaks(11) | breaks(67), "usd")).alias("c"),
        F.when(breaks(61), "5").when(breaks(67), "-5").when(breaks(11), F.col("page_id").cast("string")).alias("v"),
    )
    # properties that are a list, and one that is an object
    text = F.to_json(body)
    text = F.when(breaks(47), F.regexp_replace(text, r'"p":\{[^}]*\}', '"p":[1,2]')).when(breaks(53), F.regexp_replace(text, r'"p":\{[^}]*\}', '"p":{"k":{}}')).otherwise(text)
    ip = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("2001:db8:0:1::"), F.hex(F.col("page_id") % 50))).otherwise(
        F.concat_ws(".", F.lit(10), F.col("page_id") % 4, F.col("page_id") % 20, F.lit(7))
    )
    flag = lambda n: F.when(F.col("page_id") % n == 0, "1")
    return p.select(
        F.col("page_id").alias("event_id"), text.alias("body"), ip.alias("ip"), _pick(AGENTS).alias("user_agent"),
        F.when(F.col("page_id") % 13 == 0, "https://evil.test").alias("origin"), flag(17).alias("sec_gpc"), flag(41).alias("dnt"),
        F.when(F.col("page_id") % 19 == 0, "prefetch").alias("sec_purpose"),
        F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, page_id * 420 % (20 * 86400))").alias("received_at"),
    )
