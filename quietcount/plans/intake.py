"""Registered queries on ingest and data lifecycle, and their DuckDB SQL where it can say them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.functions import hosts, identity, paths
from quietcount.operators import ingest, lifecycle, metering, rollups
from quietcount.plans.traffic import _HOURLY, NOW, stamp
from quietcount.sources import adapter, tables
from quietcount.sources import requests_adapter as intake
from quietcount.sources.adapter import CTES
from quietcount.sources.referrers import KNOWN

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_KNOWN = ", ".join(f"('{h}', '{n}', '{c}')" for c, hs in KNOWN.items() for h, n in hs.items())
_REFERRERS = ", ".join("NULL" if x is None else f"'{x}'" for x in intake.REFERRERS)
_AGENTS = ", ".join(f"'{x}'" for x in intake.AGENTS)


def scrubbed_sql(rows: str) -> str:
    """CTEs up to sp: the scrubbed path of each row (id, segs without trailing blanks, done: segments that a template took, taken: what for).

    A number's neighbour before it, blanks left out, tells whether it is a month or a day; no fold is needed."""
    return f"""sg AS (SELECT id, done, taken, i, segs[i] AS s, coalesce(url_decode(segs[i]), segs[i]) AS d FROM {rows}, unnest(range(1, len(segs) + 1)) AS u(i) WHERE i > done),
    s1 AS (SELECT *, regexp_full_match(d, '[0-9]+') AS num, regexp_full_match(d, '[0-9]{{4}}') AND d BETWEEN '1900' AND '2100' AS yr FROM sg),
    s2 AS (SELECT *, num AND length(d) <= 2 AND try_cast(d AS INT) BETWEEN 1 AND 12 AND coalesce(lag(yr) OVER w, false) AS mo FROM s1 WHERE trim(s) <> '' WINDOW w AS (PARTITION BY id ORDER BY i)),
    s3 AS (SELECT *, num AND length(d) <= 2 AND try_cast(d AS INT) BETWEEN 1 AND 31 AND coalesce(lag(mo) OVER w, false) AS dy FROM s2 WINDOW w AS (PARTITION BY id ORDER BY i)),
    s4 AS (SELECT id, i, CASE WHEN contains(d, '@') THEN ':email' WHEN regexp_full_match(lower(d), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') THEN ':uuid'
      WHEN yr OR mo OR dy THEN s WHEN num THEN ':id' WHEN regexp_full_match(lower(d), '[0-9a-f]{{16,}}') THEN ':hash'
      WHEN regexp_full_match(d, '[A-Za-z0-9]{{16,}}') AND regexp_matches(d, '[0-9]') AND regexp_matches(d, '[A-Za-z]') THEN ':token' WHEN regexp_full_match(d, '[A-Za-z0-9_.-]{{25,}}') THEN ':token' ELSE s END AS o FROM s3),
    s5 AS (SELECT sg.id, sg.i, coalesce(o, s) AS o FROM sg LEFT JOIN s4 ON s4.id = sg.id AND s4.i = sg.i),
    tl AS (SELECT id, list(o ORDER BY i) AS tail FROM s5 GROUP BY id),
    sp AS (SELECT r.id, coalesce(nullif(left(array_to_string(list_concat(r.taken, coalesce(tail, [])), '/'), 255), ''), '/') AS path FROM {rows} r LEFT JOIN tl ON tl.id = r.id)"""


def segments_sql(url: str) -> str:
    path = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"string_split(regexp_replace({path}, '/+$', ''), '/')"


def params_sql(url: str) -> str:
    """The allowed parameters of a URL's query string: the last of repeated ones, without personal or opaque values."""
    pairs = f"list_filter(string_split(coalesce(regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: x <> '')"
    cells = []
    for key in paths.ALLOWED:
        value = f"url_decode(regexp_extract(list_filter({pairs}, lambda x: url_decode(string_split(x, '=')[1]) = '{key}')[-1], '^[^=]*=(.*)$', 1))"
        cells.append(f"(SELECT CASE WHEN v <> '' AND NOT contains(v, '@') AND NOT regexp_full_match(v, '[A-Za-z0-9_.-]{{25,}}') THEN left(v, 255) END FROM (SELECT {value} AS v)) AS {key}")
    return ", ".join(cells)


_PAD = "xor((unhex(sha256('test secret:' || site_id || ':' || day)) || from_hex(repeat('00', 32)))::BIT, from_hex(repeat('{byte}', 64))::BIT)::BIT::BLOB"
#: Requests, their verdicts, and the events made of the good ones, said a second time in DuckDB. Agents are listed with their profiles.
_INTAKE = f"""known(host, name, channel) AS (VALUES {_KNOWN}),
    st(site_id, domain, timezone, extra, enforce) AS (VALUES (1, 'example.com', 'UTC', 'shop.example.org', true), (2, 'example.net', 'Europe/Berlin', NULL, true), (3, 'example.org', 'Asia/Kolkata', NULL, false)),
    ag(agent, browser, browser_version, os, os_version, device_type) AS (VALUES (0, 'Firefox', '128', 'GNU/Linux', NULL, 'desktop'), (1, 'Chrome', '126', 'Windows', '10', 'desktop'), (2, 'Safari', '17', 'iOS', '17', 'mobile'), (3, 'Chrome', '126', 'Android', '14', 'mobile')),
    rq AS (SELECT page_id AS id, url, page_id % 5 AS agent, page_id % 23 = 0 AS nobody, [{_REFERRERS}][1 + page_id % {len(intake.REFERRERS)}] AS r, [{_AGENTS}][1 + page_id % 5] AS ua,
      CASE WHEN page_id % 5 = 0 THEN 1 WHEN contains(url, 'example.net') THEN 2 WHEN contains(url, 'example.org') THEN 3 ELSE 1 END AS site,
      CASE WHEN page_id % 31 <> 0 THEN page_id * 37 % 1500 END AS w, page_id % 9 = 0 AS signup, page_id % 11 = 0 AS paid, page_id % 13 = 0 AS foreign_origin,
      page_id % 17 = 0 OR page_id % 41 = 0 OR page_id % 19 = 0 AS opted, CASE WHEN page_id % 10 = 0 THEN '2001:db8:0:1::' ELSE '10.' || page_id % 4 || '.' || page_id % 20 || '.7' END AS ip,
      CASE WHEN page_id % 10 = 0 THEN NULL ELSE ['DE', 'FR', NULL, 'IN'][1 + page_id % 4] END AS country_code, TIMESTAMP '2024-01-01' + to_seconds((page_id * 420 % (20 * 86400))::BIGINT) AS moment,
      lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h, CASE WHEN page_id % 23 <> 0 THEN site END AS site_id FROM pages),
    jd AS (SELECT rq.* EXCLUDE (site_id), st.*, regexp_replace(h, '^www[.]', '') AS bare,
      concat_ws(',', CASE WHEN nobody THEN 's' END, CASE WHEN url IS NULL OR length(url) > 2048 OR NOT regexp_matches(url, '^(?i:https?)://') OR h = '' THEN 'u' END,
        CASE WHEN id % 29 = 0 THEN 'n' END, CASE WHEN id % 37 = 0 THEN 'r' END, CASE WHEN id % 43 = 0 THEN 'w' END, CASE WHEN id % 47 = 0 OR id % 53 = 0 THEN 'p' END,
        CASE WHEN id % 59 = 0 AND id % 61 <> 0 THEN 'c' END, CASE WHEN id % 67 = 0 AND id % 61 <> 0 THEN 'v' END, CASE WHEN id % 61 = 0 THEN 'c:required' END) AS errors FROM rq LEFT JOIN st ON rq.site_id = st.site_id),
    js AS (SELECT *, bare = domain OR ends_with(bare, '.' || domain) OR coalesce(bare = extra OR ends_with(bare, '.' || extra), false) AS own FROM jd),
    vd AS (SELECT *, CASE WHEN opted THEN 'opted_out' WHEN errors <> '' THEN 'invalid' WHEN site_id IS NULL THEN 'unknown_site' WHEN agent = 4 THEN 'bot'
      WHEN enforce AND foreign_origin THEN 'origin_mismatch' WHEN enforce AND NOT own THEN 'hostname_mismatch' END AS reason FROM js),
    rj AS (SELECT id AS event_id, site_id, moment AS occurred_at, reason, CASE reason WHEN 'origin_mismatch' THEN 'evil.test' WHEN 'hostname_mismatch' THEN bare END AS offending_host, errors FROM vd WHERE reason IS NOT NULL)"""

_EVENTS = f"""gd AS (SELECT *, ((moment AT TIME ZONE 'UTC') AT TIME ZONE timezone)::DATE AS day, {segments_sql('url')} AS segs FROM vd WHERE reason IS NULL),
    tp AS (SELECT id, segs, CASE WHEN site_id = 1 AND segs[2] = 'en' AND len(segs) > 2 THEN ['', 'en', ':page'] WHEN site_id = 2 AND segs[2] = 'de' AND segs[3] = 'archive' AND len(segs) > 3 THEN ['', 'de', 'archive', ':year']
      WHEN site_id = 2 AND segs[2] = 'de' AND len(segs) > 2 AND segs[3] <> 'archive' THEN ['', 'de', ':page'] ELSE ['']::VARCHAR[] END AS taken FROM gd),
    td AS (SELECT *, len(taken) AS done FROM tp), {scrubbed_sql('td')},
    g1 AS (SELECT *, coalesce(moment - lag(moment) OVER v >= INTERVAL 30 MINUTE, true) AS is_entry FROM gd WINDOW v AS (PARTITION BY site_id, ip, ua ORDER BY moment, id)),
    g2 AS (SELECT *, (sum(is_entry::INT) OVER (PARTITION BY site_id, ip, ua ORDER BY moment, id))::BIGINT AS nth, {_PAD.format(byte='36')} AS ipad, {_PAD.format(byte='5c')} AS opad FROM g1),
    g3 AS (SELECT *, left(sha256(opad || unhex(sha256(ipad || encode(site_id::VARCHAR) || from_hex('00') || encode(ip) || from_hex('00') || encode(ua)))), 32) AS visitor_hash FROM g2),
    g4 AS (SELECT *, md5(first(visitor_hash) OVER (PARTITION BY site_id, ip, ua, nth ORDER BY moment, id) || ':' || nth) AS session_hash, {params_sql('url')},
      nullif(regexp_replace(lower(regexp_extract(r, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', ''), '') AS rh FROM g3),
    g5 AS (SELECT *, CASE WHEN rh = domain OR ends_with(rh, '.' || domain) THEN NULL ELSE rh END AS referrer_host FROM g4),
    kc AS (SELECT DISTINCT referrer_host AS host, i, array_to_string(string_split(referrer_host, '.')[i:], '.') AS parent FROM g5, unnest(range(1, greatest(len(string_split(referrer_host, '.')) - 1, 1) + 1)) AS u(i) WHERE referrer_host IS NOT NULL),
    kn AS (SELECT kc.host, arg_min(name, i) AS known_name, arg_min(channel, i) AS known_channel FROM kc JOIN known ON parent = known.host GROUP BY 1)
    SELECT g5.id AS event_id, moment AS occurred_at, site_id, CASE WHEN signup THEN 'Signup' ELSE 'pageview' END AS event_name, visitor_hash, session_hash, is_entry, bare AS hostname, sp.path, referrer_host,
      CASE WHEN trim(coalesce(utm_source, '')) <> '' THEN trim(utm_source) WHEN referrer_host IS NULL THEN 'Direct' ELSE coalesce(known_name, referrer_host) END AS referrer_source,
      CASE WHEN referrer_host IS NULL AND trim(coalesce(utm_source, '')) = '' THEN 'Direct' ELSE CASE coalesce(known_channel, 'referral') WHEN 'search' THEN 'Organic Search' WHEN 'social' THEN 'Social' WHEN 'email' THEN 'Email' ELSE 'Referral' END END AS channel,
      utm_source, utm_medium, utm_campaign, utm_term, utm_content, country_code, browser, browser_version, os, os_version, device_type,
      CASE WHEN w <= 0 OR w IS NULL THEN NULL WHEN w < 576 THEN 'xs' WHEN w < 768 THEN 'sm' WHEN w < 992 THEN 'md' WHEN w < 1200 THEN 'lg' ELSE 'xl' END AS screen_class,
      CASE WHEN paid THEN g5.id END AS revenue_cents, CASE WHEN paid THEN 'USD' END AS currency, '{{"k":"' || g5.id % 10 || '"}}' AS props
    FROM g5 JOIN sp ON sp.id = g5.id JOIN ag ON ag.agent = g5.agent LEFT JOIN kn ON kn.host = referrer_host"""


def enriched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    beacons = ingest.parsed(intake.requests(spark, sf_dir))
    return ingest.enriched(beacons, intake.sites(spark), intake.salt_table(spark), intake.ranges(spark), intake.TEMPLATES)


def rejects(spark, sf_dir) -> DataFrame:
    return ingest.judged(ingest.parsed(intake.requests(spark, sf_dir)), intake.sites(spark))[1]


@query("ingest_events", f"WITH {_INTAKE}, {_EVENTS}")
def ingest_events(spark, sf_dir):
    return enriched(spark, sf_dir)[0].withColumn("props", F.to_json("props"))


@query("ingest_rejects", f"WITH {_INTAKE} SELECT * FROM rj")
def ingest_rejects(spark, sf_dir):
    return rejects(spark, sf_dir).withColumn("errors", F.array_join("errors", ","))


@query("rejections_by_reason", f"WITH {_INTAKE} SELECT site_id, reason, count(*) AS n FROM rj WHERE occurred_at >= TIMESTAMP '2023-12-31 12:00:00' AND occurred_at < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1, 2")
def rejections_by_reason(spark, sf_dir):
    return metering.rejections(rejects(spark, sf_dir), NOW)


@query("rejected_hosts", f"WITH {_INTAKE}, n AS (SELECT site_id, offending_host, count(*) AS n FROM rj WHERE offending_host IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, offending_host) AS rank FROM n QUALIFY rank <= 10")
def rejected_hosts(spark, sf_dir):
    return metering.top_hosts(rejects(spark, sf_dir), 10)


@query("scrubbed_paths", f"WITH pg AS (SELECT page_id AS id, url, {segments_sql('url')} AS segs, 0 AS done, []::VARCHAR[] AS taken FROM pages), {scrubbed_sql('pg')} SELECT page_id, path, {params_sql('url')} FROM pages JOIN sp ON sp.id = page_id")
def scrubbed_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", hosts.url_part("url", "PATH").alias("path"), hosts.url_part("url", "QUERY").alias("query"))
    return p.select("page_id", paths.scrub_path().alias("path"), *[c.alias(k) for k, c in paths.query_params().items()])


@query(
    "referrer_sources",
    f"""WITH known(host, name, channel) AS (VALUES {_KNOWN}),
    r AS (SELECT page_id, [{', '.join('NULL' if x is None else chr(39) + x + chr(39) for x in intake.REFERRERS)}][1 + page_id % {len(intake.REFERRERS)}] AS r, [NULL, 'email', 'cpc'][1 + page_id % 3] AS utm_medium,
      CASE WHEN page_id % 7 = 0 THEN ' Partner ' END AS utm_source FROM pages),
    h AS (SELECT *, regexp_replace(lower(regexp_extract(r, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS h0 FROM r),
    g AS (SELECT *, CASE WHEN h0 IS NULL OR h0 = '' OR h0 = 'example.com' OR h0 LIKE '%.example.com' THEN NULL ELSE h0 END AS host FROM h),
    c AS (SELECT DISTINCT host, i, array_to_string(string_split(host, '.')[i:], '.') AS parent FROM g, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS u(i) WHERE host IS NOT NULL),
    k AS (SELECT c.host, arg_min(name, i) AS name, arg_min(channel, i) AS channel FROM c JOIN known ON parent = known.host GROUP BY 1)
    SELECT page_id, g.host AS referrer_host, CASE WHEN trim(coalesce(utm_source, '')) <> '' THEN trim(utm_source) WHEN g.host IS NULL THEN 'Direct' ELSE coalesce(name, g.host) END AS source,
      CASE WHEN utm_medium = 'cpc' THEN 'Paid' WHEN utm_medium = 'email' THEN 'Email' WHEN g.host IS NULL AND trim(coalesce(utm_source, '')) = '' THEN 'Direct'
      ELSE CASE coalesce(channel, 'referral') WHEN 'search' THEN 'Organic Search' WHEN 'social' THEN 'Social' WHEN 'email' THEN 'Email' ELSE 'Referral' END END AS channel
    FROM g LEFT JOIN k ON k.host = g.host""",
)
def referrer_sources(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    medium = F.expr("element_at(array(cast(null AS string), 'email', 'cpc'), cast(1 + page_id % 3 AS int))")
    rows = p.select("page_id", intake._pick(intake.REFERRERS).alias("r"), F.lit("example.com").alias("domain"), medium.alias("utm_medium"), F.when(F.col("page_id") % 7 == 0, " Partner ").alias("utm_source"))
    rows = hosts.with_known(rows.withColumn("referrer_host", hosts.referrer_host("r", "domain")))
    return rows.select("page_id", "referrer_host", hosts.source().alias("source"), hosts.channel().alias("channel"))


@query(
    "hostname_policy",
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'evil.test' END AS o, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', ''), '[.]$', '') AS h, page_id % 3 = 2 AS off FROM pages),
    q AS (SELECT *, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org' AS good FROM p)
    SELECT page_id, off OR (o IS NULL AND good) AS allowed, CASE WHEN off THEN 'enforcement_disabled' WHEN o IS NOT NULL THEN 'origin_mismatch' WHEN NOT good THEN 'hostname_mismatch' ELSE 'ok' END AS reason,
      CASE WHEN off THEN NULL WHEN o IS NOT NULL THEN o WHEN NOT good THEN h END AS offending_host FROM q""",
)
def hostname_policy(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", hosts.url_part("url", "HOST").alias("url_host"))
    rows = p.select(
        "page_id", "url_host", F.when(F.col("page_id") % 13 == 0, "https://evil.test:8443/x").alias("origin"), F.lit("https://www.Example.com/").alias("domain"),
        F.array(F.lit("example.org.")).alias("extra_hostnames"), (F.col("page_id") % 3 != 2).alias("enforce_hostname"),
    )
    return rows.select("page_id", *[c.alias(k) for k, c in hosts.hostname_policy().items()])


@query(
    "cleansed_texts",
    """WITH d AS (SELECT doc_id, replace(text, chr(65533), '') AS t FROM documents),
    c AS (SELECT doc_id, CASE WHEN strlen(t) <= 4096 THEN t ELSE left(t, list_max(list_filter(range(1024, 4097), lambda n: strlen(left(t, n)) <= 4096))::BIGINT) END AS c FROM d)
    SELECT doc_id, strlen(c)::BIGINT AS n_bytes, sha256(c) AS sha256 FROM c""",
)
def cleansed_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.octet_length(ingest.cleansed(F.col("text"))).cast("long").alias("n_bytes"), F.sha2(ingest.cleansed(F.col("text")), 256).alias("sha256"))


@query(
    "sessions_30_minutes",
    f"""WITH {CTES}, g AS (SELECT event_id, user_id, coalesce(occurred_at - lag(occurred_at) OVER w >= INTERVAL 30 MINUTE, true) AS entry, occurred_at FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, event_id))
    SELECT event_id, entry AS is_entry, (sum(entry::INT) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id))::BIGINT AS session_number FROM g""",
)
def sessions_30_minutes(spark, sf_dir):
    ev = adapter.events(spark, sf_dir).drop("is_entry")
    return ingest.sessionised(ev, ["user_id"]).select("event_id", "is_entry", "session_number")


@query(
    "countries_of_addresses",
    """WITH a AS (SELECT event_id, '10.' || user_id % 6 || '.' || event_id % 256 || '.7' AS ip, ((10 * 256 + user_id % 6) * 256 + event_id % 256) * 256 + 7 AS n FROM events),
    r(a, b, c) AS (VALUES (167772160, 167837695, 'DE'), (167837696, 167903231, 'FR'), (167968768, 184549476, 'IN')) SELECT event_id, ip, c AS country_code FROM a LEFT JOIN r ON n BETWEEN r.a AND r.b""",
)
def countries_of_addresses(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = ev.select("event_id", F.concat_ws(".", F.lit(10), F.col("user_id") % 6, F.col("event_id") % 256, F.lit(7)).alias("ip"))
    return identity.with_country(rows, intake.ranges(spark))


@query(
    "screen_classes",
    """SELECT page_id, CASE WHEN w <= 0 THEN NULL WHEN w < 576 THEN 'xs' WHEN w < 768 THEN 'sm' WHEN w < 992 THEN 'md' WHEN w < 1200 THEN 'lg' ELSE 'xl' END AS screen_class FROM (SELECT page_id, page_id * 37 % 1500 AS w FROM pages)""",
)
def screen_classes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (F.col("page_id") * 37 % 1500).alias("w"))
    return p.select("page_id", identity.screen_class().alias("screen_class"))


_CUT = "cut AS (SELECT site_id, account_id, TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY * data_retention_days AS cutoff FROM sites JOIN accounts USING (account_id))"


@query("retention_counts", f"WITH {CTES}, {_CUT} SELECT account_id, occurred_at::DATE::VARCHAR AS day, count(*) AS n FROM ev JOIN cut USING (site_id) WHERE occurred_at < cutoff GROUP BY 1, 2")
def retention_counts(spark, sf_dir):
    limits = lifecycle.cutoffs(adapter.sites(spark), adapter.accounts(spark), NOW)
    return lifecycle.enforced(adapter.events(spark, sf_dir), limits)[1].withColumn("day", F.col("day").cast("string"))


@query("retention_rollup", f"WITH {CTES}, {_CUT}, e2 AS (SELECT ev.* FROM ev JOIN cut USING (site_id) WHERE occurred_at >= cutoff), h AS ({_HOURLY.replace('FROM ev', 'FROM e2')}) SELECT * REPLACE (strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket) FROM h")
def retention_rollup(spark, sf_dir):
    ev = adapter.events(spark, sf_dir)
    kept = lifecycle.enforced(ev, lifecycle.cutoffs(adapter.sites(spark), adapter.accounts(spark), NOW))[0]
    out = lifecycle.reconciled(rollups.hourly(ev), kept, datetime(2024, 1, 1), datetime(2024, 1, 21), rollups.hourly)
    return lifecycle.backstop(out, "bucket", NOW, lifecycle.HOURLY_DAYS).withColumn("bucket", stamp("bucket"))


@query("site_erasure", f"WITH {CTES} SELECT site_id, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM ev WHERE site_id = 2 GROUP BY 1")
def site_erasure(spark, sf_dir):
    return lifecycle.erased(adapter.events(spark, sf_dir), [2])[1].withColumns({"first": stamp("first"), "last": stamp("last")})


@query("purge_counts", f"WITH {CTES} SELECT occurred_at::DATE::VARCHAR AS day, count(*) AS n FROM ev WHERE site_id = 1 AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-09' AND starts_with(path, '/p/1') GROUP BY 1")
def purge_counts(spark, sf_dir):
    gone = tables.purge(adapter.events(spark, sf_dir), 1, datetime(2024, 1, 3), datetime(2024, 1, 9), "/p/1")[1]
    return gone.withColumn("day", F.col("day").cast("string"))


_PREFIXES = (("2001:db8::", 32, "de", None), ("2001:DB8:40::", 42, "fr", "de"), ("2001:db8:50::", 47, None, "in"), ("2001:db8:51::", 48, "us", None), ("2001:db8:51:8000::", 49, "gb", None), ("::ffff:10.0.0.0", 104, "nl", None))


@query(
    "countries_of_mixed_addresses",
    f"""WITH a AS (SELECT event_id, user_id % 128 AS g, event_id % 65536 AS h, event_id % 4 AS form FROM events)
    SELECT event_id, CASE form WHEN 0 THEN '10.' || g % 6 || '.' || event_id % 256 || '.7' WHEN 1 THEN '2001:db8:' || lower(hex(g)) || ':' || lower(hex(h)) || '::1' WHEN 2 THEN '2001:0DB8:' || hex(g) || ':' || hex(h) || ':0:0:0:2'
        ELSE CASE WHEN g % 2 = 0 THEN '::ffff:10.1.2.' || g ELSE '2a00::' || lower(hex(h)) END END AS ip,
      CASE WHEN form = 0 THEN CASE WHEN g % 6 = 0 THEN 'DE' WHEN g % 6 = 1 THEN 'FR' WHEN g % 6 = 2 THEN NULL ELSE 'IN' END
        WHEN form = 3 THEN CASE WHEN g % 2 = 0 THEN 'NL' END
        WHEN g = 81 THEN CASE WHEN h >= 32768 THEN 'GB' ELSE 'US' END WHEN g = 80 THEN 'IN' WHEN g BETWEEN 64 AND 127 THEN 'FR' ELSE 'DE' END AS country_code FROM a""",
)
def countries_of_mixed_addresses(spark, sf_dir):
    """IPv4 by ranges, IPv6 by nested prefixes, in several ways of writing."""
    g, h = F.col("user_id") % 128, F.col("event_id") % 65_536
    hexed = lambda c: F.lower(F.hex(c))
    form = F.col("event_id") % 4
    other = F.when(g % 2 == 0, F.concat(F.lit("::ffff:10.1.2."), g)).otherwise(F.concat(F.lit("2a00::"), hexed(h)))
    ip = F.when(form == 0, F.concat_ws(".", F.lit(10), g % 6, F.col("event_id") % 256, F.lit(7))).when(form == 1, F.concat(F.lit("2001:db8:"), hexed(g), F.lit(":"), hexed(h), F.lit("::1"))).when(
        form == 2, F.concat(F.lit("2001:0DB8:"), F.hex(g), F.lit(":"), F.hex(h), F.lit(":0:0:0:2"))
    ).otherwise(other)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ip.alias("ip"))
    table = ", ".join(f"('{n}', {b}, {c and repr(c) or 'NULL'}, {r and repr(r) or 'NULL'})" for n, b, c, r in _PREFIXES)
    prefixes = spark.sql(f"SELECT * FROM VALUES {table} AS t(network, bits, country, registered_country)")
    return identity.with_country6(identity.with_country(rows, intake.ranges(spark)), prefixes)
