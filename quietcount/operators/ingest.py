"""Ingest: beacons in, enriched events and rejects out, as one batch plan that the streams reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions import hosts, identity, paths
from quietcount.schema import BEACON, PAGEVIEW
from quietcount.sources.shared import stored

MAX_URL, MAX_NAME, MAX_WIDTH, MAX_PROPS, MAX_KEY, MAX_VALUE, MAX_REVENUE, TOKEN = 2048, 120, 20_000, 24, 60, 500, 2**31 - 1, 16
MAX_TEXT_BYTES = 4_096


def query_beacon(query: str) -> Column:
    """A beacon of a query string's parameters (the last of repeated ones; properties as p[key]=value)."""
    pairs = f"""transform(filter(split(coalesce({query}, ''), '&'), x -> x <> ''), x -> struct(
        coalesce(try_url_decode(substring_index(x, '=', 1)), '') AS k, coalesce(try_url_decode(substring(x, length(substring_index(x, '=', 1)) + 2)), '') AS v))"""
    cells = [f"try_element_at(filter({pairs}, x -> x.k = '{f.name}'), -1).v AS {f.name}" for f in BEACON if f.name != "p"]
    own = f"filter({pairs}, x -> x.k RLIKE '^p\\\\[[^]]+\\\\]$')"
    last = f"filter({own}, (x, i) -> NOT exists(slice({own}, i + 2, size({own})), y -> y.k = x.k))"
    props = f"map_from_entries(transform({last}, x -> struct(substring(x.k, 3, length(x.k) - 3) AS key, x.v AS value)))"
    cells.insert(BEACON.names.index("p"), f"CASE WHEN size({own}) > 0 THEN {props} END AS p")
    return F.expr(f"struct({', '.join(cells)})")


def parsed(raw: DataFrame, body: str = "body", query: str | None = None) -> DataFrame:
    """Beacons of a JSON body, else of the query string's parameters; whole numbers are cast leniently (bad: null).

    nested_props tells that a property is an object or a list, or that the properties are no object."""
    usable = F.expr(f"coalesce(size(json_object_keys({body})) > 0, false)")
    beacon = F.from_json(body, BEACON)
    if query:
        beacon = F.when(usable, beacon).otherwise(query_beacon(query))
    kinds = F.from_json(body, "p map<string, variant>")["p"]
    nested = F.exists(F.map_values(kinds), lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    # properties that are no object at all: a text, a number, a list
    text = F.from_json(body, "p string")["p"]
    nested = F.coalesce(nested, F.lit(False)) | (text.isNotNull() & ~F.coalesce(F.ltrim(text).startswith("{"), F.lit(False)))
    read = raw.withColumn("_b", beacon).withColumn("nested_props", F.coalesce(usable & nested, F.lit(False)))
    out = read.select(*raw.columns, "_b.*", "nested_props")
    return out.withColumn("w", F.expr("try_cast(w AS int)")).withColumn("v", F.expr("try_cast(v AS bigint)"))


def privacy_drop() -> Column:
    """Whether a request opted out or was only fetched ahead."""
    flag = [F.coalesce(F.trim(c), F.lit("")) == "1" for c in ("sec_gpc", "dnt")]
    return flag[0] | flag[1] | F.coalesce(F.lower("sec_purpose"), F.lit("")).contains("prefetch")


def contract_errors() -> Column:
    """Names of the fields that break the payload contract."""
    nul = "\u0000"
    texts = [F.when(F.coalesce(F.contains(c, F.lit(nul)), F.lit(False)), f"{c}:null_byte") for c in ("u", "n", "r", "c")]
    host = hosts.url_part("u", "HOST")
    props = F.coalesce(F.size(F.map_keys("p")), F.lit(0))
    checks = [
        F.when(F.coalesce(F.length("s"), F.lit(0)) != TOKEN, "s"),
        F.when(F.col("u").isNull() | (F.length("u") > MAX_URL) | ~F.col("u").rlike("(?i)^https?://") | (F.coalesce(host, F.lit("")) == ""), "u"),
        F.when(F.length("n") > MAX_NAME, "n"),
        F.when(F.length("r") > MAX_URL, "r"),
        F.when((F.col("w") < 0) | (F.col("w") > MAX_WIDTH), "w"),
        F.when(F.col("nested_props") | (props > MAX_PROPS) | F.coalesce(F.exists(F.map_keys("p"), lambda k: F.length(k) > MAX_KEY), F.lit(False))
               | F.coalesce(F.exists(F.map_values("p"), lambda v: F.length(v) > MAX_VALUE), F.lit(False)), "p"),
        F.when(F.col("c").isNotNull() & ~F.col("c").rlike("^[A-Za-z]{3}$"), "c"),
        F.when((F.col("v") < 0) | (F.col("v") > MAX_REVENUE), "v"),
        F.when(F.col("v").isNotNull() & (F.coalesce("c", F.lit("")) == ""), "c:required"),
    ]
    return F.array_compact(F.array(*checks, *texts))


def cleansed(column: Column) -> Column:
    """Text without NUL and invalid UTF-8, of MAX_TEXT_BYTES at most (a cut character is dropped)."""
    whole = F.replace(F.replace(F.make_valid_utf8(column), F.lit("�"), F.lit("")), F.lit("\u0000"), F.lit(""))
    cut = F.replace(F.make_valid_utf8(F.substring(F.encode(whole, "UTF-8"), 1, MAX_TEXT_BYTES).cast("string")), F.lit("�"), F.lit(""))
    return F.when(F.octet_length(whole) <= MAX_TEXT_BYTES, whole).otherwise(cut)


def sessionised(rows: DataFrame, keys: list[str], seconds: int = 1_800, order: str = "event_id") -> DataFrame:
    """rows with session_number, is_entry and session_at (the time of the session's first event): a gap of `seconds` or more starts a session.

    Keyed on what doesn't rotate (site, address, agent), a session runs on over the daily salt change. A key is worked off hour by hour, so one
    that holds a third of all rows (a proxy) is spread over as many tasks as it has hours. What an hour can't know of those before it, a
    row per key and hour tells: whether its first event starts a session, how many started before, and when the running one did.
    """
    at = F.unix_micros("occurred_at")
    # a struct of the keys is never null, so rows with null keys meet in the join as they do in a window
    rows = rows.withColumns({"_key": F.struct(*keys), "_hour": F.date_trunc("hour", "occurred_at")})
    w = Window.partitionBy("_key", "_hour").orderBy("occurred_at", order)
    rows = rows.withColumn("_starts", at - F.lag(at).over(w) >= seconds * 1_000_000)  # null for the hour's first event
    started = F.when(F.col("_starts"), F.col("occurred_at"))
    hours = rows.groupBy("_key", "_hour").agg(F.min("occurred_at").alias("_first"), F.max("occurred_at").alias("_last"), F.count_if("_starts").alias("_n"), F.max(started).alias("_started"))
    c = Window.partitionBy("_key").orderBy("_hour")
    before = c.rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("_new", F.coalesce(F.unix_micros("_first") - F.lag(F.unix_micros("_last")).over(c) >= seconds * 1_000_000, F.lit(True)))
    new, begun = F.col("_new").cast("int"), F.when(F.col("_new"), F.col("_first"))
    hours = hours.withColumns({
        "_ahead": F.coalesce(F.sum(F.col("_n") + new).over(before), F.lit(0)) + new,
        "_running": F.coalesce(begun, F.max(F.coalesce("_started", begun)).over(before)),
    })
    rows = rows.withColumns({"_nth": F.count_if("_starts").over(w), "_at": F.max(started).over(w)}).join(hours.select("_key", "_hour", "_new", "_ahead", "_running"), ["_key", "_hour"])
    rows = rows.withColumns({"is_entry": F.coalesce("_starts", "_new"), "session_number": F.col("_ahead") + F.col("_nth"), "session_at": F.coalesce("_at", "_running")})
    return rows.drop("_key", "_hour", "_starts", "_nth", "_at", "_new", "_ahead", "_running")


def judged(beacons: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(beacons that are let in, rejects) of parsed beacons with request columns ip, user_agent, origin, sec_gpc, dnt, sec_purpose, received_at, event_id.

    Order: privacy gates, contract, site, bots, hostname policy. Rejects carry site_id, occurred_at, reason and offending_host.
    """
    dims = sites.select("site_id", "public_token", "domain", "timezone", "extra_hostnames", "enforce_hostname")
    rows = beacons.withColumn("occurred_at", F.col("received_at")).withColumn("url_host", hosts.url_part("u", "HOST"))
    rows = rows.join(dims, rows["s"] == F.col("public_token"), "left").withColumn("errors", contract_errors())
    rows = identity.with_agent(rows)
    policy = hosts.hostname_policy()
    reason = (
        F.when(privacy_drop(), "opted_out").when(F.size("errors") > 0, "invalid").when(F.col("site_id").isNull(), "unknown_site")
        .when(F.col("bot"), "bot").when(~policy["allowed"], policy["reason"])
    )
    rows = rows.withColumn("reason", reason).withColumn("offending_host", F.when(F.col("reason").isin("origin_mismatch", "hostname_mismatch"), policy["offending_host"]))
    return rows.where("reason IS NULL"), rows.where("reason IS NOT NULL").select("event_id", "site_id", "occurred_at", "reason", "offending_host", "errors")


def enriched(beacons: DataFrame, sites: DataFrame, salt_table: DataFrame, ranges: DataFrame, templates: dict[int, list[str]] | None = None, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of parsed beacons, judged; then identity, sessions, paths, referrers. prefixes: countries of IPv6 networks.

    Beacons that are let in are written down once in the shared folder before their sessions are told, as these read them twice.
    """
    good, rejects = judged(beacons, sites)
    good = good.withColumn("local_date", F.expr("to_date(from_utc_timestamp(occurred_at, timezone))"))
    good = identity.with_country(good, ranges)
    good = identity.with_normal_address(identity.with_country6(good, prefixes) if prefixes is not None else good)
    good = good.drop("errors", "reason", "offending_host", "bot", "public_token", "extra_hostnames", "enforce_hostname", "origin", "sec_gpc", "dnt", "sec_purpose", "received_at")
    good = sessionised(stored(good, "let_in"), ["site_id", "ip", "user_agent"])
    good = good.join(salt_table, ["site_id", "local_date"]).withColumn("visitor_hash", identity.visitor_hash())
    # the session's id is the visitor's hash of its first event, by the salt of that event's day, with its number: the raw key goes no further
    first_day = F.expr("to_date(from_utc_timestamp(session_at, timezone))")
    good = good.drop("inner_pad", "outer_pad").withColumn("session_date", first_day).join(salt_table.withColumnRenamed("local_date", "session_date"), ["site_id", "session_date"], "left")
    first_hash = F.coalesce(identity.visitor_hash(), F.col("visitor_hash"))
    good = good.withColumn("session_hash", F.md5(F.concat_ws(":", first_hash, "session_number").cast("binary")))
    good = good.withColumn("path", F.coalesce(hosts.url_part("u", "PATH"), F.lit("/"))).withColumn("query", hosts.url_part("u", "QUERY"))
    good = paths.with_templates(good, templates or {})
    good = good.withColumn("path", paths.scrub_path("path", "consumed", "matched")).withColumns(paths.query_params())
    good = hosts.with_known(good.withColumn("referrer_host", hosts.referrer_host("r", "domain")))
    props = F.when(F.coalesce(F.size("p"), F.lit(0)) > 0, F.transform_values(F.transform_keys("p", lambda k, v: cleansed(k)), lambda k, v: cleansed(v)))
    name = F.coalesce(F.nullif(F.trim("n"), F.lit("")), F.lit(PAGEVIEW))
    events = good.select(
        "event_id", "occurred_at", "site_id", cleansed(name).alias("event_name"), "visitor_hash", "session_hash", "is_entry",
        hosts.bare(F.col("url_host")).alias("hostname"), "path", "referrer_host", hosts.source().alias("referrer_source"), hosts.channel().alias("channel"),
        "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "country_code", "browser", "browser_version", "os", "os_version", "device_type",
        identity.screen_class().alias("screen_class"), F.col("v").alias("revenue_cents"), F.upper("c").alias("currency"), props.alias("props"),
    )
    return events, rejects
