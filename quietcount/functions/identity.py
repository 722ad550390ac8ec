"""Who and where: keyed visitor hashes with daily salts, address normalisation, country, user agents, screens."""

from __future__ import annotations

import ipaddress
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def screen_class(width: str = "w") -> Column:
    w = F.col(width)
    return F.when(w.isNull() | (w <= 0), None).when(w < 576, "xs").when(w < 768, "sm").when(w < 992, "md").when(w < 1200, "lg").otherwise("xl")


def salts(sites: DataFrame, start: date, days: int, secret: str) -> DataFrame:
    """site_id, local_date, inner and outer pad (hex) of every site (of a frame with site_id) and local date.

    The pads are the block-sized key of HMAC-SHA256, xored with its two constants.
    """
    dates = F.explode(F.sequence(F.lit(start), F.lit(start + timedelta(days=days - 1)))).alias("local_date")
    key = F.rpad(F.sha2(F.concat_ws(":", F.lit(secret), F.col("site_id").cast("string"), F.col("local_date").cast("string")), 256), 128, "0")

    def pad(constant: int) -> Column:
        byte = f"cast(conv(substring(_key, 2 * i + 1, 2), 16, 10) AS int) ^ {constant}"
        return F.lower(F.expr(f"array_join(transform(sequence(0, 63), i -> lpad(hex({byte}), 2, '0')), '')"))

    keys = sites.select("site_id").distinct().select("site_id", dates).withColumn("_key", key)
    return keys.select("site_id", "local_date", pad(0x36).alias("inner_pad"), pad(0x5C).alias("outer_pad"))


def current_salts(table: DataFrame, today: date) -> DataFrame:
    """Salts that may still be used: of today and yesterday."""
    return table.where(F.col("local_date") >= F.lit(today - timedelta(days=1)))


def visitor_hash(ip: str = "ip", user_agent: str = "user_agent") -> Column:
    """First 16 bytes, in hex, of HMAC-SHA256(salt, site 0 ip 0 user agent); needs the salt's pads on the row."""
    zero = F.unhex(F.lit("00"))
    message = F.concat(F.col("site_id").cast("string").cast("binary"), zero, F.col(ip).cast("binary"), zero, F.coalesce(user_agent, F.lit("")).cast("binary"))
    inner = F.sha2(F.concat(F.unhex("inner_pad"), message), 256)
    return F.substring(F.sha2(F.concat(F.unhex("outer_pad"), F.unhex(inner)), 256), 1, 32)


def normal_address(ip: str | None) -> str | None:
    """IPv6 as its /64 prefix, IPv4 as it is, anything else unchanged."""
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return ip
    return str(ipaddress.ip_network(f"{address}/64", strict=False).network_address) if address.version == 6 else str(address)


def with_normal_address(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with their address normalised in place: no shuffle on an address that many share."""

    @F.pandas_udf("string")
    def prefix(addresses: pd.Series) -> pd.Series:
        return addresses.map({a: normal_address(a) for a in addresses.dropna().unique()})

    # IPv4 stays as it is and needs no Python
    return rows.withColumn(ip, F.when(F.col(ip).contains(":"), prefix(F.col(ip))).otherwise(F.col(ip)))


def ip_number(ip: str = "ip") -> Column:
    """An IPv4 address as a number; null for others."""
    o = f"split({ip}, '[.]')"
    return F.expr(f"CASE WHEN {ip} RLIKE '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' THEN ((cast({o}[0] AS bigint) * 256 + cast({o}[1] AS bigint)) * 256 + cast({o}[2] AS bigint)) * 256 + cast({o}[3] AS bigint) END")


def with_country(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with country_code from disjoint ranges (first_ip, last_ip, country, registered_country).

    Ranges are cut at /16 blocks, so the join has an equal key beside the range test, and an event meets the few ranges of its block.
    """
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("first_ip", 16), F.shiftright("last_ip", 16))))
    blocks = blocks.select("block", "first_ip", "last_ip", F.upper(F.coalesce("country", "registered_country")).alias("country_code"))
    numbered = rows.withColumn("_n", ip_number(ip)).withColumn("_b", F.shiftright("_n", 16))
    hit = (F.col("_b") == F.col("block")) & (F.col("_n") >= F.col("first_ip")) & (F.col("_n") <= F.col("last_ip"))
    return numbered.join(blocks, hit, "left").drop("_n", "_b", "block", "first_ip", "last_ip")


def hex_address(ip: str = "ip") -> Column:
    """An IPv6 address as its 32 hexadecimal digits, so that order and prefixes are those of the text; null for anything else."""
    octets = "regexp_extract_all(regexp_extract(lower({ip}), '[0-9.]+$', 0), '[0-9]+', 0)"
    tail = f"transform(array({octets.format(ip=ip)}), o -> concat(lower(hex(cast(o[0] AS int) * 256 + cast(o[1] AS int))), ':', lower(hex(cast(o[2] AS int) * 256 + cast(o[3] AS int)))))[0]"
    mapped = f"lower({ip}) RLIKE ':(?:[0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$'"
    text = f"CASE WHEN {mapped} THEN concat(regexp_extract(lower({ip}), '^(.*:)[0-9.]+$', 1), {tail}) ELSE lower({ip}) END"
    groups = "filter(split({}, ':'), g -> g <> '')"
    padded = "array_join(transform({}, g -> lpad(g, 4, '0')), '')"
    left, right = groups.format("substring_index(a, '::', 1)"), groups.format("CASE WHEN a LIKE '%::%' THEN substring(a, instr(a, '::') + 2) ELSE '' END")
    short = f"size({left}) + size({right})"
    whole = f"concat({padded.format(left)}, CASE WHEN a LIKE '%::%' THEN repeat('0000', 8 - ({short})) ELSE '' END, {padded.format(right)})"
    good = f"a RLIKE '^[0-9a-f:]+$' AND a LIKE '%:%' AND NOT a RLIKE '[0-9a-f]{{5}}' AND NOT a LIKE '%:::%' AND NOT a LIKE '%::%::%' AND CASE WHEN a LIKE '%::%' THEN {short} <= 7 ELSE {short} = 8 AND NOT a RLIKE '^:|:$' END"
    return F.expr(f"transform(array({text}), a -> CASE WHEN {good} THEN {whole} END)[0]")


def prefix_of(digits: str, bits: str) -> str:
    """SQL: the first `bits` bits of hexadecimal digits, the rest of the last digit cleared."""
    last = f"lower(hex(cast(conv(substring({digits}, {bits} div 4 + 1, 1), 16, 10) AS int) & (16 - shiftleft(1, 4 - {bits} % 4))))"
    return f"concat(substring({digits}, 1, {bits} div 4), CASE WHEN {bits} % 4 > 0 THEN {last} ELSE '' END)"


def with_country6(rows: DataFrame, prefixes: DataFrame, ip: str = "ip") -> DataFrame:
    """rows with country_code (where they have none yet) of their IPv6 addresses, from nested prefixes (network, bits, country,
    registered_country): the longest that holds an address counts.

    Each distinct address is looked up once for every length that the table has (a few dozen at most) by equal keys; no range is
    tested. Addresses of a hot prefix meet one table row each, and rows take their address's country by a join that Spark sizes."""
    table = prefix_table(prefixes)
    lengths = sorted(r[0] for r in table.select("bits").distinct().collect())  # 129 at most
    is6 = F.col(ip).contains(":")
    addresses = rows.where(is6).select(F.col(ip).alias("_ip")).distinct().withColumn("digits", hex_address("_ip")).where("digits IS NOT NULL")
    tried = addresses.select("_ip", "digits", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("bits"))
    hit = tried.withColumn("prefix", F.expr(prefix_of("digits", "bits"))).join(table, ["bits", "prefix"])
    best = hit.groupBy("_ip").agg(F.max_by("found", "bits").alias("_found"))
    # other rows get keys that find nothing, spread, so that they don't meet in one task
    key = F.when(is6, F.col(ip)).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64(*[c for c in rows.columns if c == ip or c == "event_id"]), F.lit(4096)).cast("string")))
    country = F.coalesce("country_code", "_found") if "country_code" in rows.columns else F.col("_found")
    return rows.withColumn("_key", key).join(best, F.col("_key") == F.col("_ip"), "left").withColumn("country_code", country).drop("_key", "_ip", "_found")


def prefix_table(prefixes: DataFrame) -> DataFrame:
    """Networks as text (2001:db8::) with their bits, keyed for the look-up; of equal networks the first country in the alphabet counts."""
    rows = prefixes.withColumn("digits", hex_address("network")).withColumn("found", F.upper(F.coalesce("country", "registered_country")))
    keyed = rows.where("digits IS NOT NULL AND bits BETWEEN 0 AND 128").select(F.expr(prefix_of("digits", "bits")).alias("prefix"), F.col("bits").cast("int").alias("bits"), "found")
    return keyed.groupBy("prefix", "bits").agg(F.min("found").alias("found"))


#: User-agent rules, tried in order: pattern of the name with its version, and name.
BROWSERS = ((r"Edg(?:e|A|iOS)?/(\d+)", "Microsoft Edge"), (r"OPR/(\d+)", "Opera"), (r"SamsungBrowser/(\d+)", "Samsung Browser"), (r"Firefox/(\d+)", "Firefox"),
            (r"FxiOS/(\d+)", "Firefox Mobile iOS"), (r"CriOS/(\d+)", "Chrome Mobile iOS"), (r"Chrome/(\d+)", "Chrome"), (r"Version/(\d+)[^ ]* .*Safari", "Safari"))
SYSTEMS = ((r"Windows NT (\d+)", "Windows"), (r"Android (\d+)", "Android"), (r"(?:iPhone|CPU) OS (\d+)", "iOS"), (r"Mac OS X (\d+)", "Mac"), (r"CrOS \S+ (\d+)", "Chrome OS"), (r"Linux()", "GNU/Linux"))
BOTS = r"(?i)bot\b|crawl|spider|slurp|curl/|wget/|python-|Headless|PhantomJS|Puppeteer|Playwright|Prerender"


def agent_profile(ua: str = "user_agent") -> dict[str, Column]:
    """browser, versions, system, device type and bot of a user agent."""
    text = F.coalesce(F.col(ua), F.lit(""))

    def first(rules: tuple, version: bool) -> Column:
        out = F.lit(None).cast("string") if version else F.lit("Unknown")
        for pattern, name in reversed(rules):
            value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) if version else F.lit(name)
            out = F.when(text.rlike(pattern), value).otherwise(out)
        return out

    tablet = text.rlike("iPad|Tablet") | (text.rlike("Android") & ~text.rlike("Mobile"))
    return {
        "browser": first(BROWSERS, False), "browser_version": first(BROWSERS, True), "os": first(SYSTEMS, False), "os_version": first(SYSTEMS, True),
        "device_type": F.when(tablet, "tablet").when(text.rlike("Mobile|iPhone"), "mobile").otherwise("desktop"),
        "bot": (F.trim(text) == "") | text.rlike(BOTS),
    }


def with_agent(rows: DataFrame, ua: str = "user_agent") -> DataFrame:
    """rows with their agent's profile, worked out in place: no shuffle on a user agent that many share."""
    return rows.withColumns(agent_profile(ua))
