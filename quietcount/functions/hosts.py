"""Hosts: parts of URLs, referrers and their channels, the hostname policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.sources.referrers import KNOWN

#: Channel keys and names, and mediums that are paid for.
CHANNELS = {"search": "Organic Search", "social": "Social", "email": "Email", "referral": "Referral", "direct": "Direct", "paid": "Paid"}
PAID = ("cpc", "ppc", "paid", "paidsearch", "paid-search", "cpm", "display", "banner", "paid_social", "paidsocial")
DIRECT = "Direct"


def url_part(url: str, part: str) -> Column:
    """HOST, PATH or QUERY of an absolute URL; null where it can't be read."""
    pattern = {"HOST": r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", "PATH": r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", "QUERY": r"^[^?#]*\?([^#]*)"}[part]
    quoted = pattern.replace("\\", "\\\\")
    return F.expr(f"CASE WHEN {url} RLIKE '{quoted}' THEN regexp_extract({url}, '{quoted}', 1) END")


def bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def referrer_host(url: str, site_domain: str) -> Column:
    """The referrer's host without www; null for the site itself and its sub-domains."""
    host = F.nullif(bare(url_part(url, "HOST")), F.lit(""))
    domain = F.coalesce(F.col(site_domain), F.lit(""))
    own = (domain != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    return F.when(~own, host)


def known(host: str) -> Column:
    """struct(name, channel) of a host, else of its longest known parent domain (never the last label alone); null for others.

    The list is fixed and small, so it is a literal map read in place: no shuffle on a host that many rows share."""
    listed = ", ".join(f"'{h}', named_struct('name', '{n}', 'channel', '{c}')" for c, hs in KNOWN.items() for h, n in hs.items())
    labels = f"split({host}, '[.]')"
    parents = f"transform(sequence(0, greatest(size({labels}) - 2, 0)), i -> array_join(slice({labels}, i + 1, size({labels})), '.'))"
    found = f"try_element_at(filter(transform({parents}, p -> try_element_at(map({listed}), p)), x -> x IS NOT NULL), 1)"
    return F.expr(f"CASE WHEN {host} IS NOT NULL THEN {found} END")


def with_known(rows: DataFrame, host: str = "referrer_host") -> DataFrame:
    """rows with known_name and known_channel of their host."""
    marked = rows.withColumn("_known", known(host))
    return marked.withColumns({"known_name": F.col("_known.name"), "known_channel": F.col("_known.channel")}).drop("_known")


def classified(value: str) -> Column:
    """The known name of a host or URL, as the source of events has it; anything else (a name, say) trimmed. Null for blanks."""
    host = f"regexp_replace(substring_index(regexp_replace(lower(trim({value})), '^https?://', ''), '/', 1), '^www[.]', '')"
    return F.when(F.expr(f"trim({value}) <> ''"), F.coalesce(known(host)["name"], F.expr(f"trim({value})")))


def source() -> Column:
    """The source of a row with utm_source, referrer_host and known_name."""
    utm = F.trim("utm_source")
    return F.when(F.coalesce(utm, F.lit("")) != "", utm).when(F.col("referrer_host").isNull(), DIRECT).otherwise(F.coalesce("known_name", "referrer_host"))


def channel() -> Column:
    """The channel of a row with utm_source, utm_medium, referrer_host and known_channel."""
    medium = F.coalesce("utm_medium", F.lit(""))
    out = F.when(F.lower(medium).isin(*PAID), CHANNELS["paid"])
    for key, name in CHANNELS.items():
        out = out.when(medium == key, name)
    out = out.when(F.col("referrer_host").isNull() & (F.trim(F.coalesce("utm_source", F.lit(""))) == ""), CHANNELS["direct"])
    for key, name in CHANNELS.items():
        out = out.when(F.coalesce("known_channel", F.lit("referral")) == key, name)
    return out.otherwise(CHANNELS["referral"])


def normal_host(host: Column) -> Column:
    """A host without scheme, port, www. and trailing dot; null for none."""
    h = F.regexp_replace(F.lower(F.trim(host)), "^https?://", "")
    h = F.regexp_replace(F.substring_index(h, "/", 1), r":\d+$", "")
    return F.nullif(F.regexp_replace(bare(h), r"\.$", ""), F.lit(""))


def hostname_policy(origin: str = "origin", url_host: str = "url_host", domain: str = "domain", extra: str = "extra_hostnames", enforce: str = "enforce_hostname") -> dict[str, Column]:
    """allowed, reason and offending_host of a beacon: its origin, then its URL, must be at the site's domains."""
    o, u = normal_host(F.col(origin)), normal_host(F.col(url_host))
    allowed = F.transform(F.concat(F.array(domain), F.coalesce(extra, F.array().cast("array<string>"))), normal_host)

    def permitted(host: Column) -> Column:
        return F.coalesce(F.exists(allowed, lambda d: F.coalesce((host == d) | host.endswith(F.concat(F.lit("."), d)), F.lit(False))), F.lit(False))

    enforced = F.coalesce(F.col(enforce), F.lit(True))
    bad_origin, bad_url = o.isNotNull() & ~permitted(o), ~permitted(u)
    reason = F.when(~enforced, "enforcement_disabled").when(bad_origin, "origin_mismatch").when(bad_url, "hostname_mismatch").otherwise("ok")
    return {
        "allowed": ~enforced | ~(bad_origin | bad_url),
        "reason": reason,
        "offending_host": F.when(~enforced, None).when(bad_origin, o).when(bad_url, u),
    }
