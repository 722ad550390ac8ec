"""Path and query scrubbing: personal parts of a path become placeholders, few parameters stay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 255
#: Parameters that stay, and shapes of segments.
ALLOWED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")
EMAIL = "@"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NUMBER = "^[0-9]+$"
HEX = "(?i)^[0-9a-f]{16,}$"
MIXED = "^(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{16,}$"
OPAQUE = "^[A-Za-z0-9_.-]{25,}$"


def scrubbed_segments(segments: str) -> str:
    """SQL of the scrubbed array: a fold over the segments that carries which date part may follow.

    A year of 1900 to 2100 stays, and so do a month right after it and a day right after that.
    """
    d = "coalesce(try_url_decode(s), s)"
    year = f"length({d}) = 4 AND cast({d} AS int) BETWEEN 1900 AND 2100"
    month = f"a.slot = 'month' AND length({d}) <= 2 AND cast({d} AS int) BETWEEN 1 AND 12"
    day = f"a.slot = 'day' AND length({d}) <= 2 AND cast({d} AS int) BETWEEN 1 AND 31"

    def put(what: str, slot: str = "none") -> str:
        return f"named_struct('out', concat(a.out, array({what})), 'slot', '{slot}')"

    step = f"""CASE WHEN trim(s) = '' THEN named_struct('out', concat(a.out, array(s)), 'slot', a.slot)
        WHEN {d} RLIKE '{EMAIL}' THEN {put("':email'")} WHEN {d} RLIKE '{UUID}' THEN {put("':uuid'")}
        WHEN {d} RLIKE '{NUMBER}' THEN CASE WHEN {year} THEN {put('s', 'month')} WHEN {month} THEN {put('s', 'day')} WHEN {day} THEN {put('s')} ELSE {put("':id'")} END
        WHEN {d} RLIKE '{HEX}' THEN {put("':hash'")} WHEN {d} RLIKE '{MIXED}' OR {d} RLIKE '{OPAQUE}' THEN {put("':token'")} ELSE {put('s')} END"""
    return f"aggregate({segments}, named_struct('out', cast(array() AS array<string>), 'slot', 'none'), (a, s) -> {step}, a -> a.out)"


def scrub_path(path: str = "path", consumed: str = "0", matched: str = "cast(array() AS array<string>)") -> Column:
    """A path with its segments scrubbed; the first `consumed` ones are replaced by `matched` (route templates)."""
    # trailing slashes make no segments
    segments = f"split(regexp_replace(coalesce({path}, ''), '/+$', ''), '/')"
    tail = scrubbed_segments(f"slice({segments}, {consumed} + 1, size({segments}))")
    joined = f"array_join(concat({matched}, {tail}), '/')"
    whole = f"CASE WHEN {joined} = '' THEN '/' ELSE {joined} END"
    return F.expr(f"left(CASE WHEN length({whole}) > 1 AND endswith({whole}, '/') THEN left({whole}, length({whole}) - 1) ELSE {whole} END, {MAX_LENGTH})")


def query_params(query: str = "query") -> dict[str, Column]:
    """The allowed parameters of a query string; values with an @ or of 25 and more opaque characters are dropped.

    The last of repeated keys wins (their list is folded into one struct per key, so no map setting matters).
    """
    pairs = f"filter(split(coalesce({query}, ''), '&'), x -> x <> '')"
    out = {}
    for key in ALLOWED:
        own = f"filter({pairs}, x -> coalesce(try_url_decode(substring_index(x, '=', 1)), '') = '{key}')"
        value = f"try_url_decode(substring(try_element_at({own}, -1), length(substring_index(try_element_at({own}, -1), '=', 1)) + 2))"
        out[key] = F.expr(f"CASE WHEN size({own}) > 0 AND {value} <> '' AND NOT {value} RLIKE '{EMAIL}' AND NOT {value} RLIKE '{OPAQUE}' THEN left({value}, {MAX_LENGTH}) END")
    return out


def compile_templates(templates: list[str]) -> dict:
    """A trie of route templates: literal children, and under None (placeholder, node)."""
    root: dict = {}
    for template in templates:
        node = root
        for segment in template.split("/"):
            if segment.startswith(":"):
                node = node.setdefault(None, (segment, {}))[1]
            else:
                node = node.setdefault(segment, {})
    return root


def apply_templates(root: dict, segments: list[str]) -> tuple[list[str], int]:
    """Greedy, literal before placeholder, without going back: (replaced segments, how many)."""
    node, out = root, []
    for segment in segments:
        if segment in node:
            node = node[segment]
            out.append(segment)
        elif None in node:
            placeholder, node = node[None]
            out.append(placeholder)
        else:
            break
    return out, len(out)


def with_templates(rows: DataFrame, templates: dict[int, list[str]]) -> DataFrame:
    """rows (site_id, path) with matched and consumed, worked out in place, once per distinct site and path of a batch."""
    tries = {site: compile_templates(t) for site, t in templates.items()}

    @F.pandas_udf("matched array<string>, consumed int")
    def fitted(site: pd.Series, path: pd.Series) -> pd.DataFrame:
        found: dict = {}
        for key in zip(site, path, strict=True):
            if key not in found:
                # trailing slashes make no segments
                found[key] = apply_templates(tries.get(key[0], {}), (key[1] or "/").rstrip("/").split("/"))
        return pd.DataFrame([found[k] for k in zip(site, path, strict=True)], columns=["matched", "consumed"])

    if not any(tries.values()):
        return rows.withColumns({"matched": F.expr("cast(array() AS array<string>)"), "consumed": F.lit(0)})
    marked = rows.withColumn("_fit", fitted("site_id", "path"))
    return marked.withColumns({"matched": F.col("_fit.matched"), "consumed": F.col("_fit.consumed")}).drop("_fit")
