"""Secret scans with corpus-wide ownership frequency, in native expressions.

Candidates come from three base kinds (assign, access, hex) and one of the method's own (generic:
long mixed runs outside base spans). Their positions are rebuilt from what a pattern matches and
what it leaves between matches, only for texts that hold the kind at all. The value of every
candidate is hashed and aggregated over the corpus: by distinct repositories and owners. A value under
more than MAX_OWNERS owners or in more than MAX_REPOSITORIES repositories is a widely copied example; a rarer
one with a live look (length, digits and letters, distinct characters) is owner-specific. Base spans always stay; generic spans stay
only where they are owner-specific.

Skew: counts are pre-aggregated by (hash, repository, owner) before they meet, so a value that a
third of the rows hold arrives as one row per task and owner; the join back is thin and split by AQE.

Defined results: null text is empty; a null repository or owner counts as one of its own; repeated rows
each get their row and their candidates count once per row; empty tables give empty results; further columns
are ignored; very long texts are read whole, with steps that don't grow with their matches; spans that start at one place are told
apart by kind in its listed order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import documents, written


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int  # of the value
    least: int  # characters of the value


#: The base kinds, in their listed order, and the method's own.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", "[0-9a-f]{32,}", 0, 32),
)
GENERIC = Kind("generic", "[A-Za-z0-9+/_-]{20,}", 0, 20)
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
BLOCK = 256
LIVE_CHARS, LIVE_DISTINCT = 16, 8


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def spans(kind: Kind, rank: int) -> Column:
    """Array of struct(s, rank, e, kind, value) of a kind's matches in `text`, in code points."""
    p = _quoted(kind.pattern)
    none = "cast(array() AS array<struct<s: int, rank: int, e: int, kind: string, value: string>>)"
    match = f"""named_struct('at', a.at + length(x['0']) + length(x['1']),
        'out', CASE WHEN length(x['2']) >= {kind.least} THEN concat(a.out, array(named_struct(
            's', a.at + length(x['0']), 'rank', {rank}, 'e', a.at + length(x['0']) + length(x['1']),
            'kind', '{kind.name}', 'value', x['2']))) ELSE a.out END)"""
    # blocks of matches keep what a step copies short, however many there are
    walk = f"""transform(array(arrays_zip(slice(split(text, '{p}'), 1, size(split(text, '{p}')) - 1),
                   regexp_extract_all(text, '{p}', 0), regexp_extract_all(text, '{p}', {kind.group}))),
        z -> aggregate(sequence(1, size(z), {BLOCK}), named_struct('at', 0, 'blocks', array({none})),
            (done, b) -> aggregate(slice(z, b, {BLOCK}), named_struct('at', done.at, 'out', {none}), (a, x) -> {match},
                a -> named_struct('at', a.at, 'blocks', concat(done.blocks, array(a.out)))),
            done -> flatten(done.blocks)))[0]"""
    return F.expr(f"CASE WHEN text RLIKE '{p}' THEN {walk} ELSE {none} END")


def candidates(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """uid, doc_id, repository, owner, base and generic spans of every row."""
    rows = docs.select(
        "doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.coalesce("text", F.lit("")).alias("text")
    )
    kinds = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "repository", "owner",
        *[spans(k, i).alias(k.name) for i, k in enumerate((*BASE, GENERIC))],
    )
    base = F.sort_array(F.concat(*[F.col(k.name) for k in BASE]))
    generic = F.expr(
        "filter(generic, g -> g.value RLIKE '[0-9]' AND g.value RLIKE '[A-Za-z]' AND NOT exists(base, b -> g.s < b.e AND b.s < g.e))"
    )
    return kinds.withColumn("base", base).select("uid", "doc_id", "repository", "owner", "base", generic.alias("generic"))


def ownership(found: DataFrame) -> DataFrame:
    """h, n_repositories, n_owners, n_copies of every candidate value (h: its hash)."""
    each = found.groupBy("h", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    marked = each.select("h", F.coalesce("repository", F.lit("\0")).alias("r"), F.coalesce("owner", F.lit("\0")).alias("o"), "n")
    by_repository = marked.groupBy("h", "r").agg(F.sum("n").alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n_copies"))
    by_owner = marked.groupBy("h", "o").agg(F.lit(1)).groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"))
    return by_repository.join(by_owner, "h")


def scan(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, found: array<struct<s, rank, e, kind, value, n_repositories, n_owners, verdict>> of every row."""
    rows = written(candidates(docs, repository, owner), "candidates")
    found = rows.select("uid", "repository", "owner", F.explode(F.concat("base", "generic")).alias("x")).select(
        "uid", "repository", "owner", "x.*", F.sha2("x.value", 256).alias("h")
    )
    live = (
        (F.length("value") >= LIVE_CHARS)
        & F.col("value").rlike("[0-9]")
        & F.col("value").rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_DISTINCT)
    )
    verdict = F.when((F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES), "example").when(live, "live").otherwise("unclear")
    judged = found.join(ownership(found), "h").withColumn("verdict", verdict)
    judged = judged.where("kind <> 'generic' OR verdict = 'live'")
    per_row = judged.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("s", "rank", "e", "kind", "value", "n_repositories", "n_owners", "verdict"))).alias("found")
    )
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k.name}')) AS bigint)").alias(f"n_{k.name}") for k in BASE]
    return rows.join(per_row, "uid", "left").select("doc_id", *counts, "base", "found")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(column: str) -> str:
        return f"array_join(transform({column}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"

    # the tables name no repository: what a source holds in one language stands for one
    docs = documents(spark, sf_dir).withColumn("repository", F.expr("concat(coalesce(source, '-'), '/', coalesce(lang, '-'))"))
    return scan(docs, repository="repository").select(
        "doc_id", *[f"n_{k.name}" for k in BASE],
        F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"),
        F.expr(f"coalesce({listed('found')}, '')").alias("spans"),
        F.expr("cast(size(filter(coalesce(found, array()), x -> x.verdict = 'example')) AS bigint)").alias("n_example"),
        F.expr("cast(size(filter(coalesce(found, array()), x -> x.verdict = 'live')) AS bigint)").alias("n_live"),
    )


def _sql() -> str:
    kinds = []
    for i, k in enumerate((*BASE, GENERIC)):
        p = k.pattern.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, source, repository, {i} AS rank, '{k.name}' AS kind, v AS value,
         (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s,
         length(m[i]) AS n
  FROM (SELECT doc_id, source, repository, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {k.group}) AS vs FROM d),
       unnest(range(1, len(m) + 1)) AS u(i), LATERAL (SELECT vs[i] AS v) WHERE length(v) >= {k.least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '-') AS source, coalesce(source, '-') || '/' || coalesce(lang, '-') AS repository, coalesce(text, '') AS t FROM documents), a AS ({' UNION ALL '.join(kinds)}
), f AS (
  SELECT *, s + n AS e FROM a WHERE kind <> 'generic' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM a b WHERE b.kind <> 'generic' AND b.doc_id = a.doc_id AND a.s < b.s + b.n AND b.s < a.s + a.n))
), o AS (SELECT value, count(DISTINCT source) AS n_owners, count(DISTINCT repository) AS n_repositories FROM f GROUP BY value
), j AS (
  SELECT f.*, CASE WHEN n_owners > {MAX_OWNERS} OR n_repositories > {MAX_REPOSITORIES} THEN 'example'
    WHEN length(value) >= {LIVE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND len(list_distinct(string_split(value, ''))) >= {LIVE_DISTINCT} THEN 'live' ELSE 'unclear' END AS verdict
  FROM f JOIN o USING (value)
), p AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'generic') AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
    count(*) FILTER (verdict = 'example') AS n_example, count(*) FILTER (verdict = 'live') AS n_live
  FROM j WHERE kind <> 'generic' OR verdict = 'live' GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN p USING (doc_id)
"""


ORACLE = _sql()
QUERIES = {"op2_secrets": op2_secrets}
ORACLES = {"op2_secrets": ORACLE}
