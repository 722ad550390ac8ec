"""Mixing sources to target weights by hierarchical budgeting, in native expressions.

The tree is domain -> language -> source. A leaf can give its tokens times MAX_EPOCHS, an inner node
what its children can. The budget goes down the tree: siblings share their parent's allotment by
weight, a child that cannot fill its share gives what it can and its siblings take the rest; only
what a whole family cannot give reaches the families beside it. All of it is integer arithmetic over
the leaves' totals, so a rerun gives the same allotments.

A leaf's allotment is whole epochs plus a token-prefix of the next one, whose order is a hash of
seed, epoch and doc_id. Running totals are taken per leaf and hash range (4096 ranges) and carried over
range totals, so a source with a third of all rows is spread over many tasks.

Defined results: null domain, language or source is a leaf of its own; null text has no tokens; a leaf
without tokens gives its rows once if it is allotted anything or nothing is to be given; rows that repeat doc_id,
leaf and length share one decision when rows are taken; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.llm.common import documents, words, written

SEED, MAX_EPOCHS, BUDGET_PERCENT, BROADCAST_LEAVES = 20_240_607, 2, 60, 100_000
DOMAIN = "CASE WHEN source RLIKE '^src[0-9]$' THEN 'web' ELSE 'books' END"
#: Target weights; names that are not listed weigh 1.
DOMAIN_WEIGHTS = {"web": 3, "books": 2}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
LEVELS = (("domain", DOMAIN_WEIGHTS), ("lang", LANGUAGE_WEIGHTS), ("source", SOURCE_WEIGHTS))
NONE = "(none)"


def weight(column: str, weights: dict[str, int]):
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parents: list[str], column: str) -> DataFrame:
    """nodes (capacity, w, given: the parent's allotment) with `allotted`: water-filling among siblings."""
    order = [(F.col("capacity") / F.col("w")).asc(), F.col(column).asc()]
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = family.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = "decimal(38,0)"
    left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    filled = nodes.withColumn("left", left).withColumn("w_left", F.sum("w").over(after))
    full = F.col("capacity").cast(big) * F.col("w_left") <= F.col("w").cast(big) * F.col("left")
    filled = filled.withColumn("full", full)
    first = family.orderBy("full", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumn("l", F.first("left").over(first)).withColumn("k", F.first("w_left").over(first))
    part = F.floor(F.col("w").cast(big) * F.greatest("l", F.lit(0)) / F.col("k")).cast("long")
    return filled.withColumn("allotted", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("left", "w_left", "full", "l", "k")


def leaves(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens of every row."""
    return docs.select(
        "doc_id",
        F.coalesce(F.expr(domain), F.lit(NONE)).alias("domain"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )


def budgets(rows: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """domain, lang, source, tokens, allotted of every leaf."""
    keys = [c for c, _ in LEVELS]
    tree = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    above: list[str] = []
    for depth, (column, weights) in enumerate(LEVELS):
        here = keys[: depth + 1]
        nodes = tree.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"), *([F.first("given").alias("given")] if depth else []))
        nodes = nodes.withColumn("w", weight(column, weights))
        if not depth:
            top = Window.partitionBy(F.lit(0))
            wanted = F.floor(F.sum("tokens").over(top).cast("decimal(38,0)") * percent / 100).cast("long")
            nodes = nodes.withColumn("given", F.least(wanted, F.sum("capacity").over(top)))
        given = shared_out(nodes, above, column).select(*here, F.col("allotted").alias("given"))
        tree = tree.drop("given").join(given, here)
        above = here
    return tree.select(*keys, "tokens", F.col("given").alias("allotted"))


def mixed(docs: DataFrame, domain: str = DOMAIN, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies (times taken) of every row."""
    rows = written(leaves(docs, domain), "leaves")  # thin, so the texts are read once
    keys = [c for c, _ in LEVELS]
    plan = written(budgets(rows, percent, epochs), "budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("allotted") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("epoch", whole).withColumn("rest", F.col("allotted") - F.col("epoch") * F.col("tokens")).drop("tokens", "allotted")
    # leaves are few next to rows; a tree of more than BROADCAST_LEAVES is shuffled instead
    placed = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan, keys).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).cast("binary")))
    # dealt by leaf and range: dealt by leaf, as a join may leave them, a large source would be one task's
    placed = placed.withColumn("range", F.substring("h", 1, 3)).repartition(*keys, "range")
    ranges = placed.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "range", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*keys, "range").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("running", F.sum("n_tokens").over(within)).join(ranges, [*keys, "range"])
    taken = (F.col("ahead") + F.col("running") <= F.col("rest")).cast("long")
    return placed.select("doc_id", *keys, "n_tokens", (F.col("epoch") + taken).alias("copies"))


def take(docs: DataFrame, domain: str = DOMAIN, percent: int = BUDGET_PERCENT, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as they are taken, with all their columns."""
    keys = ["doc_id", *[c for c, _ in LEVELS], "n_tokens"]
    copies = mixed(docs, domain, percent, epochs, seed).groupBy(*keys).agg(F.max("copies").alias("copies")).where("copies > 0")
    copies = copies.select(*[F.col(k).alias(f"c_{k}") for k in keys], "copies")
    # rows travel as one struct, so no column of docs can clash with these
    marked = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.coalesce(F.expr(domain), F.lit(NONE)).alias("d"), F.coalesce("lang", F.lit(NONE)).alias("l"),
        F.coalesce("source", F.lit(NONE)).alias("s"), F.size(words(F.col("text"))).cast("long").alias("n"),
    )
    on = F.expr("doc_id <=> c_doc_id AND d = c_domain AND l = c_lang AND s = c_source AND n = c_n_tokens")
    return marked.join(copies, on).select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _weights(column: str, weights: dict[str, int]) -> str:
    cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.items())
    return f"CASE {column}{cases} ELSE 1 END" if cases else "1"


def _sql() -> str:
    parts, above = [], []
    for depth, (column, weights) in enumerate(LEVELS):
        here = [c for c, _ in LEVELS[: depth + 1]]
        key, part = ", ".join(here), f"PARTITION BY {', '.join(above)}" if above else ""
        given = f"any_value(g{depth - 1}.allotted) AS given" if depth else f"least(floor((SELECT sum(tokens) FROM leaf) * {BUDGET_PERCENT} / 100)::BIGINT, (SELECT sum(capacity) FROM leaf))::BIGINT AS given"
        source = f"leaf JOIN g{depth - 1} USING ({', '.join(above)})" if depth else "leaf"
        order = f"capacity::DOUBLE / w, {column}"
        parts.append(f"""n{depth} AS (SELECT {key}, sum(capacity)::BIGINT AS capacity, {_weights(column, weights)} AS w, {given} FROM {source} GROUP BY {key}),
m{depth} AS (SELECT *, given - coalesce(sum(capacity) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM n{depth}),
f{depth} AS (SELECT *, capacity * k <= w * l AS fits FROM m{depth}),
g{depth} AS (SELECT {key}, CASE WHEN fits THEN capacity ELSE (w * greatest(first_value(l) OVER ({part} ORDER BY fits, {order}), 0)) // first_value(k) OVER ({part} ORDER BY fits, {order}) END::BIGINT AS allotted FROM f{depth})""")
        above = here
    return f"""
WITH r AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'books' END AS domain, coalesce(lang, '{NONE}') AS lang,
    coalesce(source, '{NONE}') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS capacity FROM r GROUP BY ALL),
{', '.join(parts)}, p AS (
  SELECT r.*, CASE WHEN tokens > 0 THEN allotted // tokens ELSE 0 END AS epoch, allotted - CASE WHEN tokens > 0 THEN allotted // tokens ELSE 0 END * tokens AS rest
  FROM r JOIN leaf USING (domain, lang, source) JOIN g2 USING (domain, lang, source)
), h AS (SELECT *, md5('{SEED}:' || epoch || ':' || doc_id) AS h FROM p
), c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running FROM h)
SELECT doc_id, domain, lang, source, n_tokens, (epoch + (running <= rest)::INT)::BIGINT AS copies FROM c
"""


ORACLE = _sql()
QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": ORACLE}
