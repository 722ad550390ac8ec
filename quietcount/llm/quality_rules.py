"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Each rule is (name, measure, least, most); a document is kept when every measure with a value lies
within its bounds and the base rule holds. Measures are SQL expressions over one row, so
the whole operator is a scan and a projection: no shuffle, no state, no user function.

Repeated 3-word windows are found within the row: windows are hashed to 64 bits, sorted with their
positions, and the positions of windows that meet an equal neighbour are merged to covered words.

Defined results: null text has no words and fails the base rule, as does an empty one; ratios with
a zero denominator are 0; row order, repeats and further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import documents, words


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def sql(self) -> str:
        parts = [f"{self.measure} >= {self.least}D"] if self.least is not None else []
        parts += [f"{self.measure} <= {self.most}D"] if self.most is not None else []
        return f"({' AND '.join(parts) or 'true'})"


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by at from or an they "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les des et en du une que qui dans pour par sur pas au ce il elle "
    "el los las del que por un con para una no se al lo como su"
).split()

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The threshold table of the production query.
RULES = (
    Rule("mean_word_chars", "(word_chars / greatest(n_words, 1L))", 2.0, 12.0),
    Rule("symbols_per_word", "(n_symbols / greatest(n_words, 1L))", None, 0.1),
    # every good labelled text of 50 words has a share of 0.07 and more
    Rule("stop_word_share", "(n_stop_words / greatest(n_words, 1L))", 0.05, None),
    Rule("duplicate_line_share", "(n_dup_lines / greatest(n_lines, 1L))", None, 0.5),
)


def measures(docs: DataFrame, stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS), id_column: str = "doc_id") -> DataFrame:
    """The column id_column and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(id_column, text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    windows = base.withColumn(
        "g",
        F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))"),
    )
    # sorted (hash, position) only where some window repeats at all
    paired = windows.withColumn(
        "p",
        F.expr(
            "CASE WHEN size(array_distinct(g)) < size(g) "
            "THEN sort_array(transform(g, (h, i) -> struct(h AS h, i AS i))) ELSE array() END"
        ),
    )
    placed = paired.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(p, (x, j) -> coalesce(x.h = get(p, j - 1).h, false) "
            "OR coalesce(x.h = get(p, j + 1).h, false)), x -> x.i))"
        ),
    )
    covered = F.expr(
        "aggregate(at, struct(0L AS n, -3 AS last), "
        "(s, x) -> struct(s.n + least(3, x - s.last) AS n, x AS last), s -> s.n)"
    )
    listed = list(dict.fromkeys(stop_words))
    return placed.select(
        id_column,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(listed))).cast("long").alias("n_stop_words"),
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id") -> DataFrame:
    """Measures of every document with base_failed, the names of failed rules, and kept."""
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    held = " AND ".join(r.sql() for r in rules) or "true"
    names = ", ".join(f"CASE WHEN NOT {r.sql()} THEN '{r.name}' END" for r in rules)
    return measures(docs, id_column=id_column).select(
        "*",
        F.expr(failed).alias("base_failed"),
        F.expr(f"NOT {failed} AND {held}").alias("kept"),
        F.expr(f"concat_ws(',', {names or 'null'})").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, each by its own text, with all their columns; no shuffle."""
    rows = docs.select(F.struct("*").alias("row"), "text")  # as one struct, so no column of docs can clash
    return apply_rules(rows, rules, "row").where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


_LIST = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"

ORACLE = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM a, unnest(range(1, len(w) - 1)) AS u(i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, sum(CASE WHEN nxt IS NULL THEN 3 ELSE least(3, nxt - i) END)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), m AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: list_contains({_LIST}, x)))::BIGINT AS n_stop_words
  FROM a LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) BETWEEN 2 AND 12 AS r1,
         n_symbols / greatest(n_words, 1) <= 0.1::DOUBLE AS r2,
         n_stop_words / greatest(n_words, 1) >= 0.05::DOUBLE AS r3,
         n_dup_lines / greatest(n_lines, 1) <= 0.5::DOUBLE AS r4
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
       NOT base_failed AND r1 AND r2 AND r3 AND r4 AS kept,
       concat_ws(',', CASE WHEN NOT r1 THEN 'mean_word_chars' END, CASE WHEN NOT r2 THEN 'symbols_per_word' END,
                 CASE WHEN NOT r3 THEN 'stop_word_share' END,
                 CASE WHEN NOT r4 THEN 'duplicate_line_share' END) AS failed_rules
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": ORACLE}
