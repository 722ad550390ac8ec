"""URL filters: allow and block rules, and gradient-boosted trees for the URLs that no rule fits.

The trees see lexical features only, all native expressions: lengths, depth, digit ratio, character
entropy, parameter counts, and statistics of the host's suffix over the whole table (how many URLs and
how many hosts have it). They are trained by Spark ML on URLs that rules label, at most
TRAINING_ROWS of them (those with the smallest URL hashes, half of each label); everything else covers
all rows. Labelled URLs' rule hosts would give the label away, so no feature names a host.

Suffix statistics are aggregated map-side; their table has a row per suffix and is joined back by
suffix, broadcast only where a count shows it to be small.

Defined results: a null URL or one without :// has an empty host and path, no rule and the model's
verdict; without labels of both kinds the model allows; repeated rows get equal results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import pages, written

TRAINING_ROWS = 10_000
BROADCAST_ROWS = 1_000_000
TREES, DEPTH, SEED = 12, 4, 7
#: host/path prefix and verdict.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(table: DataFrame) -> DataFrame:
    """page_id, url (null: empty), host, path, query of every row."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), locate('://', url) + 3)")).otherwise("")
    out = table.select("page_id", url.alias("url"), rest.alias("rest"))
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    tail = F.expr("substring(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1)")
    out = out.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("tail", tail)
    return out.select(
        "page_id", "url", "host",
        F.regexp_extract("tail", r"(?s)^([^?#]*)", 1).alias("path"),
        F.regexp_extract("tail", r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
    )


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host and path; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


FEATURES = (
    "url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "entropy", "parameters",
    "has_fragment", "hyphens", "last_chars", "suffix_urls", "suffix_hosts",
)


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """rows with suffix (the host's last two labels), the logarithms of its URLs and hosts."""
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -2))
    hosts = rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))
    table = hosts.groupBy("suffix").agg(F.log1p(F.sum("n")).alias("suffix_urls"), F.log1p(F.count(F.lit(1))).alias("suffix_hosts"))
    table = written(table, "suffixes")
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, "suffix")


def features(rows: DataFrame) -> DataFrame:
    """rows with the lexical features."""
    chars = F.split("url", "")
    share = "aggregate(array_distinct(c), 0D, (a, x) -> a - (size(filter(c, y -> y = x)) / size(c)) * log2(size(filter(c, y -> y = x)) / size(c)))"
    out = with_suffix_statistics(rows).withColumn("c", F.when(F.col("url") == "", F.array().cast("array<string>")).otherwise(chars))
    return out.select(
        "page_id", "url", "host", "path",
        F.length("url").cast("double").alias("url_chars"),
        F.length("host").cast("double").alias("host_chars"),
        F.length("path").cast("double").alias("path_chars"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("labels"),
        (F.regexp_count("url", F.lit("[0-9]")) / F.greatest(F.length("url"), F.lit(1))).alias("digit_ratio"),
        F.expr(share).alias("entropy"),
        F.regexp_count("query", F.lit("[^&]+")).cast("double").alias("parameters"),
        F.col("url").contains("#").cast("double").alias("has_fragment"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.length(F.substring_index("path", "/", -1)).cast("double").alias("last_chars"),
        "suffix_urls", "suffix_hosts",
    )


def train(rows: DataFrame, rule_verdict: str = "rule_verdict"):
    """A fitted GBT model on a bounded sample of labelled rows, or None without both labels."""
    order = [F.xxhash64("url"), F.col("page_id")]
    sides = [
        rows.where(F.col(rule_verdict) == v).orderBy(*order).limit(TRAINING_ROWS // 2).select(*FEATURES, F.lit(y).alias("label"))
        for v, y in (("block", 1.0), ("allow", 0.0))
    ]
    sample = written(sides[0].unionByName(sides[1]), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).coalesce(4)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(assembled)


def judged(table: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) of every row."""
    rule, kind = ruled(F.col("host"), F.col("path"), rules)
    rows = features(parts(table)).withColumn("rule", rule).withColumn("rule_verdict", kind)
    rows = written(rows, "urls")
    model = train(rows)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(pages(spark, sf_dir))


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES: dict[str, str] = {}
