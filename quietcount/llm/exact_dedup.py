"""Exact dedup through an extendible-hash index in shared files.

Texts are equal when their bytes are, after each run of ASCII white space became one space.

1. Keys. Every row is read once into a thin table of its key (64-bit hash and byte length of its text).
2. Directory. It starts with one slot; while a bucket holds more distinct keys than `capacity`, the bucket is split by
   the next bit of the hash, and the directory doubles where the bucket is as deep as it is. So a bucket is a range of
   keys, and the number of buckets grows with the keys. The directory addresses every row: its bucket is part of all later keys.
3. Chains. Where several rows share a key, their texts are read again and told apart by their bytes inside
   the bucket's chain. Keys of one row need no comparison.
4. Index. Owner tasks write the entries of their buckets, a folder a bucket. A chain of several texts keeps them.
5. Look-up. A row's bucket comes from the directory; in it the key finds the entry, and in a chain the bytes do.

Skew: copies collapse map-side before the shuffle (a text that is a third of the rows becomes one
row per task); all other joins are of thin rows, which AQE splits. The driver holds the directory's histogram (counts
of key ranges, some 16 for each bucket) and no keys or texts. Join sides are broadcast below BROADCAST_ROWS rows of a few
numbers; beyond, they are shuffled.

Defined results: null text counts as empty; a null doc_id sorts after all others; very long texts are compared whole; of
rows that repeat a doc_id and a text, exactly one can stay; an empty table gives an empty result; further columns are
ignored by the index and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.llm.common import WS, documents, few, written

CAPACITY = 50_000
KEY, ENTRY = ["bucket", "h", "n_bytes"], ["keep_id", "keep_raw", "group_size", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def directory(histogram: dict[int, int], capacity: int, bits: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, local depth) for each of the 2**global_depth slots.

    histogram: distinct keys by the first `bits` bits of their hash. A bucket over `capacity` is split by its next
    bit, unless all its keys share the first `bits` bits; when its depth is the directory's, the directory doubles first.
    """
    loads = [histogram]  # by depth, deepest first
    for _ in range(bits):
        above: dict[int, int] = {}
        for p, n in loads[-1].items():
            above[p >> 1] = above.get(p >> 1, 0) + n
        loads.append(above)
    depth, leaves, overfull = 0, {}, [(0, 0)]  # (leading bits, local depth)
    while overfull:
        p, d = overfull.pop()
        if d < bits and loads[bits - d].get(p, 0) > capacity:
            depth = max(depth, d + 1)  # the directory doubles
            overfull += [(p << 1 | 1, d + 1), (p << 1, d + 1)]
        else:
            leaves[p, d] = len(leaves)
    out = []
    for (p, d), bucket in leaves.items():
        out += [(slot, bucket, d) for slot in range(p << (depth - d), (p + 1) << (depth - d))]
    return sorted(out)


class Directory:
    """Addresses of keys: the slots, kept where the driver and the broadcast can hold them."""

    def __init__(self, keys: DataFrame, capacity: int):
        distinct = keys.select("h", "n_bytes").distinct()
        # the finest ranges hold a sixteenth of a bucket on average
        self.bits = max(1, min(40, (16 * max(1, distinct.count()) // capacity).bit_length()))
        prefix = F.shiftrightunsigned(F.col("h"), 64 - self.bits)
        self.histogram = {r[0]: r[1] for r in distinct.groupBy(prefix.alias("p")).agg(F.count(F.lit(1))).collect()}
        self.slots = directory(self.histogram, capacity, self.bits)
        self.depth = len(self.slots).bit_length() - 1
        self.table = keys.sparkSession.createDataFrame([(s, b) for s, b, _ in self.slots], "slot long, bucket int")

    def addressed(self, keys: DataFrame) -> DataFrame:
        """keys (h, ...) with the bucket that the directory sends them to."""
        slot = F.shiftrightunsigned(F.col("h"), 64 - self.depth) if self.depth else F.lit(0).cast("long")
        return keys.withColumn("slot", slot).join(few(self.table), "slot").drop("slot")


def keyed(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """doc_id, raw (hash of the text as it is), h, n_bytes, text_sha256 of every row: thin, so it is written once."""
    norm = docs.select("doc_id", F.xxhash64("text").alias("raw"), normalised(F.col("text")).alias("norm"))
    thin = norm.select("doc_id", "raw", key(F.col("norm")).alias("h"), F.octet_length("norm").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"))
    return written(thin, "keys")


def _texts(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    norm = docs.select("doc_id", F.xxhash64("text").alias("raw"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "raw", key(F.col("norm")).alias("h"), F.octet_length("norm").alias("n_bytes"), "norm")


def _first() -> Column:
    """The row that stays: the smallest doc_id, null last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "raw")).alias("first")


def build_index(docs: DataFrame, rows: DataFrame, found: Directory, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One entry per distinct text: bucket, h, n_bytes, chain (texts under the key), keep_id, keep_raw, group_size,
    text_sha256, norm (only in chains of several texts). Written to the shared folder by bucket.

    rows: keyed(docs)."""
    at = found.addressed(rows)
    counts = at.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), _first(), F.min("text_sha256").alias("text_sha256"))
    counts = written(counts, "counts")
    entry = ["first.doc_id AS keep_id", "first.raw AS keep_raw", "group_size", "text_sha256"]
    single = counts.where("group_size = 1").selectExpr(*KEY, "1L AS chain", *entry, "cast(null AS string) AS norm")
    crowded = written(counts.where("group_size > 1").select(*KEY), "crowded")
    # bytes tell the texts of a chain apart
    texts = _texts(docs, key).join(few(crowded), ["h", "n_bytes"]).groupBy(*KEY, "norm")
    texts = written(texts.agg(F.count(F.lit(1)).alias("group_size"), _first()).withColumn("text_sha256", F.sha2("norm", 256)), "chains")
    chain = texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chain"))
    held = texts.join(chain, KEY).selectExpr(*KEY, "chain", *entry, "CASE WHEN chain > 1 THEN norm END AS norm")
    owned = single.unionByName(held).repartition("bucket")
    return written(owned, "index", partition_by="bucket")


def look_up(docs: DataFrame, rows: DataFrame, index: DataFrame, found: Directory, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, raw and the entry (keep_id, keep_raw, group_size, text_sha256) of every row of docs that the index holds.

    rows: keyed(docs)."""
    wanted = ["doc_id", "raw", *ENTRY]
    at = found.addressed(rows)
    # a chain of one text is told from a text that the index doesn't hold by the SHA-256
    out = at.join(index.where("chain = 1").drop("norm"), [*KEY, "text_sha256"]).select(*wanted)
    chained = index.where("chain > 1")
    if chained.isEmpty():
        return out
    near = few(written(chained.select("h", "n_bytes").distinct(), "chained"))
    texts = found.addressed(_texts(docs, key).join(near, ["h", "n_bytes"], "left_semi"))
    return out.unionByName(texts.join(chained, [*KEY, "norm"]).select(*wanted))


def indexed(docs: DataFrame, capacity: int, key: Callable[[Column], Column]) -> DataFrame:
    """look_up of docs in their own index."""
    rows = keyed(docs, key)
    found = Directory(rows, capacity)
    return look_up(docs, rows, build_index(docs, rows, found, key), found, key)


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = indexed(docs, capacity, key).groupBy("doc_id", "raw", *ENTRY).agg(F.count(F.lit(1)).alias("n"))
    again = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    kept = F.expr("doc_id <=> keep_id AND raw <=> keep_raw AND nth = 1")
    return again.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns.

    Rows that go are found thin and taken out of the scan; of rows that repeat the one that stays, one is taken."""
    rows = indexed(docs, capacity, F.xxhash64).groupBy("doc_id", "raw", "keep_id", "keep_raw").agg(F.count(F.lit(1)).alias("n"))
    stays = F.expr("doc_id <=> keep_id AND raw <=> keep_raw")
    marks = written(rows.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), "raw", stays.alias("stays")), "marks")
    # rows travel as one struct, so no column of docs can clash with these
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"))
    same = F.expr("d <=> id AND x <=> raw")
    whole = named.join(few(marks), same, "left_anti").select("row.*")
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return whole
    return whole.unionByName(named.join(few(repeated), same, "left_semi").dropDuplicates(["d", "x"]).select("row.*"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
