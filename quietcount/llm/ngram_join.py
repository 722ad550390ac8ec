"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct shingles of `words` words, as 64-bit hashes; the hashes' order is the global
order of n-grams. Two texts with n and m shingles and `overlap` common ones link when
100 * overlap >= percent * (n + m - overlap). The query takes 3 words and 90, the pipeline's stage 5 words and 80.

1. Candidates. The global order is cut into k fragments, k by size level; equal segments are found by their hash (a
   bucket). A text shows SHARED more non-empty segments than a linked text can change, so linked texts have SHARED
   buckets in common. (A text with fewer segments shows all and, if a linked text could change them all, its pairs of
   empty fragments.) A large set shows KEYS segments of a finer cut instead: each stays equal between linked texts with
   a chance over 0.58, so a link has fewer than SHARED of KEYS in common with a chance below 5e-13: about that of
   a collision among the 64-bit hashes of two such sets. With Near(..., every=True) they show all that counting needs.
2. Partial overlaps. The most central member of a bucket (whose buckets hold most others) is its pivot, and every other
   member is joined with it: a pair per text and pivot, however large the bucket. A text leaves out the pivots with which it has least in common, as
   long as they stand for under half of SHARED buckets: two linked texts still keep a pivot in common. The order is cut into PARTS fragments; each is joined on its
   own by (pivot, fragment) and counts the partial overlap of each pair there; the sum per pair decides the link. What one of
   the two texts alone has in a fragment is their partial difference.
3. Texts of one pivot differ as their differences do. Those not linked to the pivot need a common element in
   their differences with any partner. Rare elements first, each such element is a bucket of its own with a leader,
   and every text is compared with the leaders of its few elements. Only texts that are then in different
   components, share an element and are near enough by their distances to the pivot are compared with each other.
   As any two linked texts share a bucket, and with it a pivot, no link between components is lost.
Components come from alternating large-star and small-star rounds over the links.

Exact copies of a set collapse (map-side first) before step 1. Nothing but counts reaches the driver.
Join sides are broadcast only below BROADCAST_ROWS rows of a few integers; beyond, they are shuffled and AQE splits
hot keys.

Defined results: null and blank texts have no shingles and are linked with nothing; rows that repeat a doc_id are
linked by their own texts; a null id takes its copies' component and is nobody's; very long texts are cut into
shingles whole; of ties (equal sets, equal ranks) the smallest number leads; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietcount.llm.common import documents, few, free_name, in_arrow, written

#: Segments that a large set shows, buckets that linked texts have in common; fragments in which overlaps are counted; elements of an Arrow batch of fragments.
KEYS, SHARED, PARTS, BATCH_ELEMENTS = 64, 10, 8, 1_000_000
#: Odd multipliers for mixing hashes.
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M4
    return x ^ (x >> np.uint64(29))


def folded(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = mix(out * M1 + part)
    return mix(out * M2)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `width` words (of the whole sequence where it is shorter)."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return folded([h[i : i + 1] for i in range(len(h))]) + M3 * np.uint64(len(h))
    return np.unique(folded([h[i : len(h) - width + 1 + i] for i in range(width)]))


@dataclass(frozen=True)
class Near:
    """When two texts link: shingles of `words` words, Jaccard of `percent` hundredths or more.

    every: large sets too show enough segments that a link is found by counting, at 2 to 3 times the disk."""

    words: int
    percent: int
    every: bool = False

    def __post_init__(self) -> None:
        # below, sets two levels apart could link
        if self.words < 1 or not 67 <= self.percent <= 99:
            raise ValueError(f"not a shingle length and percentage of 67 to 99: {self}")

    def differ(self, both: int) -> int:
        """Most elements in which two linked sets with `both` elements together differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def holds(self, difference: str, both: str) -> str:
        """SQL: sets that differ in so many elements and have so many together are linked."""
        return f"{100 + self.percent} * ({difference}) <= {100 - self.percent} * ({both})"

    @cached_property
    def bounds(self) -> list[int]:
        """Largest sizes of the size levels. Sets of the first level link only when equal."""
        out = [(99 + self.percent) // (2 * (100 - self.percent))]
        while out[-1] < 1 << 40:
            out.append(out[-1] * 3 // 2 + 1)
        return out

    def levels(self, n: int) -> list[tuple[int, int, int, int]]:
        """(level, fragments, most differences, segments shown) under which a set of n shingles meets sets of its size and larger ones."""
        at = next(i for i, b in enumerate(self.bounds) if n <= b)
        out = []
        for i in [at] + [at + 1] * (100 * n >= self.percent * (self.bounds[at] + 1)):
            if i:
                most = self.differ(2 * self.bounds[i])
                own = self.differ(n + min(self.bounds[i], 100 * n // self.percent))
                if self.every or most + SHARED < KEYS:
                    out.append((i, most + most // 8 + SHARED, own, own + SHARED))
                else:
                    out.append((i, 2 * most, own, KEYS))
        return out


#: The contract of the query, and that of the pipeline's stage.
QUERY, STAGE = Near(3, 90), Near(5, 80)


def segments(u: np.ndarray, near: Near) -> tuple[np.ndarray, bool]:
    """Bucket keys of a set: hashes of the segments that it shows; whether it shows as many as it should."""
    out, full = [], True
    with np.errstate(over="ignore"):
        for level, k, most, show in near.levels(len(u)):
            f = ((u >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(f, prepend=np.uint64(k)))
            first = starts[:show]
            end = starts[show] if show < len(starts) else len(u)
            out.append(mix(np.add.reduceat(u[:end], first) + f[first] * M1 + np.uint64(level) * M2))
            full &= len(starts) >= show
            if len(starts) <= most and (near.every or show < KEYS):  # a linked text can differ in all of them, and then shares two empty fragments
                empty = sorted(set(range(k)) - set(f.tolist()))
                i, j = np.array(list(combinations(empty, 2)), np.uint64).T
                out.append(mix(i * M1 + j * M3 + np.uint64(level) * M2 + np.uint64(1)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64), full


def set_key(u: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set."""
    if not len(u):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(u + M1)).view(np.int64)), int(np.add.reduce(mix(u ^ M2)).view(np.int64))


def signed(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128-bit hash of the set), full (all segments shown), segs (bucket keys)."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()),
         T.StructField("k2", T.LongType()), T.StructField("full", T.BooleanType()), T.StructField("segs", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, k1, k2, full, segs = [], [], [], [], []
                with np.errstate(over="ignore"):
                    for text in batch.column(1).cast(pa.binary()).to_pylist():
                        u = shingles(text, near.words)
                        n.append(len(u))
                        x, y = set_key(u)
                        k1.append(x)
                        k2.append(y)
                        keys, all_shown = segments(u, near)
                        full.append(all_shown)
                        segs.append(keys)
                ends = np.cumsum([0] + [len(s) for s in segs]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(segs)))
                longs = [pa.array(x, pa.int64()) for x in (n, k1, k2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(full, pa.bool_()), lists], names=schema.names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def fragments(docs: DataFrame, wanted: DataFrame, near: Near) -> DataFrame:
    """node, pivot, n, g, part: the hashes of each wanted text in each of PARTS fragments, once for each of its pivots.

    wanted: node, doc_id, k1, pivots (array<long>, as many as the text has bucket keys at most)."""
    schema = "node long, pivot long, n long, g int, part array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)).astype(np.uint64)
        rows: list[tuple[int, int, int, int]] = []
        parts: list[np.ndarray] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))
            node, pivot, n, g = zip(*rows, strict=True)
            cols = [pa.array(node, pa.int64()), pa.array(pivot, pa.int64()), pa.array(n, pa.int64()), pa.array(g, pa.int32()), lists]
            return pa.RecordBatch.from_arrays(cols, names=["node", "pivot", "n", "g", "part"])

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = batch.column(0).cast(pa.binary()).to_pylist()
                for text, node, k1, pivots in zip(texts, *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    u = shingles(text, near.words)
                    if set_key(u)[0] != k1:  # another text under the same doc_id
                        continue
                    pieces = np.split(u, np.searchsorted(u, cut))
                    for pivot in pivots:
                        rows += [(node, pivot, len(u), g) for g in range(PARTS)]
                        parts += pieces
                        held += len(u)
                        if held >= BATCH_ELEMENTS:
                            yield batch_of()
                            rows, parts, held = [], [], 0
        if rows:
            yield batch_of()

    return in_arrow(docs.select("doc_id", "text").join(few(wanted), "doc_id").select("text", "node", "k1", "pivots"), run, schema)


def partial_overlaps(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """a, p, n_a, n_p, g, overlap, delta (hashes in one of the two only) of each pair (a, p) in each fragment g."""
    named = nodes.select("node", F.col("rep").alias("doc_id"), "k1")
    by_text = pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set("p").alias("pivots")).join(named, "node")
    by_pivot = pairs.select(F.col("p").alias("node")).distinct().join(named, "node").withColumn("pivots", F.array("node"))
    left = fragments(docs, by_text, near).select(F.col("node").alias("a"), F.col("pivot").alias("p"), F.col("n").alias("n_a"), "g", F.col("part").alias("u"))
    right = fragments(docs, by_pivot, near).select(F.col("node").alias("p"), F.col("n").alias("n_p"), "g", F.col("part").alias("v"))
    delta = F.concat(F.array_except("u", "v"), F.array_except("v", "u"))
    overlap = F.size(F.array_intersect("u", "v")).cast("long")
    return left.join(right, ["p", "g"]).select("a", "p", "n_a", "n_p", "g", overlap.alias("overlap"), delta.alias("delta"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of the edges (a, b)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each node's larger neighbours, small: its smaller ones and itself, go to its least neighbour
        out = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = out.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = out.join(least, "a")
        if large:
            new = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    mark = None
    while True:
        now = written(star(star(now, True), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def differing(pairs: DataFrame, fam: DataFrame, near: Near) -> DataFrame:
    """The links among pairs (p, a, b) of texts of the family p, by their differences to p."""
    sides = [fam.select("p", F.col("x").alias(k), F.col("n").alias(f"n_{k}"), F.col("delta").alias(f"d_{k}")) for k in ("a", "b")]
    both = pairs.distinct().join(sides[0], ["p", "a"]).join(sides[1], ["p", "b"])
    return both.where(near.holds("size(d_a) + size(d_b) - 2 * size(array_intersect(d_a, d_b))", "n_a + n_b")).select("a", "b")


def family_prefixes(fam: DataFrame, near: Near) -> DataFrame:
    """p, e, x, n, d, linked, at, short: the elements e under which a text x of the family p can meet a partner that it links to.

    Two texts of which one isn't linked to the pivot share `percent` / (100 + percent) of the other's difference at
    least, and leave out at most `alone` elements; rare elements come first."""
    el = fam.select("p", "x", "n", "d", "linked", F.explode("delta").alias("e"))
    common = el.groupBy("p", "e").agg(F.count(F.lit(1)).alias("c"), F.min("linked").alias("all_linked")).where("c > 1 AND NOT all_linked")
    el = el.join(common.drop("all_linked"), ["p", "e"])
    by_x = Window.partitionBy("p", "x")
    # elements of no other text come first in the rare-first order
    at = F.col("d") - F.count(F.lit(1)).over(by_x) + F.row_number().over(by_x.orderBy("c", "e"))
    t, alone = near.percent, f"{100 - near.percent} * n div {near.percent}"
    short = f"at <= d - greatest(ceil({t} * d / {100 + t}), CASE WHEN linked THEN 0 ELSE d - {alone} END) + 1"
    rows = el.withColumn("at", at).withColumn("short", F.expr(short))
    return rows.where(f"CASE WHEN linked THEN short ELSE short OR at <= least(d, {alone} + 1) END").drop("c")


def can_link(near: Near) -> str:
    """SQL: texts a and b of a family whose first common element is at at_a and at_b can link. After it, they have no more
    elements in common than the shorter rest of their differences."""
    fewest = "d_a + d_b - 2 * (1 + least(d_a - at_a, d_b - at_b))"
    return " AND ".join(near.holds(x, "n_a + n_b") for x in ("abs(d_a - d_b)", "abs(n_a - n_b)", fewest))


def led(rows: DataFrame, fam: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) of each text that isn't linked to its pivot with the leaders of its elements: the least different text
    of those not linked to the pivot, and of those linked to it. (What these miss, left_apart finds.)"""
    nearest = F.struct("d", "x", "n", "at")
    leaders = rows.groupBy("p", "e").agg(
        F.min(F.when(F.expr("NOT linked AND short"), nearest)).alias("u"), F.min(F.when(F.col("linked"), nearest)).alias("l")
    )
    met = rows.where("NOT linked").join(leaders, ["p", "e"]).select("p", *own_side("a"), F.explode(F.expr("array(CASE WHEN short THEN u END, l)")).alias("q"))
    pairs = met.select("*", *[F.col(f"q.{c}").alias(f"{c}_b") for c in ("x", "n", "d", "at")]).where(f"x_a <> x_b AND {can_link(near)}")
    return differing(pairs.select("p", F.col("x_a").alias("a"), F.col("x_b").alias("b")), fam, near)


def own_side(k: str, *more: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{k}") for c in ("x", "n", "d", "at", *more)]


def apart(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of elements whose texts are in several components, with comp."""
    rows = rows.join(comps.select(F.col("node").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    ends = rows.groupBy("p", "e").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    return written(rows.join(ends.select("p", "e"), ["p", "e"], "left_semi"), "apart")


def left_apart(rows: DataFrame, fam: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between texts of a family in different components."""
    def side(k: str, which: str) -> DataFrame:
        return rows.where(which).select("p", "e", *own_side(k, "comp"))

    close = F.expr(f"{can_link(near)} AND comp_a <> comp_b")
    unlinked = side("a", "NOT linked AND short").join(side("b", "NOT linked AND short"), ["p", "e"]).where(close & F.expr("x_a < x_b"))
    mixed = side("a", "NOT linked").join(side("b", "linked"), ["p", "e"]).where(close)
    pairs = unlinked.unionByName(mixed).select("p", F.col("x_a").alias("a"), F.col("x_b").alias("b"))
    return differing(pairs, fam, near)


def linked_sets(nodes: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """node, comp of every node with a link. nodes: node, rep, k1, full, segs."""
    rows = nodes.select("node", "full", F.explode("segs").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("first <> last")
    met = written(rows.join(few(written(shared.select("bucket", "size"), "shared")), "bucket"), "met")
    central = met.groupBy("node").agg(F.struct(F.sum("size").alias("s"), (-F.col("node")).alias("i")).alias("rank"))
    pivots = met.join(central, "node").groupBy("bucket").agg((-F.max("rank")["i"]).alias("p"))
    met = met.join(few(written(pivots, "pivots")), "bucket").where("node <> p").groupBy(F.col("node").alias("a"), "p", "full").agg(F.count(F.lit(1)).alias("c"))
    least_first = Window.partitionBy("a").orderBy("c", "p")  # of one text: as many rows as it shows segments
    pairs = met.withColumn("left_out", F.sum("c").over(least_first)).where(~F.col("full") | F.expr(f"left_out > {(SHARED - 1) // 2}")).select("a", "p")
    partial = written(partial_overlaps(written(pairs, "pairs"), nodes, docs, near), "partial")
    # distinct: rows that repeat doc_id and text count once
    summed = partial.select("a", "p", "n_a", "n_p", "g", "overlap").distinct().groupBy("a", "p", "n_a", "n_p").agg(F.sum("overlap").alias("overlap"))
    linked = F.expr(f"100 * overlap >= {near.percent} * (n_a + n_p - overlap)")
    stars = written(summed.select("a", "p", "n_a", (F.col("n_a") + F.col("n_p") - 2 * F.col("overlap")).alias("d"), linked.alias("linked")), "stars")
    links = stars.where("linked").select("a", F.col("p").alias("b"))
    mixed = stars.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("linked").alias("all_linked")).where("c > 1 AND NOT all_linked")
    mixed = few(written(mixed.select("p"), "mixed"))
    deltas = partial.join(mixed, "p", "left_semi").groupBy("a", "p").agg(F.collect_set(F.struct("g", "delta")).alias("ds"))
    deltas = deltas.select("a", "p", F.flatten(F.col("ds.delta")).alias("delta"))
    fam = written(stars.join(deltas, ["a", "p"]).select("p", F.col("a").alias("x"), F.col("n_a").alias("n"), "d", "linked", "delta"), "families")
    if fam.isEmpty():
        return written(components(links), "components")
    rows = written(family_prefixes(fam, near), "prefixes")
    links = written(links.unionByName(led(rows, fam, near)), "links")
    comps = written(components(links), "components")
    rows = apart(rows, comps)
    if rows.isEmpty():
        return comps
    more = written(left_apart(rows, fam, near), "more")
    return comps if more.isEmpty() else written(components(links.unionByName(more)), "components")


def similar_sets(docs: DataFrame, near: Near = QUERY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets = written(signed(docs, near), "sets")
    same = ["n_shingles", "k1", "k2"]
    classes = sets.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("full").alias("full"), F.any_value("segs").alias("segs"))
    # written, so a set keeps its number
    nodes = written(classes.where("rep IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "nodes")
    comps = linked_sets(nodes, docs, near)
    placed = nodes.select(*same, "rep", "node").join(comps, "node")
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    alone = nodes.select(*same, "rep").withColumnRenamed("rep", "own")
    reps = alone.join(placed.join(least, "comp").select(*same, "component_id"), same, "left")
    reps = reps.select(*same, F.coalesce("component_id", "own").alias("component_id"))
    out = sets.drop("segs", "full").join(reps, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, near: Near = STAGE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns, whatever their names.

    A row without doc_id is a document of its own that comes after all others."""

    stays = free_name("_stays", [*docs.columns, "row", "doc_id", "text"])

    def kept(ids: DataFrame) -> DataFrame:
        return similar_sets(ids, near).where("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()

    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return docs.join(kept(docs), F.col("doc_id") == F.col(stays), "left_semi").select(*docs.columns)
    last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    # rows travel as one struct, so no column of docs can clash; written, so a row's number stays
    number = F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1)
    numbered = written(nameless.select(F.struct("*").alias("row"), number.alias("doc_id"), "text"), "nameless")
    named = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = named.unionByName(numbered)
    return both.join(kept(both), F.col("doc_id") == F.col(stays), "left_semi").select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 2
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, t.b FROM reach r JOIN both_ways t ON r.y = t.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES = {"op3_ngram_join": ORACLE}
