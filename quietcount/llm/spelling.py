"""Groups spelling variants of the corpus's words with blocked Gram matrices of letter counts.

1. Each task counts the words of its rows (distinct words of a text at once, partial counts of at most HELD words) and the
   counts are summed by word: the vocabulary, a thin table.
2. Blocks: the letters are dealt into CLASSES classes, and a word's block is how many of each class it has, hence its length
   too. One inserted letter adds one to a class; a replaced one moves one between two classes, or none. So a word meets the
   words of its own block and of 1 + CLASSES + CLASSES (CLASSES - 1) / 2 neighbours, adjacent lengths among them; the other side
   of a pair sees it from there. Blocks of many words are dealt into parts by hash, so that no task holds more than about PART words of one
   side and GUESTS of the other, whatever the vocabulary.
3. In a task, the product of two blocks of letter counts gives the squared distances |a|^2 + |b|^2 - 2ab; pairs at most two
   apart are kept and their edits verified letter by letter.
4. Per word: near words, and the most frequent one as its form where it is frequent enough. Counts grow at each step
   towards a form, so chains end; roots are found by pointer doubling, in rounds that grow with the logarithm of the chain.

Written tables cut the lineage, so lost executors cost only their tasks. No step pairs all words of a length.

Defined results: null and blank texts have no words; rows without an id keep their words as they are (nothing to hash); repeated
rows count again; of equally frequent near words the smallest in code-point order is the form; very long texts and words are read
whole; an empty table gives no rows; further columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import documents, few, in_arrow, written

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
HELD = 200_000
CLASSES, LETTERS = 6, 64
PART, GUESTS = 1024, 8192
#: What a letter of each class adds to a word's block number: all sums and differences of two differ.
WEIGHTS = np.array([0x1F3A5C7B91, 0x2B8D14E6F3, 0x3D50A9C287, 0x4E97F16B3D, 0x5AC3728E15, 0x6B19D4F04B], np.int64)
CHANGES = [0, *WEIGHTS.tolist(), *((WEIGHTS[i] - WEIGHTS[j]).item() for i in range(CLASSES) for j in range(i))]


def counts(docs: DataFrame, change: Callable | None = None, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """word, n: how often every word of at least `least` letters stands in the whole texts. Only A-Z are lower-cased.
    change, if given, gets a row's id and returns a function of a word (every distinct one of the row) to the word to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                changed = change(d) if change else None
                for w, n in Counter(RUNS.findall(t.encode().lower().decode())).items():
                    if len(w) >= least and (changed is None or len(w := changed(w)) >= least):
                        total[w] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    partial = in_arrow(docs.select(id_column, text_column), run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words, a row each, 0 after a word's end."""
    held = np.array(words, dtype=np.str_)
    return held.view(np.uint32).reshape(len(words), -1)


def tallies(codes: np.ndarray, kinds: int) -> np.ndarray:
    """How often each kind (code point modulo kinds) stands in every row of a matrix."""
    row, column = np.nonzero(codes)
    flat = np.bincount(row * kinds + codes[row, column] % kinds, minlength=len(codes) * kinds)
    return flat.reshape(len(codes), kinds)


def blocks(words: list[str]) -> np.ndarray:
    """Block numbers: equal counts of the letter classes give equal numbers. Words are worked on in order of length."""
    out = np.zeros(len(words), np.int64)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        most = max(4_000_000 // max(len(words[order[at]]), 1), 1)
        part = order[at : at + most]
        while len(part) > 1 and len(words[part[-1]]) > 2 * len(words[part[0]]):
            part = part[: len(part) // 2]
        out[part] = tallies(matrix([words[k] for k in part]), CLASSES) @ WEIGHTS
        at += len(part)
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points (0 after the end): whether one replaced, or one letter inserted in b, makes b of a."""
    wide = max(a.shape[1], b.shape[1]) + 1
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    longer = (b > 0).sum(1) - (a > 0).sum(1)
    first = (a != b).argmax(1)  # equal rows: 0
    column = np.arange(wide - 1)
    after = column >= first[:, None]
    replaced = (longer == 0) & ((a != b).sum(1) == 1)
    inserted = (longer == 1) & ~(after & (a[:, :-1] != b[:, 1:])).any(1)
    return replaced | inserted


def near_pairs(home: list[str], guests: list[str], ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of a home word and a guest one edit away, the guest of the same length or one letter longer;
    where ordered is set for a guest, only home words before it in code-point order count."""
    a, b = matrix(home), matrix(guests)
    kind = np.float32 if max(a.shape[1], b.shape[1]) < 2048 else np.float64  # squares must be exact
    x, y = tallies(a, LETTERS).astype(kind), tallies(b, LETTERS).astype(kind)
    far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(far <= 2)
    first, second = np.array(home, dtype=object)[i], np.array(guests, dtype=object)[j]
    keep = ~ordered[j] | (first < second)
    i, j = i[keep], j[keep]
    found = [np.empty(0, bool)]
    step = max(4_000_000 // (a.shape[1] + b.shape[1]), 1)
    for k in range(0, len(i), step):
        found.append(one_edit(a[i[k : k + step]], b[j[k : k + step]]))
    good = np.concatenate(found)
    return i[good], j[good]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = blocks(batch.column(0).to_pylist())
        targets = own[:, None] - np.array(CHANGES, np.int64)[None, :]
        offsets = np.arange(0, targets.size + 1, len(CHANGES), dtype=np.int32)
        columns = [*batch.columns, pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), pa.array(targets.ravel()))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "own", "targets"])


def _met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    word, n, home = (table.column(c).combine_chunks() for c in ("word", "n", "home"))
    at_home = home.to_numpy(zero_copy_only=False)
    a, b = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    i = j = np.empty(0, np.int64)
    if len(a) and len(b):
        words = np.array(word.to_pylist(), dtype=object)
        same = (table.column("own").to_numpy() == key[0].as_py())[b]
        i, j = near_pairs(words[a].tolist(), words[b].tolist(), same)
    first, second = pa.array(a[i]), pa.array(b[j])
    return pa.Table.from_arrays([word.take(first), n.take(first), word.take(second), n.take(second)], names=["a", "a_n", "b", "b_n"])


def pairs(vocabulary: DataFrame, part: int = PART, guests: int = GUESTS) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (of a table word, n) that one inserted, deleted or replaced letter tells apart, once."""
    blocked = written(in_arrow(vocabulary.select("word", "n"), _blocked, "word string, n long, own long, targets array<long>"), "blocked")
    sizes = written(blocked.groupBy("own").agg(F.count("*").alias("words"), F.first("targets").alias("targets")), "blocks")
    coming = sizes.select(F.explode("targets").alias("own"), "words").groupBy("own").agg(F.sum("words").alias("guests"))
    parts = sizes.join(coming, "own").select(
        F.col("own").alias("block"), F.ceil(F.col("words") / part).cast("int").alias("rows"), F.ceil(F.col("guests") / guests).cast("int").alias("columns")
    )
    parts = few(written(parts, "parts"))
    row, column = F.pmod(F.xxhash64("word"), "rows").cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), "columns").cast("int")
    all_rows, all_columns = F.sequence(F.lit(0), F.col("rows") - 1), F.sequence(F.lit(0), F.col("columns") - 1)
    own = blocked.select("word", "n", "own", F.col("own").alias("block")).join(parts, "block")
    own = own.select("block", row.alias("row"), F.explode(all_columns).alias("column"), "word", "n", "own", F.lit(True).alias("home"))
    came = blocked.select("word", "n", "own", F.explode("targets").alias("block")).join(parts, "block")
    came = came.select("block", F.explode(all_rows).alias("row"), column.alias("column"), "word", "n", "own", F.lit(False).alias("home"))
    return own.unionByName(came).groupBy("block", "row", "column").applyInArrow(_met, "a string, a_n long, b string, b_n long")


def variants(vocabulary: DataFrame, factor: int = FACTOR, part: int = PART, guests: int = GUESTS) -> DataFrame:
    """Per word of a table (word, n): n_near, form and form_n (the most frequent near word if at least factor times as frequent;
    ties: the smallest) and root, the end of the chain of forms. factor is more than 1."""
    if factor <= 1:
        raise ValueError("with a factor of 1 or less, chains of forms need not end")
    found = written(pairs(vocabulary, part, guests), "pairs")
    both = found.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    often = -F.col("best.less")
    takes = often >= factor * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, often).alias("form_n")
    )
    rows = written(rows, "forms")
    ends = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # a round halves what is left of every chain; a chain has at most log(largest n) / log(factor) steps
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ends = written(ends, "roots")
        if ends.where("moved").isEmpty():
            break
        ends = ends.drop("moved")
    return rows.join(ends.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def mistyped(doc_id: int | None) -> Callable[[str], str]:
    """The contract's slips: one in 97 words of a document loses a letter, chosen by a checksum of both."""
    if doc_id is None:
        return lambda w: w
    seed = zlib.crc32(f"{doc_id}:".encode())

    def slip(w: str) -> str:
        h = zlib.crc32(w.encode(), seed)
        if h % 97:
            return w
        k = h % len(w)
        return w[:k] + w[k + 1 :]

    return slip


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts(documents(spark, sf_dir), mistyped)
    return variants(written(found.where(F.col("n") >= LEAST_COUNT), "vocabulary"))


QUERIES = {"op13_spelling": op13_spelling}
ORACLES: dict[str, str] = {}
