"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's value of an n-gram is how often its distinct words hold it (words are
lower-cased and marked ^word$), over the square root of the number of distinct words; values are
multiplied by the n-gram's log-count ratio between toxic and clean documents, and a logistic
regression weighs them. N-grams are hashed to 2**BITS slots, so the model has a fixed size (one
float per slot, 1 MB) and may be broadcast.

Fitting reads a bounded sample: at most MOST_TOXIC and MOST_CLEAN labelled rows, those with the
smallest hashes of their ids, and of rows that repeat an id the one of the smallest text; only rows whose crc32(doc_id) mod 3 is not 1 may be among them. It runs
in one task. Scoring is a map over all rows: a word's score is a sum over its n-grams, worked out for all new words of a
block of texts at once and cached, so memory is bounded by a block and CACHE_WORDS words.

Defined results: null and blank texts score the share of toxic labels (0.5 where there are no
labels); without labels of both classes every document scores that share; several labels of a
document count as toxic if one is; null ids and labels teach nothing; very long texts count whole; of ties in the
sample's order the smaller id comes first; equal texts score alike, rows that repeat an id and text play no part in a score, nor do further columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.common import documents, in_arrow, labels

BITS = 18
SIZES = (3, 4, 5)
MOST_TOXIC, MOST_CLEAN = 1500, 3000
THRESHOLD = 0.7
CACHE_WORDS, BLOCK_ROWS, BLOCK_WORDS = 100_000, 256, 20_000
#: Multipliers that hash an n-gram's code points.
ROLL, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, slot) of every n-gram of the words."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    text = "".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(text, np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    places, found = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * ROLL
            inside = of[: len(h)] == of[n - 1 :]
            h = (h[inside] ^ (h[inside] >> np.uint64(32))) * SPREAD
            places.append(of[: len(inside)][inside])
            found.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(found or [np.empty(0, np.int32)])


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 80, rate: float = 100.0, support: int = 3, least_ratio: float = 0.5) -> tuple[np.ndarray, float, float]:
    """(weight per slot with the ratio multiplied in, intercept, toxic share).

    N-grams in under `support` texts, or with a ratio of under `least_ratio`, get no weight.
    """
    size, share = 1 << BITS, float(toxic.mean()) if len(toxic) else 0.5
    if len(set(toxic.tolist())) < 2:
        return np.zeros(size, np.float32), math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))), share
    y = toxic.astype(float)

    def values(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots of a text's n-grams and their values."""
        bag = sorted(set(text.lower().split()))
        if not bag:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        c, n = np.unique(slots(bag)[1], return_counts=True)
        return c, (n / math.sqrt(len(bag))).astype(np.float32)

    # twice over the texts, so only n-grams that get a weight are held
    seen = np.ones((2, size))
    for text, label in zip(texts, toxic.tolist(), strict=True):
        seen[0 if label else 1, values(text)[0]] += 1
    ratio = np.log(seen[0] / (y.sum() + 2)) - np.log(seen[1] / ((1 - y).sum() + 2))
    ratio[(seen[0] + seen[1] - 2 < support) | (np.abs(ratio) < least_ratio)] = 0
    row, col, val = [], [], []
    for i, text in enumerate(texts):
        c, v = values(text)
        use = ratio[c] != 0
        row.append(np.full(use.sum(), i, np.int32))
        col.append(c[use])
        val.append(v[use])
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    val = val * ratio[col].astype(np.float32)
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b, step_w, step_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(rounds):  # gradient descent with momentum; stopping early keeps the weights small
        z = np.clip(np.bincount(row, val * w[col], len(y)) + b, -30, 30)
        slope = (1 / (1 + np.exp(-z)) - y) * weigh
        step_w = 0.9 * step_w + 0.1 * np.bincount(col, val * slope[row], size)
        step_b = 0.9 * step_b + 0.1 * slope.sum()
        w, b = w - rate * step_w, b - rate * step_b
    return (w * ratio).astype(np.float32), float(b), share


def sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """text and toxic of at most MOST_TOXIC + MOST_CLEAN labelled documents that are not held out, one row for each id."""
    marks = marks.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("doc_id")]
    picked = marks.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(
        marks.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN)
    )
    # at most MOST_TOXIC + MOST_CLEAN ids are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # of rows that repeat an id the smallest text teaches; they meet map-side first
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, marks: DataFrame) -> tuple[np.ndarray, float, float]:
    """Fits on the sample in one task; the model (a fixed 1 MB) comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            toxic += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (toxic[i], texts[i]))
        w, b, share = fit([texts[i] for i in order], np.array([toxic[i] for i in order]))
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "b": [b], "share": [share]})

    rows = in_arrow(sample(docs, marks).repartition(1), run, "w binary, b double, share double").collect()
    if not rows:  # nothing is labelled
        return fit([], np.array([], int))
    return np.frombuffer(rows[0]["w"], np.float32), rows[0]["b"], rows[0]["share"]


class Scorer:
    """Scores texts by a model; keeps the scores of words it has met."""

    def __init__(self, model: tuple[np.ndarray, float, float]):
        self.weights, self.intercept, self.share = model
        self.words: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        """Puts the scores of new words into the cache."""
        for at in range(0, len(words), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS]
            places, found = slots(part)
            scores = np.bincount(places, self.weights[found].astype(np.float64), len(part))
            self.words.update(zip(part, scores.tolist(), strict=True))

    def texts(self, texts: list[str | None]) -> list[float]:
        bags = [set((t or "").lower().split()) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        self.learn(list(set().union(*bags).difference(self.words)))
        known, out = self.words, []
        for bag in bags:
            if not bag:
                out.append(self.share)
                continue
            z = math.fsum(map(known.__getitem__, bag)) / math.sqrt(len(bag)) + self.intercept
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
        return out


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                scores = pa.array(scorer.texts(batch.column(1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def classify(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs, train(docs, marks))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; a filter inside the scan."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, marks))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                scores = np.array(scorer.texts(batch.column(text_at).to_pylist()))
                yield batch.filter(pa.array(scores < THRESHOLD))

    return in_arrow(docs, run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
