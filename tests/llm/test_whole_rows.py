"""Filters keep and drop rows by their own text; samples are bounded; large sets in the join."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quietcount.llm import ngram_join, quality_rules, toxicity
from tests.llm.test_near_copies import roots, shingle_set
from tests.llm.test_operators import clashing, table


def test_good_rows_without_and_with_shared_ids(spark):
    good, bad = "the cat and the dog sat on a mat in the sun " * 1 + " ".join(f"word{i} the" for i in range(40)), "bad"
    rows = [(1, good), (1, bad), (None, good), (None, bad), (2, bad), (2, None), (3, good), (3, good)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("k"), "row": F.lit(1), "n_words": F.lit(2), "base_failed": F.lit(3)}))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, good), (1, good), (3, good), (3, good)]
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_training_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 6)
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} {i % 3}") for i in range(4000)] + [(None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic long")
    rows = toxicity.sample(docs, marks).collect()
    assert len(rows) == 11 and sum(r.toxic for r in rows) == 5
    assert all(r.text.endswith(" 0") for r in rows)


def test_stage_takes_columns_of_its_own_names(spark):
    docs = table(spark, ["a b c d e f g", "a b c d e f g", "other words are in this one here"]).withColumns({"_stays": F.lit(1), "_STAYS_": F.lit(2), "row": F.lit(3)})
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def near_threshold(rng, size, near):
    """Two sets of about `size` elements that only just link."""
    out = near.differ(2 * size)
    both = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
    half = out // 2
    a, b = both[:size], np.concatenate([both[: size - half], both[size : size + half]])
    return np.unique(a), np.unique(b)


def test_measured_recall_of_sampled_segments():
    """Linked pairs at the threshold share SHARED segments or more, with all segments shown and with a sample."""
    rng = np.random.default_rng(4)
    for words, percent in ((3, 90), (5, 80)):
        sampled, every = ngram_join.Near(words, percent), ngram_join.Near(words, percent, every=True)
        for size in (500, 1500, 4000):
            assert sampled.levels(size)[0][3] == ngram_join.KEYS < every.levels(size)[0][3]
            for near, trials in ((sampled, 200), (every, 10)):
                for _ in range(trials):
                    a, b = near_threshold(rng, size, near)
                    common = len(np.intersect1d(ngram_join.segments(a, near)[0], ngram_join.segments(b, near)[0]))
                    assert common >= ngram_join.SHARED, (near, size, common)


def test_join_with_all_segments_shown(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"b{rng.randrange(10**6)}" for _ in range(900)]
        for edits in (0, 15, 20, 22, 27):
            t = list(base)
            for k in rng.sample(range(0, 900, 6), edits):
                t[k] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(t))
    near = ngram_join.Near(3, 90, every=True)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(table(spark, texts), near).collect()}
    assert [got[i] for i in range(len(texts))] == roots([shingle_set(t, 3) for t in texts], 90)
