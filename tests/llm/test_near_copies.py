"""The pipeline's near-duplicate stage against brute force at 5 words and a Jaccard of 0.8."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quietcount.llm import ngram_join
from tests.llm.test_operators import TEXTS, clashing, near_copies, table


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def roots(sets, percent):
    """The least member of each set's component."""
    at = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and at[i] != at[j]:
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if r == old else r for r in at]
    return at


@pytest.mark.parametrize("words,edits,copies", [(14, 1, 20), (60, 4, 25), (150, 9, 25)])
def test_stage_against_brute_force(spark, words, edits, copies):
    texts = TEXTS + near_copies(words, 4, copies, words, edits)
    docs = clashing(table(spark, texts))
    want = roots([shingle_set(t, 5) for t in texts], 80)
    assert want != roots([shingle_set(t, 3) for t in texts], 90)
    got = {r.doc_id: r for r in ngram_join.similar_sets(docs, ngram_join.STAGE).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_stage_keeps_rows_without_ids(spark):
    """A row without doc_id stays unless an earlier document is near it."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(3, long), (None, long + " end"), (None, "only one of its kind here"), (None, None), (None, ""), (None, "x y z " * 9 + long[:200]), (None, "x y z " * 9 + long[:200]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "_stay": F.lit(2)})
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(3, long), (-1, rows[2][1]), (-1, ""), (-1, ""), (-1, rows[5][1]), (7, "")])
