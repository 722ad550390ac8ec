"""Families of near copies that straddle the threshold: the rows compared grow with the family, and links are those of brute force."""

from __future__ import annotations

import random

import pytest

from quietcount.llm import ngram_join
from tests.llm.test_near_copies import roots, shingle_set
from tests.llm.test_operators import table


def variants(seed, copies, words, changed, edits):
    """Copies of two variants of one text that differ in `changed` words; each copy has random edits of its own."""
    rng = random.Random(seed)
    first = [f"w{rng.randrange(4_000)}" for _ in range(words)]
    second = list(first)
    for k in rng.sample(range(words), changed):
        second[k] = f"v{rng.randrange(10**6)}"
    out = []
    for i in range(copies):
        t = list((first, second)[i % 2])
        for _ in range(edits):
            t[rng.randrange(words)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(t))
    return out


@pytest.fixture
def compared(monkeypatch):
    """Pairs that were compared within families."""
    counts = []
    plain = ngram_join.differing

    def counting(pairs, fam, near):
        counts.append(pairs.count())
        return plain(pairs, fam, near)

    monkeypatch.setattr(ngram_join, "differing", counting)
    return counts


@pytest.mark.parametrize("near,width,changed", [(ngram_join.QUERY, 3, 9), (ngram_join.STAGE, 5, 14)])
def test_two_variants_grow_with_the_copies(spark, compared, near, width, changed):
    # at 60 copies the family is in many components still, so growth is measured beyond
    texts = variants(5, 60, 300, changed, 3)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(table(spark, texts), near).collect()}
    assert [got[i] for i in range(60)] == roots([shingle_set(t, width) for t in texts], near.percent)
    grown = []
    for copies in (120, 480):
        compared.clear()
        ngram_join.similar_sets(table(spark, variants(5, copies, 300, changed, 3)), near).collect()
        grown.append(sum(compared))
    assert grown[1] <= 6 * grown[0], grown


def test_large_sets_show_sampled_segments(spark):
    """Sets beyond the size from which KEYS segments are shown, with links just at the threshold."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        base = [f"b{rng.randrange(10**6)}" for _ in range(1_500)]
        for edits in (0, 25, 33, 36, 45):
            t = list(base)
            for k in rng.sample(range(0, 1_500, 6), edits):
                t[k] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(t))
    for near, width in ((ngram_join.QUERY, 3), (ngram_join.STAGE, 5)):
        got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(table(spark, texts), near).collect()}
        assert [got[i] for i in range(len(texts))] == roots([shingle_set(t, width) for t in texts], near.percent)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, long), (5, "another text of five words"), (3, long + " x"), (9, "another text of five words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_sets(docs).collect())
    assert got == [(3, 59, 3), (5, 3, 5), (5, 58, 3), (9, 3, 5)]
