"""Packing against the tokenizers library, lower bounds and a plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietcount.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    None, "", " \n", "one", "ÀÇÑß İstanbul ΣΑΣ é  x\x1cy", "a <|endoftext|>b <|startoftext|>", "it's WE'LL 'd x × ÷ ½ “q” 3f9a", "one", "tail " * 3000,
    "word " * 2047, "word " * 2048, " ".join(f"w{i}" for i in range(9000)),
]


def hold(rows, texts, size, end_id=0):
    """Rows (by _row, the text's number) against the library's ids."""
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    wanted = {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            wanted[i, k // size] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted and len(rows) == len(wanted)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    total = sum(n for _, n, _ in wanted.values())
    return len(sequences), -(-total // size)


@pytest.mark.parametrize("size", [7, 64, 2048])
def test_against_the_library(spark, size):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("piece", "length", "task", "nth", "rank", "before", "ids", "offset")})
    rows = packing.pack(docs, size=size).collect()
    made, least = hold(rows, TEXTS, size)
    assert made <= least + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs, size=5, with_ids=False).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 4), (1, 4)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4 and len({r.sequence_id for r in rows}) == 3
    assert packing.pack(docs.limit(0), with_ids=False).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.op11_packing(spark, "/root/testdata/sf0.001").collect()
    number = {d: i for i, d in enumerate(texts)}
    made, least = hold([r.__class__(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in rows], list(texts.values()), 2048)
    assert made <= least + 1


def test_patterns_fill_sequences():
    lengths = np.array([1, 2, 3, 5, 6, 10])
    found = {tuple(p) for p in packing.patterns(lengths, 10).tolist()}
    brute = {tuple(sorted(p, reverse=True)) for a in [0, *lengths] for b in [0, *lengths] for c in [0, *lengths] if sum(p := (int(a), int(b), int(c))) == 10}
    assert found == brute
    assert {tuple(p) for p in packing.patterns(lengths, 10, parts=2).tolist()} == {p for p in brute if p[2] == 0}


def test_fit_uses_whole_patterns_where_they_exist():
    h = np.zeros(101, np.int64)
    h[[60, 40, 50, 30, 20]] = [700, 200, 300, 500, 500]  # 60+40, 50+30+20, 60+20+20: nothing else fills 100
    groups = packing.plan(h, 100)
    used = defaultdict(int)
    for n, held in groups:
        for length, times in held:
            used[length] += n * times
        assert sum(x * t for x, t in held) <= 100
    assert used == {60: 700, 40: 200, 50: 300, 30: 500, 20: 500}
    assert sum(n for n, held in groups if sum(x * t for x, t in held) == 100) >= 550


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_and_stay_near_the_bound(seed):
    rng = random.Random(seed)
    h = np.zeros(301, np.int64)
    for _ in range(rng.choice([3, 500, 20_000])):
        h[min(300, 1 + int(rng.lognormvariate(4, 1)))] += 1
    groups = packing.plan(h, 300)
    used = np.zeros_like(h)
    for n, held in groups:
        assert sum(length * times for length, times in held) <= 300
        for length, times in held:
            used[length] += n * times
    assert (used == h).all()
    plain = sum(n for n, _ in packing.best_fit(h, 300))
    assert sum(n for n, _ in groups) <= 1.01 * plain + 1
