"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietcount.llm import periodic


def brute(w, least=12):
    """All maximal runs (start, length, smallest period) of a list."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def some_text(rng):
    letters = rng.choice([1, 2, 3, 8, 50])
    w = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(90))]
    for _ in range(rng.randrange(3)):
        at, q = rng.randrange(len(w) + 1), [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 15))]
        w[at:at] = (q * 60)[: rng.randrange(1, 60)]
    return w


def tuples(runs):
    return [(int(r["start"]), int(r["end"] - r["start"]), int(r["period"])) for r in runs]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [9, 12, 20])
def test_all_runs_of_random_texts(seed, least, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(periodic, "BLOCK", 50)
    rng = random.Random(seed)
    for _ in range(25):
        texts = [some_text(rng) for _ in range(rng.randrange(12))]
        texts += texts[:3]
        for w, runs in zip(texts, periodic.runs_of_words(texts, least), strict=True):
            assert tuples(runs) == brute(w, least)
            assert periodic.collapsed(w, runs) == kept([x.decode() for x in w], tuples(runs))


def test_unequal_stretches_of_equal_hash_are_told_apart(monkeypatch):
    """With hashes that say yes to everything every run is cut where its words differ."""
    agree = periodic.Agreement(np.array([1, 2, 1, 2, 1, 3]))
    runs = np.array([(0, 6, 2)], periodic.RUN)
    assert tuples(agree.true(runs)) == [(0, 5, 2)]


def test_grammar_derives_the_text():
    rng = random.Random(1)
    text = np.array([rng.randrange(3) for _ in range(500)] + [7] + [1] * 40 + [8])
    g = periodic.Grammar(text, 7)

    def derive(s):
        return [s] if s < g.first else derive(g.left[s - g.first]) + derive(g.right[s - g.first])

    assert [x for s in g.top for x in derive(s)] == text.tolist()
    assert [len(derive(s)) for s in range(len(g.sizes))] == g.sizes.tolist()
    symbols, places = g.occurrences(2)
    assert len(symbols) > 100
    for s, at in [*zip(symbols, places, strict=True), *zip(range(len(g.at)), g.at, strict=True)]:
        assert derive(s + g.first) == text[at : at + g.sizes[s + g.first]].tolist()


def test_long_texts():
    rng = random.Random(2)
    line = [b"w%d" % rng.randrange(10**6) for _ in range(1000)]
    runs = periodic.runs_of_words([[b"a"] * 200_000, line * 100, [b"%d" % rng.randrange(10**6) for _ in range(10**5)]])
    assert [tuples(r) for r in runs] == [[(0, 200_000, 1)], [(0, 100_000, 1000)], []]


def want(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept(w, runs))]
    return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = periodic.op12_periodic(spark, "/root/testdata/sf0.001")
    assert df.columns == COLUMNS
    found = sorted(map(tuple, df.collect()))
    assert found == sorted(want(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > 10


def test_edge_cases(spark, tmp_path):
    texts = [None, "", " \n\t", "a\x85b c " * 12, "x " * 12, "x " * 11, "a b " * 6 + "c " + "a b " * 6, " ".join(f"w{i % 40}" for i in range(30_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 30), (1, "x " * 30), (1, "x " * 30), (-7, "q " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "start", "longest")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in periodic.op12_periodic(spark, str(tmp_path)).collect()]
    hand = [want(d, t) if len(t or "") < 10**5 else None for d, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted((r for r in found if r[0] != 7), key=key) == sorted((r for r in hand if r), key=key)
    assert [r[1:6] for r in found if r[0] == 7] == [(1, 0, 30_000, 40, 750_000)]
    assert periodic.op12_periodic.__doc__ and periodic.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.runs_of_words([[b"a"] * 5], 5)
