"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quietcount.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(rows, least_count=3):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= least_count}


def variants_by_hand(words):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(links[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = variants_by_hand(by_hand(rows))
    assert got(spelling.op13_spelling(spark, "/root/testdata/sf0.001")) == want
    assert sum(v[0] is not None for v in want.values()) > 10


@pytest.mark.parametrize(("part", "guests"), [(1024, 8192), (3, 5)])
def test_families_chains_and_ties(spark, part, guests):
    rng = random.Random(3)
    words = {"chain": 2, "chaix": 4, "chayx": 8, "chzyx": 16, "qhzyx": 32, "qhzyxx": 64, "tiess": 5, "tiesa": 10, "tiesb": 10}
    for w in ("kitten", "straße", "étudiant", "x" * 3000, "aaaaa"):
        for _ in range(60):
            k = rng.randrange(len(w))
            c = rng.choice("abcxyzéß")
            words[rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])] = rng.randrange(1, 200)
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({c: F.lit(1) for c in ("own", "block", "home", "form", "root")})
    result = got(spelling.variants(vocabulary, part=part, guests=guests))
    assert result == variants_by_hand(words)
    assert result["chain"][1] == "qhzyxx" and result["tiess"][0] == "tiesa"


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Kitten kitten KITTEN ×kitten÷ É"), (None, "sitten"), (4, "sitten x sitten"), (4, "sitten x sitten"), (5, "a" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "total")})
    total = {r.word: r.n for r in spelling.counts(docs, spelling.mistyped).collect()}
    assert total == by_hand(rows, 1)
    assert got(spelling.variants(spelling.counts(docs.limit(0)))) == {}


def test_partial_counts_are_summed(spark):
    docs = spark.createDataFrame([(i, f"word{'abcdef'[i % 6] * 3} common") for i in range(60)], "doc_id long, text string").repartition(3)
    total = {r.word: r.n for r in spelling.counts(docs).collect()}
    assert total["common"] == 60 and total["wordaaa"] == 10


def test_block_changes_differ():
    assert len(set(spelling.CHANGES)) == 1 + spelling.CLASSES + spelling.CLASSES * (spelling.CLASSES - 1) // 2
    assert all(-c not in spelling.CHANGES for c in spelling.CHANGES if c)
