"""The pipeline against brute force over its stages, on the smallest tables."""

from __future__ import annotations

import hashlib
import re

import pytest

import corpus_pipeline
from quietcount.llm import bpe, mixing, toxicity
from quietcount.llm.common import documents, labels
from tests.llm.test_near_copies import roots, shingle_set

DATA = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    tokenizers = pytest.importorskip("tokenizers")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "bpe"]
    docs = documents(spark, DATA)
    out = corpus_pipeline.run(spark, DATA).collect()

    predicted = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels(spark, DATA)).collect()}
    rows = {r.doc_id: r for r in docs.collect() if not predicted[r.doc_id]}
    first: dict[str, int] = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    kept = sorted(first.values())
    at = roots([shingle_set(rows[i].text, 5) for i in kept], 80)
    kept = [i for k, i in enumerate(kept) if at[k] == k]
    left = spark.createDataFrame([rows[i] for i in kept], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mixed(left).collect()}
    lib = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i in kept:
        ids = lib.encode(rows[i].text or "", add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * copies[i]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == sorted(want)


def test_filtering_stages_return_the_columns_of_documents(spark):
    docs = documents(spark, DATA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).schema.simpleString() == docs.schema.simpleString()
