"""Texts with more matches than a block, and values in many repositories of one owner."""

from __future__ import annotations

import re

from quietcount.llm import secrets

SCHEMA = "doc_id long, text string, repository string, source string"


def test_more_matches_than_blocks(spark):
    text = "é ".join(f"token=abcdefgh{i}" for i in range(secrets.BLOCK * 2 + 3))
    many = [text[: text.index("=abcdefgh256") + 12], text, None, "", "token=short"]
    docs = spark.createDataFrame([(i, t, "r", "o") for i, t in enumerate(many)], SCHEMA)
    got = {r.doc_id: r for r in secrets.scan(docs, repository="repository").collect()}
    for i, t in enumerate(many):
        want = [(m.start(), m.end()) for m in re.finditer(r"token=[a-z0-9]{8,}", t or "")]
        assert [(x.s, x.e) for x in got[i].base] == want and got[i].n_assign == len(want)


def test_both_counts_tell_examples(spark):
    wide, own = "Zq8rT2mN5xW9kL3vB7", "Hc4yP6sD1fG0jK8aE2"
    rows = [(i, f"token={wide}", f"r{i}", "o") for i in range(secrets.MAX_REPOSITORIES + 1)]
    rows += [(10 + i, f"token={own}", f"r{i}", "o") for i in range(secrets.MAX_REPOSITORIES)] + [(10, f"token={own}", "r0", "o")]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA), repository="repository").collect()
    assert {(r.doc_id < 10, x.verdict, x.n_owners) for r in got for x in r.found} == {(True, "example", 1), (False, "live", 1)}
    rows = [(i, f"token={wide}", "r", f"o{i}") for i in range(secrets.MAX_OWNERS + 1)] + [(9, f"token={own}", None, None)]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA), repository="repository").collect()
    assert {(r.doc_id == 9, x.verdict, x.n_owners) for r in got for x in r.found} == {(False, "example", secrets.MAX_OWNERS + 1), (True, "live", 1)}
