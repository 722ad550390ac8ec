"""Persons and numbers as texts hold them; what ends a name; long words. Mentions are listed by hand, not by the operator's patterns."""

from __future__ import annotations

import re

import pytest

from quietcount.llm import pii

#: Text with {} for each mention, and the mentions.
CASES = [
    ("{} Monday came. Then {} left", ["Mr Smith", "Mr Smith"]),
    ("{} Der Hund bellt", ["Herr Müller"]),
    ("{} and {} met", ["Mr. John  Smith", "Mr\nSmith"]),
    ("{} IS HERE, {} too", ["MR SMITH", "FRAU ANNA SMITH"]),
    ("{}'s hat and {}", ["Prof. Smith", "Dr John O'Brien"]),
    ("call {} or {} or {} today", ["0049 30 123456", "030 1234567", "+49 30 1234567"]),
    ("from {} to {} at 12:30:45, a::b", ["2001:db8::8a2e:370:7334", "fe80:0:0:0:1:2:3:4"]),
    ("on {} Der, {}, at", ["Frau Smith", "x@y.com"]),
    ("Mrs. The end. Miss the bus. Dr. No 0123 or 00 11 and 1.5.2020", []),
]


def changed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymised(docs, "key").collect()}


def test_mentions_and_what_lies_between(spark):
    got = changed(spark, [t.format(*m) for t, m in CASES])
    names = {}
    for i, (text, mentions) in enumerate(CASES):
        held = re.fullmatch("(.+?)".join(map(re.escape, text.split("{}"))), got[i].text, re.S)
        assert held and got[i].n_entities == len(mentions), (text, got[i].text)
        for old, new in zip(mentions, held.groups(), strict=True):
            if old[0].isupper() and not old[0].isdigit() and "@" not in old:
                parts, fresh = re.findall(r"[^\s.]+|[\s.]+", old), re.findall(r"[^\s.]+|[\s.]+", new)
                assert parts[:2] == fresh[:2] and parts[1::2] == fresh[1::2]
                assert all(a != b and a.isupper() == b.isupper() for a, b in zip(parts[2::2], fresh[2::2], strict=True))
                assert names.setdefault(parts[-1].lower(), fresh[-1].lower()) == fresh[-1].lower()
            else:
                assert new != old and re.sub(r"[0-9a-f]", "0", new) == re.sub(r"[0-9a-f]", "0", old) or "@" in old
    assert got[5].text[5:7] == "00" and " or 0" in got[5].text
    assert got[len(CASES) - 1].text == CASES[-1][0]


@pytest.mark.parametrize("text", ["Mr A" + "a" * 1_000_000 + " x", "x a@b" + ".cd" * 100_000 + " x", "Mr A" + "-a" * 300_000, "mr " * 200_000, "0" * 500_000, "a:" * 300_000, "Mr" + " " * 500_000 + "X"])
def test_long_words_are_read_in_a_loop(spark, text):
    """A matcher that recursed would overflow the stack and end the executor."""
    row = changed(spark, [text])[0]
    assert row.n_entities == (1 if re.match(r"Mr A|x a@", text) else 0)
    assert (row.text != text) == bool(row.n_entities)
