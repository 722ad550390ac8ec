"""More entities of a form than the first space of surrogates holds."""

from __future__ import annotations

import itertools

import regex
from pyspark.sql import functions as F

from quietcount.llm import pii


def test_crowded_spaces_grow(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    surnames = [f"n{''.join(x)}" for x in itertools.product(letters[:22], repeat=3)]
    given = [f"g{''.join(x)}" for x in itertools.product(letters[:10], repeat=2)]
    addresses = [f"{a}.{b}.{c}.{d}" for a, b, c, d in itertools.product(range(1, 9), repeat=4)]
    mails = [f"{a}@{b}.de" for a in letters for b in letters]
    assert len(surnames) > 10_000 and len(addresses) > 3300 and len(mails) == 26 * 26
    rows = [("surname", v) for v in surnames] + [("given_f", v) for v in given] + [("ip", v) for v in addresses] + [("email", v) for v in mails]
    got = pii.distinct_surrogates(spark.createDataFrame(rows, "kind string, canonical string"), "key").collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    forms = {k: regex.compile(pii.PATTERNS[k]) for k in ("ip", "email")} | {k: regex.compile(r"\p{Ll}+") for k in ("surname", "given_f")}
    assert all(forms[r.kind].fullmatch(r.surrogate) for r in got)


def test_longer_numbers_follow_the_mention(spark):
    entities = spark.createDataFrame([("phone", "+1223344", 9), ("phone", "+12025550123", 9)], "kind string, canonical string, salt int")
    short, long = (r.surrogate for r in pii.surrogates(entities, "key").orderBy(F.length("canonical")).collect())
    assert len(short) == 14 and len(long) == 12 and short[:2] == long[:2] == "+1"
    mention = spark.createDataFrame([("phone", "+1 22 33 44", short, "")], "kind string, mention string, surrogate string, lead string")
    new = mention.select(pii.rendered().alias("new")).first().new
    assert regex.sub(r"\D", "", new) == short[1:] and regex.fullmatch(pii.PATTERNS["phone"], new)
