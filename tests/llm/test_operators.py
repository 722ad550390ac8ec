"""Operators against brute force, on edge cases: nulls, empty and very long texts, ties, repeated rows, empty
tables, further columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quietcount.llm import bpe, exact_dedup, mixing, ngram_join, pii, quality_rules, secrets, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ["h", "norm", "keep_id", "copies", "score", "sha", "row", "id", "at", "bucket", "segs", "kept", "domain", "base", "found"]


def table(spark, texts, **more):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


LONG = " ".join(f"word{i % 977}" for i in range(40_000))
TEXTS = [None, "", "   \n", "a b c d", "a  b\tc d", "A b c d", "one", "one two", LONG, LONG + " end", "a b c d", "same same same same same", "line one\nline one\nline two"]


def test_exact_dedup_against_brute_force(spark):
    docs = clashing(table(spark, TEXTS))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, capacity=2).collect()}
    for i, n in enumerate(norm):
        group = [k for k, m in enumerate(norm) if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (group[0], len(group), group[0] == i)
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({norm.index(n) for n in norm})


def test_exact_dedup_chains_colliding_keys(spark):
    """With a key that sends all texts of a length to one chain, bytes still decide."""
    texts = ["ab", "cd", "ab", "ef", "xyz", None, "cd"]
    key = lambda c: F.length(c).cast("long")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(table(spark, texts), key=key).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (1, 2)}


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.deduplicate(docs).collect()) == [(-1, "c"), (1, "a"), (2, "b")]


def test_directory_splits_overfull_buckets_only():
    slots = exact_dedup.directory({0: 50, 1: 50, 1023: 1}, 60, 10)
    buckets = {b: d for _, b, d in slots}
    assert len(slots) == 1024 and max(buckets.values()) == 10 and len(buckets) == 11
    assert exact_dedup.directory({}, 5, 4) == [(0, 0, 0)]
    many = exact_dedup.directory({p: 3 for p in range(1 << 13)}, 5, 13)
    assert len(many) == 1 << 13 and len({b for _, b, _ in many}) == 1 << 13


def test_a_wrong_directory_finds_nothing(spark):
    docs = table(spark, [f"text {i % 40}" for i in range(60)])
    rows = exact_dedup.keyed(docs, F.xxhash64)
    right, wrong = (exact_dedup.Directory(rows, 4) for _ in range(2))
    assert right.depth >= 3 and len({b for _, b, _ in right.slots}) >= 10
    index = exact_dedup.build_index(docs, rows, right)
    assert exact_dedup.look_up(docs, rows, index, right).count() == 60
    turned = [(s, (b + 1) % len(wrong.slots)) for s, b, _ in wrong.slots]
    wrong.table = spark.createDataFrame(turned, "slot long, bucket int")
    assert exact_dedup.look_up(docs, rows, index, wrong).count() < 30
    strange = table(spark, ["a text that isn't in the index"])
    assert exact_dedup.look_up(strange, exact_dedup.keyed(strange, F.xxhash64), index, right).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:]))
    twice = {g for g in grams if grams.count(g) > 1} if len(words) < 3_000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark):
    random.seed(3)
    texts = TEXTS + [" ".join(random.choice("ab cd e# |x the of\n") for _ in range(n)) for n in (5, 60, 200)] + ["é 日本 😀 é 日本 😀 é"]
    got = {r.doc_id: r for r in quality_rules.apply_rules(clashing(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_secrets_against_brute_force(spark):
    key = "9f3aB7c2D1e8F6a5Kq7LmN"
    texts = [
        None, "", f'token = "{key}"', "API_KEY: short", "password=secret=abcdefghij token=token:abcdefghijk", "AKIA" + "A1" * 8 + " AKIA12 x" + "0a" * 20,
        f"é😀 {key} tail", *[f"secret: examplevalue{0}1" for _ in range(4)], "ab" * 40 + " tokeN='xx+/y12345'",
    ]
    got = {r.doc_id: r for r in secrets.scan(clashing(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = []
        for rank, k in enumerate(secrets.BASE):
            pattern = k.pattern if k.name != "hex" else "[0-9a-f]+"
            for m in re.finditer(pattern, t or ""):
                if len(m[k.group]) >= k.least:
                    spans.append((m.start(), rank, m.end(), k.name))
        assert [(x.s, x.rank, x.e, x.kind) for x in got[i].base] == sorted(spans), i
    verdicts = {i: [(x.kind, x.verdict) for x in got[i].found or []] for i in got}
    assert verdicts[2] == [("assign", "live")] and verdicts[6] == [("generic", "live")]
    assert {v for i in (7, 8, 9, 10) for _, v in verdicts[i]} == {"example"}


def components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def near_copies(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("words,edits,copies", [(12, 1, 12), (60, 3, 25), (150, 5, 25)])
def test_ngram_join_against_brute_force(spark, words, edits, copies):
    texts = TEXTS + near_copies(words, 3, copies, words, edits) + ["X Y", "x y", "z"]
    got = {r.doc_id: r for r in ngram_join.similar_sets(clashing(table(spark, texts))).collect()}
    sets = [shingle_set(t) for t in texts]
    want = components(sets)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_ngram_join_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None), (4, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.similar_sets(docs).collect()) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_bpe_matches_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    random.seed(5)
    alphabet = "etaoinshr abcdeTSΣσςİı²Ⅷ5́é  \x1c\x85日本😀ßÅ<|endoftext|>\n.,!'re"
    texts = TEXTS[:8] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(2_000)] + ["<|startoftext|>hi we'll", "ΣΑΣ ﬁ"]
    got = {r.doc_id: r for r in bpe.encode(clashing(table(spark, texts)), decoded=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == lib.decode(ids, skip_special_tokens=False), repr(t)
    again = bpe.decode(bpe.encode(table(spark, texts[:50]))).collect()
    assert all(r.decoded == got[r.doc_id].decoded for r in again)


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 70_000, "\r\n\r\nWARC/1.1\r\n" * 9, "y" * 16_384, "<p>é</p>", "x" * 70_000, ""]
    rows = [(i, None if i == 2 else f"http://a b/{i}", h) for i, h in enumerate(html)] + [(None, "u", "x" * 70_000), (None, "u", "alone"), (4, "u", "x" * 70_000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = warc.new_path(spark, "warc")
    warc.write_archive(pages, folder)
    got = warc.read_archive(spark, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    for page_id, _, h in rows:
        data = (h or "").encode()
        mine = [r for r in got if r.page_id == page_id and r.payload_digest == warc.base32(hashlib.sha1(data).digest())]
        first = min((p for p, _, x in rows if (x or "") == (h or "") and p is not None), default=None)
        assert mine and all(r.payload_bytes == len(data) for r in mine)
        assert all(r.record_type == ("response" if page_id == first else "revisit") for r in mine)
        assert all(r.refers_to == (None if page_id == first else first) for r in mine)
        assert all(bytes(r.payload) == data for r in mine if r.record_type == "response")


def test_warc_detects_missing_segments(spark):
    assert warc.unchunked(warc.chunked(b"abc" * 5_000, 7)) == b"abc" * 5_000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_url_rules_and_model(spark):
    rng = random.Random(2)
    rows = [(i, f"https://{'blog.' * (i % 2)}h{rng.randrange(50)}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es')[i // 3 % 3]}/{i}?a=1&b={i}#x") for i in range(300)]
    rows += [(900, None), (901, "no scheme"), (902, "HTTP://Sub.EXAMPLE.com/en/7?x"), (903, "http://com/en/"), (904, "http://a.com?/en/"), (905, "http://x.net\n/de/")]
    got = {r.page_id: r for r in url_filter.judged(clashing(spark.createDataFrame(rows, "page_id long, url string"))).collect()}
    rules = dict(url_filter.RULES)
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host, path = "".join(c.lower() if c.isascii() else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (rules[rule] if rule else "block" if got[i].score >= 0.5 else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_toxicity_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, " "), (10**6 + 2, "you idiot moron, worthless stupid clown"), (None, "x")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.classify(clashing(docs.select("doc_id", "text")).select("doc_id", "text").union(extra), marks).collect()}
    labelled = {r.doc_id: r.toxic for r in marks.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items() if i is not None)
    held = [(rows[i].predicted, t) for i, t in labelled.items() if i in rows and rows[i].held_out]
    caught = sum(p for p, t in held if t) / max(1, sum(t for _, t in held))
    wrong = sum(p for p, t in held if not t) / max(1, sum(1 - t for _, t in held))
    assert caught >= 0.5 and wrong <= 0.02, (caught, wrong)
    assert rows[10**6].score == rows[10**6 + 1].score < 0.7 and rows[10**6 + 2].predicted == 1
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_toxicity_without_labels(spark):
    docs = table(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}
    assert toxicity.drop_toxic(clashing(docs), none).count() == len(TEXTS)


def test_mixing_budgets_and_prefixes(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src11", None])) for i in range(400)] + [(None, None, None, None), (3, "", "en", "src1")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    taken = sum(r.n_tokens * r.copies for r in got)
    assert 0.55 * total <= taken <= 0.6 * total + 1
    plan = {(r.domain, r.lang, r.source): (r.tokens, r.allotted) for r in mixing.budgets(mixing.leaves(docs)).collect()}
    assert sum(a for _, a in plan.values()) <= total * 60 // 100 and all(a <= t * mixing.MAX_EPOCHS for t, a in plan.values())
    for key, (_, allotted) in plan.items():
        assert sum(r.n_tokens * r.copies for r in got if (r.domain, r.lang, r.source) == key) <= allotted
    out = mixing.take(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got if r.n_tokens) + sum(r.copies for r in got if not r.n_tokens)


def test_mixing_gives_shortage_to_siblings_first(spark):
    texts = [("w " * 10, "en", "src1")] + [("w " * 1000, "en", "src2")] * 5 + [("w " * 1000, "de", "src3")] * 5
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    plan = {r.source: r.allotted for r in mixing.budgets(mixing.leaves(docs), percent=50, epochs=1).collect()}
    english = 5_005 * 5 // 7  # weights 5 and 2
    assert plan["src1"] == 10 and plan["src2"] == english - 10 and plan["src3"] == 5_005 * 2 // 7


def test_pii_surrogates(spark):
    text = "call +1 (017) 555-7713 or +10175557713. A.B@X.COM, a.b@x.com; Mr. John Smith met Frau Anna Berg and Mr John Smith at 10.0.0.1, 4000 1234 1234 1234, 4000123412341234!"
    docs = clashing(table(spark, [None, "", text, text, "plain words", "иван@почта.рф 1.2.3 99"]))
    got = {r.doc_id: r for r in pii.pseudonymised(docs, "key").collect()}
    assert got[0].text is None and got[1].text == "" and got[4].text == "plain words" and got[4].n_entities == 0
    new = got[2].text
    assert new == got[3].text and got[2].n_entities == 10
    for private in ("555-7713", "0175557713", "A.B@X", "a.b@x", "Smith", "Anna Berg", "10.0.0.1", "4000 1234", "4000123412341234"):
        assert private not in new
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1\d{10}", new)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0].strip(",") == mails[0].upper().strip(",") and mails[0].lower().strip(",;") == mails[1].strip(",;")
    names = re.findall(r"Mr\.? (\w+) (\w+)", new)
    assert names[0] == names[1] and names[0][0] in pii.MALE_NAMES
    assert re.search(r"Frau (\w+)", new)[1] in pii.FEMALE_NAMES
    assert re.search(r"[а-я]+@[а-я]+\.рф", got[5].text)


def test_pii_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)], "kind string, canonical string")
    got = pii.distinct_surrogates(entities, "key").collect()
    assert len({r.surrogate for r in got}) == len(got) == 81
    assert not {r.surrogate for r in got} & {r.canonical for r in got}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        quality_rules.apply_rules(docs), secrets.scan(docs), ngram_join.similar_sets(docs), bpe.digests(docs), exact_dedup.exact_duplicates(docs),
        exact_dedup.deduplicate(docs), mixing.mixed(docs), mixing.take(docs), pii.pseudonymised(docs, "key"), toxicity.classify(docs, none),
        toxicity.drop_toxic(docs, none), url_filter.judged(pages),
    ):
        assert df.count() == 0
    folder = warc.new_path(spark, "warc")
    warc.write_archive(pages, folder)
    assert warc.read_archive(spark, folder).count() == 0
