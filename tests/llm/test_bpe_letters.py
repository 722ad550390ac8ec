"""Every code point alone, doubled, between letters and before a digit, as the library takes it."""

from __future__ import annotations

import sys

import pytest

from quietcount.llm import bpe


def test_all_code_points():
    tokenizers = pytest.importorskip("tokenizers")
    lib, own = tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), bpe.WordBpe(bpe.vocabulary_path())
    # unassigned planes and private use behave alike: each 64th code point there
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or 0xE0000 <= c < 0xE1000 or c % 64 == 0)]
    wrong = []
    for at in range(0, len(points), 16_384):
        part = [chr(c) for c in points[at : at + 16_384]]
        texts = [f"{c} {c}{c} a{c}b {c}1" for c in part]
        want = lib.encode_batch(texts, add_special_tokens=False)
        wrong += [hex(ord(c)) for c, got, w in zip(part, own.encode(texts), want, strict=True) if list(got) != w.ids]
    assert not wrong, (len(wrong), wrong[:20])
