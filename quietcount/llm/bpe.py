"""BPE encoding and decoding with a public word-level BPE vocabulary, by prefix-sharing trie traversal.

Each task reads Arrow batches. The distinct words of a batch that the task has not met yet form a
trie; a depth-first walk gives every node the last token of its prefix's encoding, found from the
last tokens of the ancestors: token t ends a prefix when t's bytes end it (a suffix automaton of
the vocabulary lists these) and the pair (last token before t, t) is one that BPE leaves standing. A prefix that many words share is
thus encoded once, and a word's tokens are read back along the chain of last tokens.

The work is a map over rows: no shuffle, memory bounded by a batch and by `CACHE_WORDS` cached
words; a lost executor's tasks simply run again.

Defined results: null text is empty and gives no tokens and an empty decoded text; null ids decode to
an empty text; row order, repeats, ties and further columns play no part.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.common import documents, in_arrow

CACHE_WORDS, CACHE_PAIRS, BLOCK_ROWS = 150_000, 200_000, 512
VOCABULARY = "word_bpe_49k.json"
#: The vocabulary file's pattern for pieces of a word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


#: Letters, numbers and capitals that came with Unicode 16 (two ranges of capitals: 17), which the library
#: knows beside those of unicodedata's version 15.1. The regex module knows others, so its classes are cut to these.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: First and last capital, and the small letter of the first.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
SMALL = {c: small + c - first for first, last, small in LATER_CAPITALS for c in range(first, last + 1)}
CAPITALS = re.compile(f"[{''.join(map(chr, SMALL))}]")


def pieces_pattern() -> str:
    """PIECES with the letters and numbers that the library knows."""
    import regex

    def ranges(runs: Iterable) -> str:
        return "".join(f"\\U{r[0]:08X}-\\U{r[-1]:08X}" for r in runs)

    newer = regex.compile(r"[\p{L}\p{N}]")
    late = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and newer.match(chr(c))]
    late = ranges(list(g) for _, g in groupby(late, key=lambda c, n=count(): c - next(n)))
    letter = rf"[[\p{{L}}--[{late}]]||[{ranges(LATER_LETTERS)}]]"
    number = rf"[[\p{{N}}--[{late}]]||[{ranges(LATER_NUMBERS)}]]"
    return "(?V1)" + PIECES.replace(r"[^\s\p{L}\p{N}]+", rf"(?:(?!{letter}|{number})\S)+").replace(r"|\p{L}+", f"|{letter}+").replace(r"|\p{N}|", f"|{number}|")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordBpe:
    """A vocabulary with word ends; `encode_words` is the trie traversal.

    Tokens are numbered by rank: first the single bytes (inner, then word-ending), then the merges in
    order. A token is held as its bytes and whether it ends a word.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        back, end = {c: b for b, c in letters.items()}, model["end_of_word_suffix"]
        self.pieces = regex.compile(pieces_pattern())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.text = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        base = [letters[b] for b in range(256)]
        names = base + [c + end for c in base] + [a + b for a, b in model["merges"]]
        number = {s: n for n, s in enumerate(names)}
        self.ids = [model["vocab"][s] for s in names]
        self.split = [(n, n) for n in range(512)] + [(number[a], number[b]) for a, b in model["merges"]]
        self.merged = {pair: n for n, pair in enumerate(self.split) if n >= 512}
        self.edges()
        self.inner, self.ending = {}, {}
        for n, s in enumerate(names):
            into = self.ending if s.endswith(end) else self.inner
            into[bytes(back[c] for c in s.removesuffix(end))] = n
        self.sizes = [0] * len(names)
        for bag in (self.inner, self.ending):
            for t in [x for x in bag.items() if not self.whole(x[1])]:  # BPE never makes these
                del bag[t[0]]
            for token, n in bag.items():
                self.sizes[n] = len(token)
        self.match_suffixes()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.texts = pa.array([self.text.get(i, "") for i in range(max(self.text) + 1)], pa.string())

    def match_suffixes(self) -> None:
        """An automaton over bytes (256 + byte where it ends a word): after any prefix, `ends[state]` lists
        the tokens that end it, longest first, as (size, token)."""
        self.go: list[dict[int, int]] = [{}]
        own: list[tuple] = [()]
        for bag, final in ((self.inner, 0), (self.ending, 256)):
            for token, n in bag.items():
                state = 0
                for symbol in (*token[:-1], token[-1] + final):
                    after = self.go[state].get(symbol)
                    if after is None:
                        after = self.go[state][symbol] = len(self.go)
                        self.go.append({})
                        own.append(())
                    state = after
                own[state] = ((len(token), n),)
        self.back = [0] * len(self.go)
        self.ends = list(own)
        row = list(self.go[0].values())
        while row:
            row_after = []
            for state in row:
                self.ends[state] = own[state] + self.ends[self.back[state]]
                for symbol, after in self.go[state].items():
                    b = self.back[state]
                    while b and symbol not in self.go[b]:
                        b = self.back[b]
                    self.back[after] = self.go[b].get(symbol, 0)
                    row_after.append(after)
            row = row_after

    def edges(self) -> None:
        """What stands at a token's two edges while BPE makes it: (token, number of the merge that takes it away)."""
        never = len(self.split)
        self.at_end, self.at_start = [], []
        for n, (left, right) in enumerate(self.split):
            for edge, half in ((self.at_end, right), (self.at_start, left)):
                edge.append([(n, never)] + ([] if half == n else [(t, min(gone, n)) for t, gone in edge[half]]))

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side: merges come in the order of their numbers, so one across
        the seam happens if its parts are there, that is, if none of them was taken before (of equal merges the
        left one comes first)."""
        across = self.merged.get
        for x, x_gone in self.at_end[left]:
            for y, y_gone in self.at_start[right]:
                if (n := across((x, y))) is not None and n < x_gone and n <= y_gone:
                    return False
        return True

    def whole(self, t: int) -> bool:
        """Whether BPE makes the token t of its own bytes."""
        left, right = self.split[t]
        return left == t or (self.whole(left) and self.whole(right) and not self._earlier(left, right, t))

    def _earlier(self, left: int, right: int, t: int) -> bool:
        # With (left, right) -> t left out, the pair must be one that BPE leaves standing.
        held = self.merged.pop((left, right))
        try:
            return not self._fit(left, right)
        finally:
            self.merged[left, right] = held

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words by one depth-first walk over their trie.

        The trie is held as the sorted words: their order is its depth-first order, and the part that a
        word shares with the one before is the path that the walk stays on.
        """
        out: dict[bytes, tuple[int, ...]] = {}
        lasts, states, before = [-1], [0], b""  # of each prefix of the word before
        ids, sizes, go, back, ends, fits = self.ids, self.sizes, self.go, self.back, self.ends, self.fits
        for w in sorted(words):
            n = len(w)
            shared, most = 0, min(len(before), n) - 1
            while shared < most and before[shared] == w[shared]:
                shared += 1
            del lasts[shared + 1 :], states[shared + 1 :]
            for k in range(shared + 1, n + 1):
                symbol, state = w[k - 1] + (k == n and 256), states[-1]
                while symbol not in go[state]:
                    state = back[state]
                state = go[state][symbol]
                for size, t in ends[state]:
                    if size == k:
                        break
                    pair = lasts[k - size] << 20 | t
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self._fit(pair >> 20, t)
                    if fit:
                        break
                else:
                    raise ValueError(f"no token ends {w[:k]!r}")
                lasts.append(t)
                states.append(state)
            before, coded = w, []
            while n > 0:
                t = lasts[n]
                coded.append(ids[t])
                n -= sizes[t]
            out[w] = tuple(coded[::-1])
        if len(fits) > CACHE_PAIRS:
            fits.clear()
        return out

    def chunks(self, text: str) -> list[str | int]:
        """White-space separated, normalised words, and the ids of special tokens written in the text."""
        out: list[str | int] = []
        for part in self.special_split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if not part.isascii() and CAPITALS.search(part):
                part = part.translate(SMALL)
            # str.split also cuts at four control characters that are not white space
            out += re.split(r"[\x20\x09-\x0D\x85\xa0]+", part) if re.search("[\x1c-\x1f]", part) else part.split()
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Puts the encodings of new words into the cache."""
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        pieces = [[w.encode()] if w.isalpha() else [p.encode() for p in self.pieces.findall(w)] for w in new]
        coded = {p: array("i", ids).tobytes() for p, ids in self.encode_words(set(chain.from_iterable(pieces))).items()}
        for w, ps in zip(new, pieces, strict=True):
            known[w] = coded[ps[0]] if len(ps) == 1 else b"".join([coded[p] for p in ps])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.chunks(t or "") for t in texts]
        self.learn({w for w in set(chain.from_iterable(split)) if isinstance(w, str)})
        known, out = self.words, []
        for t, ws in zip(texts, split, strict=True):
            coded = [known[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in ws] if "<|" in (t or "") else map(known.__getitem__, ws)
            out.append(np.frombuffer(b"".join(coded), np.int32))
        return out

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of lists of ids: the tokens with a space between; null for null."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.texts.take(ids.values), mask=ids.is_null() if ids.null_count else None)
        return pc.binary_join(tokens, " ")


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(
    docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False
) -> DataFrame:
    """id_column and ids (array<int>) of every row's whole text; on demand also decoded, the ids' text."""
    path = path or vocabulary_path()
    fields = [T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                coded = bpe.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))
                columns = [part.column(0), ids] + ([bpe.decode(ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(docs.select(id_column, text_column), run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """id_column, ids and decoded (string) of every row."""
    path = path or vocabulary_path()
    schema = T.StructType([encoded.schema[id_column], encoded.schema["ids"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, BLOCK_ROWS).columns], names=[id_column, "ids"])
                texts = pc.fill_null(bpe.decode(part.column(1)), "")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=[id_column, "ids", "decoded"])

    return in_arrow(encoded.select(id_column, "ids"), run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
