"""Best-fit packing of token sequences by length patterns fitted with non-negative least squares.

1. Each task tokenizes its rows and cuts what is longer than a sequence into pieces (a map, no shuffle). A piece
   carries its length and its number among the task's pieces of that length, and the thin table is written.
2. The histogram of lengths (at most `size` numbers, whatever the corpus) goes to the driver. Patterns of up to
   `parts` lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative
   least squares and rounded, as far as pieces last; best fit, longest first, packs the residual histogram, with equal
   sequences as one step.
3. A piece's rank among all of its length is its number plus the count of that length in earlier tasks; the rank says
   which repeat of which pattern holds it. No window or group holds the pieces of a length.

A lost executor's tasks run again on the written table. The driver's work depends on `size`, not on the rows.

Defined results: null text is empty and gives one piece, the end id alone; repeated rows, rows without an id and equal ids
are pieces of their own; ties of equal length keep the order of rows in the table; a very long text gives all of its
pieces; an empty table gives none; further columns play no part, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietcount.llm.bpe import byte_letters, vocabulary_path
from quietcount.llm.common import documents, in_arrow, written

SIZE, PARTS, ROUNDS = 2048, 3, 200
END_ID = 0
CACHE = 500_000
#: Printable ASCII, Latin-1 letters, common punctuation and white space: composed forms whose lower case is one character.
PLAIN = r"\x21-\x7EÀ-ÖØ-öø-ÿ–—‘’“”„•…\x20\x09-\x0D"
ODD = re.compile(rf"[^{PLAIN}]|<\|")
ODD_WORDS = re.compile(rf"([^\x20\x09-\x0D]*(?:[^{PLAIN}]|<\|)[^\x20\x09-\x0D]*)")
#: The vocabulary file's pattern for pieces of a word, as it reads on lower-case PLAIN characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\x20\x09-\x0D]+")


class Pieces(dict):
    """Ids of pieces of words by the tokenizers library's model, as little-endian bytes; those met are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a text. Words with other characters than PLAIN, or that may hold a special token, go through the whole library."""
        if not ODD.search(text):
            return b"".join(map(self.__getitem__, PIECES.findall(text.lower())))
        out = []
        for k, part in enumerate(ODD_WORDS.split(text)):
            if k % 2:
                out.append(array("I", self.library.encode(part, add_special_tokens=False).ids).tobytes())
            else:
                out += map(self.__getitem__, PIECES.findall(part.lower()))
        return b"".join(out)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[bytes, np.ndarray]:
        """The ids of all texts, each followed by end_id, and where each text's ids begin (and the last ends)."""
        end = array("I", [end_id]).tobytes()
        coded = []
        for t in texts:
            coded.append(self.text(t or "") + end)
            if len(self) > CACHE:
                self.clear()
        return b"".join(coded), np.cumsum([0, *map(len, coded)]) // 4


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def pieces(
    docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pieces of at most size tokens of every row's whole text: doc_id, piece, start, length, ids_crc32, task (number of the
    task that made it), nth (its number among the task's pieces of this length); on demand ids."""
    path = path or vocabulary_path()
    fields = [T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    fields += [T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, seen = loaded(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ids, bounds = known.encode(batch.column(1).to_pylist(), end_id)
            tokens = np.diff(bounds)
            cuts = -(-tokens // size)
            row = np.repeat(np.arange(len(tokens)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * size
            length = np.minimum(tokens[row] - start, size)
            at = bounds[row] + start
            held = memoryview(ids)
            crc, nth = [], []
            for a, n in zip(at.tolist(), length.tolist(), strict=True):
                crc.append(zlib.crc32(held[4 * a : 4 * (a + n)]))
                nth.append(seen[n])
                seen[n] += 1
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length)]
            columns += [pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]), pa.int32()), pa.array(np.frombuffer(ids, "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(docs.select(id_column, text_column), run, schema)


def patterns(lengths: np.ndarray, size: int, parts: int = PARTS) -> np.ndarray:
    """All ways to fill a sequence with one to parts (two or three) of the given lengths, longest first; 0 stands for none."""
    here = np.zeros(size + 1, bool)
    here[lengths] = here[0] = True
    first, second = np.nonzero(lengths[:, None] >= lengths[None, :])
    a, b = lengths[first], lengths[second]
    rest = size - a - b
    fits = (rest >= 0) & (rest <= b) & here[np.maximum(rest, 0)] & ((rest == 0) | (parts > 2))
    alone = [[size, 0, 0]] if here[size] else np.empty((0, 3), np.int64)
    return np.concatenate([alone, np.stack([a, b, rest], 1)[fits]]).astype(np.int64)


def fitted(found: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, by least squares of (pieces used - histogram) / sqrt(patterns of that length).

    Projected gradient with momentum; the products with the pattern matrix are sums at its few non-zero places.
    """
    n, flat, held = len(histogram), found.ravel(), found.shape[1]
    weight = np.bincount(flat, minlength=n).astype(float)
    weight = np.divide(1, weight, out=np.zeros(n), where=weight > 0)
    weight[0] = 0
    step = 1 / np.maximum((found > 0).sum(1), 1)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds if len(found) else 0):
        missing = (histogram - np.bincount(flat, np.repeat(y, held), n)) * weight
        new = np.maximum(y + step * missing[found].sum(1), 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, np.maximum(new + (before - 1) / t * (new - x), 0)
    return x


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[int, tuple]]:
    """Longest pieces first, each into the fullest sequence that has room: (number of sequences, ((length, times), ...))."""
    rooms: list[int] = []  # ascending
    open_: dict[int, list] = {}
    full = []
    for length in map(int, np.flatnonzero(histogram)[::-1]):
        left = int(histogram[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else size
            alike, held = open_[room].pop() if at < len(rooms) else (left, ())
            times = min(room // length, left)
            took = min(alike, left // times)
            if at < len(rooms):
                if took < alike:
                    open_[room].append((alike - took, held))
                elif not open_[room]:
                    del open_[room], rooms[at]
            left -= took * times
            room -= times * length
            held = (*held, (length, times))
            if not room:
                full.append((took, held))
                continue
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((took, held))
    return full + [g for stack in open_.values() for g in stack]


def plan(histogram: np.ndarray, size: int = SIZE, parts: int = PARTS) -> list[tuple[int, tuple]]:
    """What sequences hold, equal ones together: (number of sequences, ((length, times), ...)). histogram: pieces by length."""
    left = np.asarray(histogram, np.int64).copy()
    found = patterns(np.flatnonzero(left), size, parts)
    counts = fitted(found, left.astype(float))
    out = []
    for k in np.argsort(-counts, kind="stable"):
        repeats = int(np.rint(counts[k]))
        if not repeats:
            break
        used, times = np.unique(found[k][found[k] > 0], return_counts=True)
        repeats = min(repeats, int((left[used] // times).min()))
        if repeats:
            left[used] -= repeats * times
            out.append((repeats, tuple(zip(used.tolist(), times.tolist(), strict=True))))
    return out + best_fit(left, size)


def places(groups: list[tuple[int, tuple]]) -> np.ndarray:
    """A row for each stretch of ranks of a length: length << 40 | first rank, first sequence, pieces a sequence, offset; sorted."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for alike, held in groups:
        offset = 0
        for length, times in held:
            rows.append((length << 40 | ranks[length], sequence, times, offset))
            ranks[length] += alike * times
            offset += length * times
        sequence += alike
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()


def packed(cut: DataFrame, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """The pieces (a written table of `pieces`) with sequence_id and offset, without task and nth."""
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("pieces"))
    counts = written(counts, "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect():  # size rows at most
        histogram[r.length] = r.pieces
    held = cut.sparkSession.sparkContext.broadcast(places(plan(histogram, size, parts)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    columns = [c for c in cut.columns if c not in ("task", "nth")]
    ranked = cut.join(before, ["task", "length"]).select(*columns, (F.col("nth") + F.col("before")).alias("rank"))
    schema = T.StructType([f for f in cut.schema.fields if f.name in columns] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequences, times, offsets = held.value
        for batch in batches:
            rank, length = (batch.column(c).to_numpy() for c in ("rank", "length"))
            key = length << 40 | rank
            at = np.searchsorted(first, key, "right") - 1
            nth = key - first[at]
            own = [pa.array(sequences[at] + nth // times[at]), pa.array(offsets[at] + nth % times[at] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + own, names=schema.names)

    return in_arrow(ranked, run, schema)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, parts: int = PARTS, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, on demand ids, and its place: sequence_id, offset."""
    return packed(written(pieces(docs, path, size, with_ids=with_ids), "pieces"), size, parts)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
