"""Periodic runs of words, found on a Re-Pair grammar.

Each task reads Arrow batches. The words of a batch's texts become numbers; texts in which no stretch of half the least
length comes twice have no run (a run's stretch comes again one period later) and are done. The others, each ended by a
number of its own, are compressed together:

1. Re-Pair in rounds: pairs of neighbours are counted, and wherever a repeated pair is more frequent than the pairs that
   overlap it, it becomes one new symbol. What is left of each text is split in halves down to single symbols.
2. Every nonterminal, and every half split, is a stretch with one seam. The runs that cross the seam are found once, from
   how far the words on both sides of it agree with those a period away (hashes and halving steps, then every run is compared
   word by word). What a nonterminal derives is thus worked out once, however often and in however many texts it stands.
3. Runs of a nonterminal are moved to all places that derive it. A run lies whole in the least stretch that contains it, so
   those that still go on beside their stretch are parts of others and go; of equal stretches the least period stays.

Nothing is shuffled; memory is bounded by a batch (4 MB, or one text) and by BLOCK seams at a time; a lost executor's tasks
run again.

Defined results: null and blank texts have no words and no runs, their collapsed text is empty; repeated rows, equal ids and rows
without an id are texts of their own; of runs of equal length the one that starts first, then the one of the smaller period, is
the longest; an empty table gives no rows; further columns play no part, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.common import documents, in_arrow

LEAST = 12
#: Pairs of a seam and a period that are looked at together.
BLOCK = 1 << 21
FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("start", np.int64), ("end", np.int64), ("period", np.int64)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers for small ones."""
    x = (x.astype(np.uint64) + np.uint64(1)) * FACTOR
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 3]: which [0, 0, 2, 2, 2] and nth [0, 1, 0, 1, 2]."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def may_repeat(ids: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the texts in which some stretch of size words may come twice (equal hashes): no other has a run."""
    n = len(ids) - size + 1
    if n <= 1:
        return np.empty(0, np.int64)
    key, own = mixed(text[:n]), mixed(ids)
    for k in range(size):
        key = (key ^ own[k : k + n]) * FACTOR
        key ^= key >> np.uint64(32)
    whole = text[:n] == text[size - 1 :]
    key, owner = key[whole], text[:n][whole]
    order = np.argsort(key)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(owner[order[again]])


class Grammar:
    """Re-Pair of a sequence in which the symbols from `fence` on stand once and are never paired.

    Symbol first + k derives left[k] right[k]; at[k] is one place of it. top and top_at: what is left, and where it stands.
    """

    def __init__(self, text: np.ndarray, fence: int):
        self.first = first = int(text.max(initial=-1)) + 1
        top, at = text.astype(np.int64), np.arange(len(text))
        ends = text >= fence
        left, right, place, self.rounds = [], [], [], [first]
        sizes = [np.ones(first, np.int64)]
        while len(top) > 1:
            free = ~(ends[:-1] | ends[1:])
            key = np.where(free, top[:-1] * self.rounds[-1] + top[1:], -1)
            kinds, which, count = np.unique(key, return_inverse=True, return_counts=True)
            count[kinds < 0] = 0
            if count.max() < 2:
                break
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((mixed(kinds), count))] = np.arange(1, len(kinds) + 1)
            rank[count < 2] = 0
            rank = rank[which]
            # stretches of one rank are overlapping equal pairs (x x x): every other one is taken
            fresh = np.concatenate([[True], rank[1:] != rank[:-1]])
            start = np.flatnonzero(fresh)
            stretch = np.cumsum(fresh) - 1
            nth = np.arange(len(rank)) - start[stretch]
            before = np.concatenate([[0], rank[:-1]])
            after = np.concatenate([rank[1:], [0]])
            take = np.flatnonzero((rank > 0) & (before <= rank) & (after <= rank) & (nth % 2 == 0))
            made, names = np.unique(which[take], return_inverse=True)
            a, b = kinds[made] // self.rounds[-1], kinds[made] % self.rounds[-1]
            known = np.concatenate(sizes)
            left.append(a)
            right.append(b)
            where = np.empty(len(made), np.int64)
            where[names] = at[take]
            place.append(where)
            sizes.append(known[a] + known[b])
            keep = np.ones(len(top), bool)
            keep[take + 1] = False
            top[take] = self.rounds[-1] + names
            top, at, ends = top[keep], at[keep], ends[keep]
            self.rounds.append(self.rounds[-1] + len(made))
        self.top, self.top_at = top, at
        self.left, self.right, self.at = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right, place))
        self.sizes = np.concatenate(sizes)

    def occurrences(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """All places of the nonterminals of at least so many words: (symbol - first, place)."""
        pool: list[list[tuple]] = [[] for _ in self.rounds]

        def put(symbols: np.ndarray, places: np.ndarray) -> None:
            long = (symbols >= self.first) & (self.sizes[symbols] >= least)
            symbols, places = symbols[long], places[long]
            made_in = np.searchsorted(self.rounds, symbols, "right")
            for k in np.unique(made_in):
                pool[k].append((symbols[made_in == k], places[made_in == k]))

        put(self.top, self.top_at)
        found = []
        for k in range(len(self.rounds) - 1, 0, -1):
            if pool[k]:
                symbols, places = (np.concatenate(x) for x in zip(*pool[k], strict=True))
                own = symbols - self.first
                found.append((own, places))
                put(self.left[own], places)
                put(self.right[own], places + self.sizes[self.left[own]])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own, places = (np.concatenate(x) for x in zip(*found, strict=True))
        return own, places


class Agreement:
    """How far two places of a text agree, by prefix sums of hashes modulo 2^64."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, FACTOR), out=self.power[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(mixed(text) * self.power[:-1], out=self.sums[1:])
        pad = np.concatenate([np.full(3, -1), text, np.full(3, -2)])
        three = (mixed(pad[:-2]) * FACTOR ^ mixed(pad[1:-1])) * FACTOR ^ mixed(pad[2:])
        self.three = three  # three[i + 3] is text[i : i + 3]

    def equal(self, a: np.ndarray, size: np.ndarray, far: np.ndarray) -> np.ndarray:
        b = a + far
        return (self.sums[a + size] - self.sums[a]) * self.power[far] == self.sums[b + size] - self.sums[b]

    def forward(self, a: np.ndarray, far: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words from a on that equal those far later, most at most."""
        done = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.where(done + (1 << k) <= most, 1 << k, 0)
            done += np.where(self.equal(a + done, step, far), step, 0)
        return done

    def backward(self, a: np.ndarray, far: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words just before a that equal those far later, most at most."""
        done = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = np.where(done + (1 << k) <= most, 1 << k, 0)
            done += np.where(self.equal(a - done - step, step, far), step, 0)
        return done

    def true(self, runs: np.ndarray) -> np.ndarray:
        """runs, each compared word by word; one that two unequal stretches of equal hash made too long is cut at its first mismatch."""
        which, nth = spread(runs["end"] - runs["start"] - runs["period"])
        at = runs["start"][which] + nth
        bad = self.text[at] != self.text[at + runs["period"][which]]
        if not bad.any():
            return runs
        cut = {}
        for k, place in zip(which[bad][::-1].tolist(), at[bad][::-1].tolist(), strict=True):
            cut[k] = place
        out = runs.copy()
        for k, place in cut.items():
            out["end"][k] = place + out["period"][k]
        return out


def crossing(agree: Agreement, low: np.ndarray, seam: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs inside low..high that cross seam: (number of the stretch, runs), each stretch's as it has them by itself.

    Pairs of words a period apart agree all along a run: looked for from the pair that starts at the seam and the one that ends there.
    """
    owners, runs = [np.empty(0, np.int64)], [np.empty(0, RUN)]
    periods = (high - low) // 2
    total = np.cumsum(periods)
    cuts = np.unique(np.searchsorted(total, np.arange(0, int(periods.sum()), BLOCK), "right"))
    for i, j in pairwise([*cuts, len(low)]):
        which, nth = spread(periods[i:j])
        which += i
        p = nth + 1
        for pair in (seam[which], seam[which] - p):
            inside = (pair >= low[which]) & (pair + p <= high[which])
            w, a, far = which[inside], pair[inside], p[inside]
            three = agree.three
            near = (three[a + 3] == three[a + far + 3]) | (three[a] == three[a + far])
            w, a, far = w[near], a[near], far[near]
            ahead = agree.forward(a, far, high[w] - a - far)
            back = agree.backward(a, far, a - low[w])
            enough = (ahead + back >= np.maximum(far, least - far)) & (ahead + back > 0)
            w, found = w[enough], np.empty(int(enough.sum()), RUN)
            found["start"], found["end"], found["period"] = (a - back)[enough], (a + far + ahead)[enough], far[enough]
            owners.append(w)
            runs.append(found)
    owner, found = np.concatenate(owners), np.concatenate(runs)
    order = np.lexsort((found["period"], found["end"], found["start"], owner))
    owner, found = owner[order], found[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (found["start"][1:] != found["start"][:-1]) | (found["end"][1:] != found["end"][:-1])
    found = agree.true(found[fresh])
    size = found["end"] - found["start"]
    good = size >= np.maximum(least, 2 * found["period"])
    return owner[fresh][good], found[good]


def halves(grammar: Grammar, fence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the grammar leaves of each text, split in halves: low, seam and high of every split."""
    top, at = grammar.top, grammar.top_at
    end = np.flatnonzero((top >= fence) & (top < grammar.first))  # where each text ends
    begin = np.concatenate([[0], end[:-1] + 1])
    text = np.repeat(np.arange(len(end)), end - begin + 1)
    nth = np.arange(len(top)) - begin[text]
    rows = []
    step = 1
    while len(end) and step < (end - begin).max():
        mid = np.flatnonzero((nth % (2 * step) == step) & (np.arange(len(top)) < end[text]))
        rows.append((at[mid - step], at[mid], at[np.minimum(mid + step, end[text[mid]])]))
        step *= 2
    if not rows:
        return (np.empty(0, np.int64),) * 3
    low, seam, high = (np.concatenate(x) for x in zip(*rows, strict=True))
    return low, seam, high


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Maximal runs (RUN rows by start, then period) of each of some texts of word numbers."""
    if least < 9:
        raise ValueError("runs of fewer than 9 words aren't looked for")  # crossing() takes three equal words for granted
    none = np.empty(0, RUN)
    if not texts:
        return []
    fence = max(int(t.max(initial=-1)) for t in texts) + 1
    text = np.concatenate([x for k, t in enumerate(texts) for x in (t, [fence + k])]).astype(np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    grammar, agree = Grammar(text, fence), Agreement(text)
    size = grammar.sizes[grammar.first :]
    long = np.flatnonzero(size >= least)
    seam = grammar.at[long] + grammar.sizes[grammar.left[long]]
    owner, inner = crossing(agree, grammar.at[long], seam, grammar.at[long] + size[long], least)
    # to all places that derive the nonterminal
    count = np.bincount(long[owner], minlength=len(size))
    first = np.cumsum(count) - count
    symbol, place = grammar.occurrences(least)
    which, nth = spread(count[symbol]) if len(symbol) else (np.empty(0, np.int64),) * 2
    moved = inner[first[symbol[which]] + nth]
    shift = place[which] - grammar.at[symbol[which]]
    moved["start"] += shift
    moved["end"] += shift
    found = np.concatenate([moved, crossing(agree, *halves(grammar, fence), least)[1]])
    # those that go on to either side are parts of longer ones
    s, e, p = found["start"], found["end"], found["period"]
    goes_on = ((s > 0) & (text[s - 1] == text[s - 1 + p])) | (text[e] == text[e - p])
    found = np.sort(found[~goes_on], order=("start", "end", "period"))
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found["start"][1:] != found["start"][:-1]) | (found["end"][1:] != found["end"][:-1])
    found = found[fresh]
    of = np.searchsorted(begins, found["start"], "right") - 1
    found["start"] -= begins[of]
    found["end"] -= begins[of]
    order = np.lexsort((found["period"], found["start"], of))
    found, of = found[order], of[order]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [found[i:j] if i < j else none for i, j in zip(cut[:-1], cut[1:], strict=True)]


def runs_of_words(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Maximal runs of each of some texts of words."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    some = may_repeat(np.concatenate(ids) if ids else np.empty(0, np.int64), owner, -(-least // 2))
    out = [np.empty(0, RUN)] * len(texts)
    for k, found in zip(some.tolist(), runs_of([ids[k] for k in some], least), strict=True):
        out[k] = found
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words joined by one space, without those that some run holds after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs["start"] + runs["period"], 1)
        np.add.at(change, runs["end"], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
    return b" ".join(words).decode()


def periodic_runs(
    docs: DataFrame, least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period by start, then period; word numbers) and collapsed, the text
    without what runs repeat. A run has its smallest period q, at least max(least, 2 q) words and can't be extended.
    prepare, if given, gets a row's id and words and returns the words to use."""
    kind = docs.schema[id_column].dataType
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if prepare:
                texts = [prepare(d, t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = runs_of_words(texts, least)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate([*found, np.empty(0, RUN)])
            fields = [pa.array(x) for x in (flat["start"], flat["end"] - flat["start"], flat["period"])]
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            short = pa.array([collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, short], names=schema.names)

    return in_arrow(docs.select(id_column, text_column), run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of a tenth of the documents: from word a on, a stretch of p words is repeated to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the longest run and digests of every document."""
    found = periodic_runs(documents(spark, sf_dir), prepare=planted)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("longest"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("longest.length"), -F.col("longest.less")
    return rows.select(
        "doc_id", "n_runs", (-F.col("longest.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.length div -longest.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op12_periodic": op12_periodic}
ORACLES: dict[str, str] = {}
