"""State by buckets of keys: one value of the state store holds the entries of all keys of a bucket.

Each call of the store is a round trip from Python, and so is each group. With state by key both grow with the keys; by bucket a batch
makes one group and two calls a bucket. A batch writes its buckets whole, so a store of N keys rewrites N / BUCKETS entries for a key."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

BUCKETS = 1024
DAY_MILLIS = 86_400_000


def bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).alias("bucket")


def key_text(*columns: str) -> Column:
    """One text for the values of a key; a null differs from every text."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))


class Entries:
    """Entries of a bucket: tuples of key, the fields, and the time at which the key was last written. One that was idle for `days`,
    by the clock, is gone; so is the whole value when its bucket was."""

    def __init__(self, handle: StatefulProcessorHandle, fields: list[tuple[str, pa.DataType]], days: int | None = None) -> None:
        self.schema = pa.schema([("key", pa.string()), *fields, ("touched", pa.int64())])
        self.days = days
        self.value = handle.getValueState("entries", "rows binary", days and days * DAY_MILLIS)

    def now(self, timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs() if self.days else 0

    def take(self, keys: Iterable[str], now: int) -> dict[str, list[tuple]]:
        """The live entries of these keys. The bucket's others stay in their table for `put`."""
        held = self.value.get()
        table = self.schema.empty_table() if held is None else pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_all()
        if self.days:
            table = table.filter(pc.greater(table["touched"], now - self.days * DAY_MILLIS))
        asked = pc.is_in(table["key"], value_set=pa.array(list(keys), pa.string()))
        self.others = table.filter(pc.invert(asked))
        out = defaultdict(list)
        for row in zip(*[c.to_pylist() for c in table.filter(asked).columns], strict=True):
            out[row[0]].append(row)
        return out

    def put(self, rows: Iterable[tuple]) -> None:
        """Writes the bucket: what was not taken, and rows."""
        columns = list(zip(*rows, strict=True)) or [()] * len(self.schema)
        fresh = pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(pa.concat_tables([self.others, fresh]).combine_chunks())
        self.value.update((sink.getvalue().to_pybytes(),))
