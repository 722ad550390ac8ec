"""Streaming forms of ingest, sessions, rollups, metering and revenue movements.

Every job takes a streaming frame and returns a started query (or a frame to be written). State lives
in the state store or in tables beside the checkpoint; a restarted query replays its last batch, and
writes that may be repeated replace what they wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quietcount.operators import ingest, metering, revenue
from quietcount.sources import tables
from quietcount.streaming.buckets import Entries, bucket, key_text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMEOUT_SECONDS = 1_800
#: A key's session state leaves the store when it was idle for so long; by then its visitor hash has rotated, so numbers may start anew.
STATE_DAYS = 2
COUNTER_DAYS = 45


def beacons(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of beacon requests from JSON-lines files (body, query string and request columns), parsed; the query counts where the body is of no use."""
    schema = "event_id long, body string, query string, ip string, user_agent string, origin string, sec_gpc string, dnt string, sec_purpose string, received_at timestamp"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return ingest.parsed(raw, query="query")


class Sessions(StatefulProcessor):
    """Numbers the sessions of a bucket's keys; a gap of TIMEOUT_SECONDS or more starts one. The state is each key's
    last time and number. With `days` it expires so long after the key's last batch, and the store holds the keys of that time only."""

    def __init__(self, days: int | None = None) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = Entries(handle, [("last", pa.int64()), ("number", pa.int64())], self.days)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # the rows of a bucket in one batch
        frame = pd.concat(list(rows)).sort_values(["key", "micros", "event_id"], ignore_index=True)
        now = self.entries.now(timer_values)
        micros, names = frame["micros"].to_numpy(), frame["key"].to_numpy()
        gap = TIMEOUT_SECONDS * 1_000_000
        first = np.concatenate([[True], names[1:] != names[:-1]])
        starts = np.flatnonzero(first)
        own = np.cumsum(first) - 1  # the place of an event's key among the keys
        held = self.entries.take(names[starts], now)
        last, number = np.array([held[k][0][1:3] if k in held else (micros[i] - gap, 0) for k, i in zip(names[starts], starts, strict=True)], dtype="int64").T
        # the latest time before an event, which may be older than one of an earlier batch
        latest = np.where(first, last[own], np.maximum(last[own], np.roll(micros, 1)))
        entries = micros - latest >= gap
        counted = np.cumsum(entries)
        numbers = number[own] + counted - (counted - entries)[starts][own]
        ends = np.append(starts[1:], len(frame)) - 1
        self.entries.put((k, int(t), int(n), now) for k, t, n in zip(names[starts], np.maximum(last, micros[ends]), numbers[ends], strict=True))
        yield pd.DataFrame({"event_id": frame["event_id"], "is_entry": entries, "session_number": numbers})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, keys: list[str], days: int | None = STATE_DAYS) -> DataFrame:
    """event_id, is_entry, session_number of a stream; needs the RocksDB state store (see `with_state_store`).

    State expires after `days`, by the clock. None keeps it. With expiry, a query that drains what is available and ends needs `drains`."""
    rows = events.select(bucket(*keys), key_text(*keys).alias("key"), "event_id", F.unix_micros("occurred_at").alias("micros"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Sessions(days), outputStructType="event_id long, is_entry boolean, session_number long",
        outputMode="Append", timeMode="ProcessingTime" if days else "None",
    )


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def drains(spark: SparkSession) -> None:
    """Lets queries with expiring state end when they have taken what is available; otherwise Spark plans empty batches for them without end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def incremental_rollup(events: DataFrame, table: str, out: str, checkpoint: str, aggregate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Appends each batch to the event table and makes the rollup days that it touches anew.

    Distinct counts are exact: a touched day is recomputed from the table's partitions of that day, however late
    its rows are.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("event_date", F.to_date("occurred_at")).withColumn("batch_id", F.lit(batch_id))
        tables.replace_days(rows, table, ["batch_id", "event_date"])  # a replayed batch replaces itself
        days = [r[0] for r in rows.select("event_date").distinct().collect()]  # at most the days of one batch
        if not days:
            return
        stored = spark.read.parquet(table).where(F.col("event_date").isin(days)).drop("batch_id", "event_date")
        tables.replace_days(aggregate(stored).withColumn("day", F.to_date("bucket")), out, ["day"])

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, keys: list[str], watermark: str = "3 days") -> DataFrame:
    """Events per hour and keys, for opt-out and rejection counters and the countable part of the hourly rollup."""
    windows = events.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "1 hour"), *keys)
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), *keys, "n")


def active_visitors(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Visitors of the last five minutes, every minute; approximate, since a stream's exact distinct has no bound."""
    windows = events.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "5 minutes", "1 minute"), "site_id")
    return windows.agg(F.approx_count_distinct("visitor_hash").alias("visitors")).select(F.col("window.end").alias("at"), "site_id", "visitors")


def _slot(path: str, batch_id: int) -> str:
    """The folder of a batch's running totals. Two take turns: a batch reads its predecessor's and writes the other one, so
    a replayed batch finds what it found before, and nothing grows with the number of batches."""
    return f"{path}/slot={batch_id % 2}"


def quota(events: DataFrame, limits: DataFrame, counters: str, out: str, checkpoint: str) -> StreamingQuery:
    """Numbers each account's events of a UTC month across batches and flags those over the limit.

    events carry account_id; limits has account_id and monthly_event_limit. Counters are one small row per account and
    month, carried from batch to batch until they were idle for COUNTER_DAYS.
    """
    schema = "account_id long, month string, base long, touched timestamp"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("month", F.date_format("occurred_at", "yyyy-MM"))
        earlier = spark.read.schema(schema).parquet(_slot(counters, batch_id - 1)) if batch_id else spark.createDataFrame([], schema)
        numbered = metering.numbered(rows).join(earlier.drop("touched"), ["account_id", "month"], "left")
        numbered = numbered.join(limits.select("account_id", "monthly_event_limit"), "account_id")
        seq = F.coalesce("base", F.lit(0)) + F.col("seq")
        judged = numbered.select("event_id", "account_id", seq.alias("seq"), F.coalesce(seq > F.col("monthly_event_limit"), F.lit(False)).alias("refused"), F.lit(batch_id).alias("batch_id"))
        tables.replace_days(judged, out, ["batch_id"])
        counted = rows.groupBy("account_id", "month").agg(F.count(F.lit(1)).alias("base"), F.max("occurred_at").alias("touched"))
        newest = rows.agg(F.max("occurred_at")).first()[0]
        carried = earlier.unionByName(counted).groupBy("account_id", "month").agg(F.sum("base").alias("base"), F.max("touched").alias("touched"))
        live = carried.where(F.col("touched") >= F.lit(newest) - F.expr(f"INTERVAL {COUNTER_DAYS} DAYS")) if newest else carried
        live.write.mode("overwrite").parquet(_slot(counters, batch_id))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_events(events: DataFrame, known: str, out: str, checkpoint: str) -> StreamingQuery:
    """One notice per site, when its first event arrives: sites known from earlier batches are left out.

    known holds a number per site, carried from batch to batch; out the notices."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema("site_id long").parquet(_slot(known, batch_id - 1)) if batch_id else spark.createDataFrame([], "site_id long")
        found = batch.groupBy("site_id").agg(F.min("occurred_at").alias("first_event_at")).join(earlier, "site_id", "left_anti")
        tables.replace_days(found.withColumn("batch_id", F.lit(batch_id)), out, ["batch_id"])
        earlier.unionByName(batch.select("site_id")).distinct().write.mode("overwrite").parquet(_slot(known, batch_id))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Movements(StatefulProcessor):
    """The subscriptions of a bucket's customers: their last time, status and value, and whether their customer has converted.

    A change older than its subscription's last one is stale; one that was seen before is a repeat.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("subscription_id", pa.string()), ("last", pa.int64()), ("event_id", pa.int64()), ("mrr", pa.int64()), ("live", pa.bool_()), ("kinds", pa.string()), ("converted", pa.bool_())]
        self.entries = Entries(handle, fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        subscriptions, converted = {}, set()
        for customer, entries in self.entries.take(frame["key"].unique(), 0).items():
            subscriptions.update({(customer, e[1]): e[2:7] for e in entries})
            if entries[0][7]:
                converted.add(customer)
        out = []
        columns = ("key", "subscription_id", "event_id", "micros", "status", "mrr_cents", "currency")
        for customer, subscription, event_id, micros, status, mrr, currency in zip(*[frame[c] for c in columns], strict=True):
            last, event, before, was_live, kinds = subscriptions.get((customer, subscription), (None, None, 0, False, ""))
            if last is not None and (micros < last or event_id == event):
                continue
            live, now = status in revenue.LIVE, int(mrr) if status in revenue.PAYING else 0
            delta, kind = now - before, None
            if was_live and not live:
                kind, delta = revenue.CHURN, -abs(int(mrr))
            elif delta and not before:
                kind = revenue.REACTIVATION if customer in converted else revenue.NEW
                converted.add(customer)
            elif delta:
                kind = revenue.EXPANSION if delta > 0 else revenue.CONTRACTION
            if last is None or micros // 1_000_000 != last // 1_000_000:
                kinds = ""  # of one kind within a second, the first counts
            if kind and kind not in kinds.split():
                kinds += f" {kind}"
                out.append((customer, kind, delta, currency, f"{subscription}:{micros // 1_000_000}"))
            subscriptions[customer, subscription] = (int(micros), int(event_id), now, live, kinds)
        self.entries.put((customer, subscription, *state, customer in converted, 0) for (customer, subscription), state in subscriptions.items())
        yield pd.DataFrame(out, columns=["key", "kind", "amount_cents", "currency", "object_id"])

    def close(self) -> None:
        pass


def movements(changes: DataFrame) -> DataFrame:
    """Revenue movements of a stream of subscription changes."""
    keys = ["site_id", "customer_id"]
    rows = changes.select(
        bucket(*keys), key_text(*keys).alias("key"), "subscription_id", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("event_at").alias("micros"), "status", "mrr_cents", "currency"
    )
    made = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Movements(), outputMode="Append", timeMode="None",
        outputStructType="key string, kind string, amount_cents long, currency string, object_id string",
    )
    names = [F.get_json_object("key", f"$.k{i}").cast("long").alias(c) for i, c in enumerate(keys)]
    return made.select(*names, "kind", "amount_cents", "currency", "object_id")


def to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def storable(events: DataFrame, errors: Callable[[], Column], good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Each batch's storable rows to one table, the others with their errors to a dead-letter table."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ok, bad = tables.split_storable(batch.withColumn("batch_id", F.lit(batch_id)), errors())
        tables.replace_days(ok, good, ["batch_id"])
        tables.replace_days(bad, dead, ["batch_id"])

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
