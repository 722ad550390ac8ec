"""State by buckets of keys: calls of the store, runs over batches, expiry, odd keys."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from quietcount.streaming import jobs, state

DAY = 86_400_000
GAP = jobs.TIMEOUT_SECONDS * 1_000_000


class Store:
    """A state store in memory that counts its calls; the calls of a value and of a map are those that processors make."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, name, schema, ttl=None):
        return Cell(self, name)

    def getMapState(self, name, keys, schema, ttl=None):
        return Cell(self, name)


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self, key):
        self.store.calls += 1
        return (self.name, key)

    def exists(self):
        return self._call(None) in self.store.values

    def get(self):
        return self.store.values.get(self._call(None))

    def update(self, value):
        self.store.values[self._call(None)] = value

    def containsKey(self, key):
        return self._call(key) in self.store.values

    def getValue(self, key):
        return self.store.values.get(self._call(key))

    def updateValue(self, key, value):
        self.store.values[self._call(key)] = value


class Clock:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def run(processor, store, rows, columns, now=0):
    processor.init(store)
    frame = pd.DataFrame(rows, columns=columns)
    halves = iter([frame.iloc[: len(frame) // 2], frame.iloc[len(frame) // 2 :]])  # a busy bucket comes in parts
    return pd.concat(list(processor.handleInputRows((0, 0), halves, Clock(now))))


KEYED = ["key", "event_id", "micros"]
CHANGE = ["key", "subscription_id", "event_id", "micros", "status", "mrr_cents", "currency"]
HASHED = ["event_id", "micros", "visitor_hash", "earlier_hash"]


@pytest.mark.parametrize(
    "make, columns, row",
    [
        (lambda: jobs.Sessions(2), KEYED, lambda n: (f"k{n}", n, n)),
        (lambda: state.CarriedSessions(1800, 2), HASHED, lambda n: (n, n, f"h{n}", f"e{n}")),
        (lambda: jobs.Movements(), CHANGE, lambda n: (f"k{n}", f"s{n}", n, n, "active", 5, "USD")),
    ],
)
def test_calls_of_the_store_do_not_grow_with_the_keys(make, columns, row):
    calls = []
    for n in (10, 1_000):
        store = Store()
        for _ in range(2):
            run(make(), store, [row(i) for i in range(n)], columns)
        calls.append(store.calls)
    assert calls[0] == calls[1] <= 4


def test_sessions_of_many_keys_run_on_over_batches():
    rng, store, last, number = random.Random(5), Store(), {}, {}
    for batch in range(6):
        rows = [(rng.choice("abcde"), 1_000 * batch + n, GAP // 4 * rng.randrange(8 * batch, 8 * batch + 12)) for n in range(15)]  # some are late
        got = run(jobs.Sessions(None), store, rows, KEYED).set_index("event_id")
        for key, event, micros in sorted(rows, key=lambda r: (r[2], r[1])):
            entry = key not in last or micros - last[key] >= GAP
            last[key], number[key] = max(micros, last.get(key, micros)), number.get(key, 0) + entry
            assert tuple(got.loc[event]) == (entry, number[key])


def test_entries_expire_one_by_one():
    store = Store()
    run(jobs.Sessions(2), store, [("old", 1, 0), ("live", 2, 0)], KEYED)
    run(jobs.Sessions(2), store, [("live", 3, 1)], KEYED, DAY)
    got = run(jobs.Sessions(2), store, [("old", 4, 2), ("live", 5, 2)], KEYED, 2 * DAY + 1).set_index("event_id")
    assert bool(got.is_entry[4]) and not got.is_entry[5]  # the bucket was in use, but not this key
    first = run(state.CarriedSessions(1800, 2), store := Store(), [(1, 0, "h1", "h0"), (2, 0, "g1", "g0")], HASHED)
    assert list(first.is_entry) == [True, True]
    run(state.CarriedSessions(1800, 2), store, [(3, 1, "g2", "g1")], HASHED, DAY)
    got = run(state.CarriedSessions(1800, 2), store, [(4, 2, "h1", "h0"), (5, 2, "g2", None)], HASHED, 2 * DAY + 1).set_index("event_id")
    assert bool(got.is_entry[4]) and not got.is_entry[5] and got.first_hash[5] == "g1"


def test_movements_of_customers_that_share_a_bucket():
    store = Store()
    run(jobs.Movements(), store, [("a", "s", 1, 0, "active", 5, "USD"), ("b", "s", 2, 0, "trialing", 5, "USD")], CHANGE)
    rows = [("a", "t", 3, 10**6, "active", 7, "USD"), ("b", "s", 4, 10**6, "active", 5, "USD"), ("a", "s", 1, 0, "active", 5, "USD"), ("a", "s", 5, 2 * 10**6, "canceled", 5, "USD")]
    got = run(jobs.Movements(), store, rows, CHANGE)
    assert [tuple(r)[:3] for r in got.itertuples(index=False)] == [("a", "reactivation", 7), ("b", "new", 5), ("a", "churn", -5)]


def test_null_keys_are_keys_of_their_own(spark, tmp_path):
    jobs.with_state_store(spark)
    schema = "site_id long, ip string, event_id long, occurred_at timestamp"
    rows = spark.sql("SELECT * FROM VALUES (1L, 'null', 1L, timestamp '2024-01-01'), (1L, NULL, 2L, timestamp '2024-01-01 00:01:00'), (NULL, NULL, 3L, timestamp '2024-01-01 00:02:00'), (1L, NULL, 4L, timestamp '2024-01-01 00:03:00') AS t(site_id, ip, event_id, occurred_at)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.to_table(jobs.sessions(stream, ["site_id", "ip"], None), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.event_id, r.is_entry) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, True), (2, True), (3, True), (4, False)]
