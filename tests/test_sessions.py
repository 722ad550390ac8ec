"""Sessions worked off hour by hour against one pass over each key's events."""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quietcount.operators import ingest

START = datetime(2024, 3, 5, 22, 10)
SCHEMA = "site_id long, ip string, event_id long, occurred_at timestamp"


def brute(rows, seconds):
    out, last = {}, {}
    for site, ip, event, at in sorted(rows, key=lambda r: (r[3], r[2])):
        when, number, began = last.get((site, ip), (None, 0, None))
        entry = when is None or (at - when).total_seconds() >= seconds
        number, began = (number + 1, at) if entry else (number, began)
        last[(site, ip)] = (at, number, began)
        out[event] = (entry, number, began)
    return out


def check(spark, rows, seconds=1800):
    df = ingest.sessionised(spark.createDataFrame(rows, SCHEMA), ["site_id", "ip"], seconds)
    assert {r.event_id: (r.is_entry, r.session_number, r.session_at) for r in df.collect()} == brute(rows, seconds)
    assert df.columns == ["site_id", "ip", "event_id", "occurred_at", "is_entry", "session_number", "session_at"]


def test_gaps_over_hours_and_null_keys(spark):
    minutes = [0, 29, 58, 88, 117, 118, 118, 148, 177.99, 300, 301, 900, 929, 1500]
    rows = [(1, ip, 100 * k + n, START + timedelta(minutes=m)) for k, ip in enumerate(("a", None, "b")) for n, m in enumerate(minutes[k:])]
    rows += [(None, None, 900, START), (None, "a", 901, START)]
    check(spark, rows)
    check(spark, rows, 10_800)  # a gap longer than the hour that a key is cut by


def test_a_key_that_never_pauses_is_one_session_over_days(spark):
    rows = [(1, "proxy", n, START + timedelta(minutes=11 * n)) for n in range(600)]
    check(spark, rows)
    assert ingest.sessionised(spark.createDataFrame(rows, SCHEMA), ["site_id", "ip"]).select("session_at").distinct().count() == 1


def test_no_window_holds_a_key(spark):
    df = ingest.sessionised(spark.createDataFrame([(1, "a", 1, START)], SCHEMA), ["site_id", "ip"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window [" in line and "occurred_at" in line and "_hour" not in line]
    assert not wide
    assert ingest.sessionised(spark.createDataFrame([], SCHEMA), ["site_id", "ip"]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.sampled_from(["a", None]), st.integers(0, 40)), min_size=1, max_size=60))
def test_random_events(spark, cells):
    check(spark, [(site, ip, n, START + timedelta(minutes=15 * step)) for n, (site, ip, step) in enumerate(cells)])
