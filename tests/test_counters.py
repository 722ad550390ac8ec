"""Running totals of the streams: carried over many batches in two folders, dropped after they were idle."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from quietcount.streaming import jobs

START = datetime(2024, 1, 1)


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_counters_run_on_and_expire(spark, tmp_path):
    schema = "event_id long, account_id long, occurred_at timestamp"
    limits = spark.createDataFrame([(1, 2), (2, None)], "account_id long, monthly_event_limit long")
    names = [str(tmp_path / n) for n in ("counters", "out", "checkpoint")]
    batches = [[(1, 1, START), (2, 2, START)], [(3, 1, START + timedelta(days=1))], [(4, 1, START + timedelta(days=2)), (5, 1, START + timedelta(days=2))], [(6, 2, START + timedelta(days=80))]]
    for rows in batches:
        jobs.quota(arrive(spark, str(tmp_path / "in"), rows, schema), limits, *names).awaitTermination()
    got = {r.event_id: (r.seq, r.refused) for r in spark.read.parquet(names[1]).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (2, False), 4: (3, True), 5: (4, True), 6: (1, False)}
    assert sorted(p.name for p in (tmp_path / "counters").iterdir() if p.is_dir()) == ["slot=0", "slot=1"]
    assert [r.month for r in spark.read.parquet(f"{names[0]}/slot=1").collect()] == ["2024-03"]  # January's were idle for too long


def test_sites_are_noticed_once(spark, tmp_path):
    schema = "site_id long, occurred_at timestamp"
    names = [str(tmp_path / n) for n in ("known", "out", "checkpoint")]
    for n, sites in enumerate([[1, 2], [2], [1, 3], [3]]):
        jobs.first_events(arrive(spark, str(tmp_path / "in"), [(s, START + timedelta(days=n)) for s in sites], schema), *names).awaitTermination()
    assert sorted((r.site_id, (r.first_event_at - START).days) for r in spark.read.parquet(names[1]).collect()) == [(1, 0), (2, 0), (3, 2)]


def test_sessions_with_expiry_run_on(spark, tmp_path):
    jobs.with_state_store(spark)
    schema = "user_id long, event_id long, occurred_at timestamp"
    stream = arrive(spark, str(tmp_path / "in"), [(1, n, START + timedelta(minutes=m)) for n, m in enumerate((0, 10, 50))], schema)
    query = jobs.sessions(stream, ["user_id"]).writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while time.time() < until and query.isActive and spark.table("running").count() < 3:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted((r.event_id, r.is_entry, r.session_number) for r in spark.table("running").collect()) == [(0, True, 1), (1, False, 1), (2, True, 2)]
