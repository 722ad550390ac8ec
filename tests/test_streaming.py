"""Streaming jobs that no registered query covers, on small files."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quietcount.sources import tables
from quietcount.streaming import jobs

START = datetime(2024, 6, 15, 10)


def streamed(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_beacons_are_read_leniently(spark, tmp_path):
    rows = [{"event_id": 1, "body": json.dumps({"s": "x" * 16, "u": "https://a.org/", "w": "12"}), "received_at": "2024-06-15T10:00:00"}, {"event_id": 2, "body": "broken"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = jobs.beacons(spark, str(tmp_path / "in")).select("event_id", "u", "w")
    jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "https://a.org/", 12), (2, None, None)]


def test_unstorable_rows_go_to_dead_letters(spark, tmp_path):
    rows = [(1, START, "DE", "USD"), (2, START, "de", "USD"), (None, START, None, None)]
    stream = streamed(spark, spark.createDataFrame(rows, "site_id long, occurred_at timestamp, country_code string, currency string"), str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("good", "dead", "checkpoint")]
    for _ in range(2):  # a second start has nothing new to do
        jobs.storable(stream, tables.row_errors, *paths).awaitTermination()
    assert [r.site_id for r in spark.read.parquet(paths[0]).collect()] == [1]
    assert sorted(r.errors for r in spark.read.parquet(paths[1]).collect()) == [["country_code"], ["site_id"]]


def test_active_visitors_slide_by_the_minute(spark, tmp_path):
    rows = [(1, START + timedelta(seconds=s), v) for s, v in ((0, "a"), (30, "a"), (90, "b"), (400, "c"))]
    stream = streamed(spark, spark.createDataFrame(rows, "site_id long, occurred_at timestamp, visitor_hash string"), str(tmp_path / "in"))
    jobs.active_visitors(stream).writeStream.format("memory").queryName("active").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.at: r.visitors for r in spark.table("active").collect()}
    assert got[START + timedelta(minutes=5)] == 2 and got[START + timedelta(minutes=8)] == 1
    assert spark.table("active").where(F.col("visitors") > 2).count() == 0
