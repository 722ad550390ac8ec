"""Sources and sinks: the event table's layout, rollups replaced by key, webhook log, purges, dead letters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_events(events: DataFrame, path: str, mode: str = "append", files_per_day: int = 4) -> None:
    """Events by UTC day, clustered by site and time in each file, so a site's report reads few row groups.

    A day is dealt over several files by visitor: one busy day doesn't land in one task.
    """
    rows = events.withColumn("event_date", F.to_date("occurred_at"))
    salt = F.pmod(F.xxhash64("visitor_hash"), F.lit(files_per_day))
    rows.repartition("event_date", salt).sortWithinPartitions("event_date", "site_id", "occurred_at").write.partitionBy("event_date").mode(mode).parquet(path)


def scan_events(spark: SparkSession, path: str, schema: T.StructType | None = None, site_ids: list[int] | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events of sites in a half-open time range; the day partitions are pruned by bounds made from the times."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])) if schema else spark.read
    rows = reader.parquet(path)
    if start:
        rows = rows.where((F.col("occurred_at") >= F.lit(start)) & (F.col("event_date") >= F.lit(start.date())))
    if end:
        rows = rows.where((F.col("occurred_at") < F.lit(end)) & (F.col("event_date") <= F.lit(end.date())))
    return rows.where(F.col("site_id").isin(site_ids)) if site_ids is not None else rows


def replace_days(rows: DataFrame, path: str, keys: list[str], files_per_key: int = 4) -> None:
    """Replaces the partitions of `keys` that rows have, and no others.

    A partition is dealt over several files by row, a whole batch is written as it comes: no busy one lands in one task."""
    if keys != ["batch_id"]:
        hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
        rows = rows.repartition(*keys, F.pmod(F.xxhash64(*hashed), F.lit(files_per_key)))
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def split_storable(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, dead letters with their errors)."""
    marked = rows.withColumn("errors", errors)
    return marked.where("size(errors) = 0").drop("errors"), marked.where("size(errors) > 0").withColumn("rejected_at", F.current_timestamp())


def row_errors() -> Column:
    """Column constraints of the event table."""
    checks = [
        F.when(F.col("occurred_at").isNull(), "occurred_at"),
        F.when(F.col("site_id").isNull(), "site_id"),
        F.when(F.col("country_code").isNotNull() & ~F.col("country_code").rlike("^[A-Z]{2}$"), "country_code"),
        F.when(F.col("currency").isNotNull() & ~F.col("currency").rlike("^[A-Z]{3}$"), "currency"),
    ]
    return F.array_compact(F.array(*checks))


def purge(events: DataFrame, site_id: int, start: datetime, end: datetime, path_prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, count per day of what goes): a dry run looks at the second only."""
    gone = (F.col("site_id") == site_id) & (F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end))
    if path_prefix:
        gone &= F.coalesce(F.col("path").startswith(path_prefix), F.lit(False))
    counts = events.where(gone).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return events.where(~gone), counts


def webhook_log(raw: DataFrame) -> DataFrame:
    """Payment-processor events of a JSON log, once per site and event, with what their dispatch needs."""
    schema = "id string, type string, created long, data struct<object: string>"
    read = raw.withColumn("e", F.from_json("payload", schema))
    rows = read.select("site_id", F.col("e.id").alias("event_id"), F.col("e.type").alias("event_type"), F.timestamp_seconds("e.created").alias("occurred_at"), F.col("e.data.object").alias("object"))
    return rows.where("event_id IS NOT NULL").dropDuplicates(["site_id", "event_id"])


def backfilled_changes(subscriptions: DataFrame) -> DataFrame:
    """Imported subscriptions as rows of the change log; their time is that of the end, else the start, else the record."""
    at = F.coalesce("canceled_at", "started_at", "created_at")
    return subscriptions.withColumn("event_at", at).withColumn("received_at", at).withColumn("event_id", F.concat(F.lit("backfill_"), "subscription_id"))


def unprocessed(log: DataFrame) -> DataFrame:
    """Deliveries that failed or were never processed, in the order of their events."""
    return log.where("processed_at IS NULL").orderBy("occurred_at", "event_id")
