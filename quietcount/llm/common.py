"""What the operators of this subpackage share: word rules, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regex class, and the same characters for trim().
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = "\t\n\x0b\x0c\r "
ARROW_BYTES = 4 * 1024 * 1024
#: Rows of a few numbers up to which a join side is broadcast, after they were counted.
BROADCAST_ROWS = 500_000
_LOCAL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh one where unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-quietcount-")
        _LOCAL[context.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quietcount-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with Arrow batches of ARROW_BYTES at most, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(f, schema)


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def free_name(base: str, columns: list[str]) -> str:
    """base, or base with underscores behind it, that is no column's name (names are told apart without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def few(df: DataFrame) -> DataFrame:
    """df (thin rows) with a broadcast hint if a count shows it to be small; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
