"""k-anonymity with complementary suppression: as windows over a report's rows, and as a bounded top of each panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place, half up in whole numbers; 0 for nothing."""
    return F.when(whole > 0, F.floor((part * 2000 + whole) / (whole * 2)) / 10.0).otherwise(F.lit(0.0))


def suppress(rows: DataFrame, panel: list[str], ties: list[Column], k: str = "k") -> DataFrame:
    """rows (with visitors and k) with withheld, withheld_rows and withheld_visitors.

    Rows under k are withheld; if that is exactly one, so is the smallest of the others (the
    first in the order of `ties`), since it could be told from the total.
    """
    w = Window.partitionBy(*panel)
    small = F.col("visitors") < F.col(k)
    marked = rows.withColumn("_small", small).withColumn("_n", F.count_if(small).over(w))
    order = w.orderBy(F.col("_small").asc(), F.col("visitors").asc(), *ties)
    marked = marked.withColumn("withheld", F.col("_small") | ((F.col("_n") == 1) & (F.row_number().over(order) == 1)))
    out = marked.withColumn("withheld_rows", F.count_if("withheld").over(w))
    out = out.withColumn("withheld_visitors", F.coalesce(F.sum(F.when(F.col("withheld"), F.col("visitors"))).over(w), F.lit(0)))
    return out.drop("_small", "_n")


def top(rows: DataFrame, panel: list[str], limit: int, volume: str = "volume", values: tuple[str, ...] = ("value",), total_in: str | None = None) -> DataFrame:
    """The first `limit` rows of each panel that are not withheld, by visitors, volume and values, with rank, withheld_rows, withheld_visitors
    and kept_visitors (the panel's sum of what is not withheld).

    No task sees all values of a panel: what suppression must know is a handful of sums and one smallest row per panel, and every
    task keeps only its own first rows before they meet. total_in: a panel column whose '' row holds the grand total; its visitors
    become total_visitors of the other panels of the remaining columns. rows have visitors and k.
    """
    small = F.col("visitors") < F.col("k")
    key = [F.struct(F.col(v).isNull().alias("none"), F.col(v).alias("v")).alias(f"v{i}") for i, v in enumerate(values)]
    least = F.struct("visitors", (-F.col(volume)).alias("less"), *key)
    facts = rows.groupBy(*panel).agg(
        F.count_if(small).alias("n_small"), F.coalesce(F.sum(F.when(small, F.col("visitors"))), F.lit(0)).alias("small_visitors"),
        F.coalesce(F.sum(F.when(~small, F.col("visitors"))), F.lit(0)).alias("other_visitors"), F.min(F.when(~small, least)).alias("least"), F.max("visitors").alias("most"),
    )
    if total_in:
        # a site has a few panels; taken together they share the total, and the total's own panel goes
        others = [c for c in panel if c != total_in]
        cells = F.collect_list(F.struct(total_in, "n_small", "small_visitors", "other_visitors", "least"))
        facts = facts.groupBy(*others).agg(F.max(F.when(F.col(total_in) == "", F.col("most"))).alias("total_visitors"), cells.alias("cells"))
        facts = facts.select(*others, "total_visitors", F.explode(F.filter("cells", lambda c: c[total_in] != "")).alias("c")).select(*others, "total_visitors", "c.*")
    order = Window.partitionBy(*panel).orderBy(F.col("visitors").desc(), F.col(volume).desc(), *[F.col(v).asc_nulls_last() for v in values])
    # one more than asked for, in case that the complement to a lone small row is among them
    first = rows.where(~small).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    out = first.join(facts.drop("most"), panel)
    hidden = F.col("n_small") == 1
    place = lambda visitors, less, cells: F.struct((-visitors).alias("a"), less.alias("b"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    own = place(F.col("visitors"), -F.col(volume), key)
    gone = place(F.col("least.visitors"), F.col("least.less"), [F.col(f"least.v{i}") for i in range(len(values))])
    out = out.where(~(hidden & (own == gone))).withColumn("rank", F.col("rank") - (hidden & (gone < own)).cast("int")).where(F.col("rank") <= limit)
    more = hidden & F.col("least").isNotNull()
    return out.withColumns({
        "withheld_rows": F.col("n_small") + more.cast("int"),
        "withheld_visitors": F.col("small_visitors") + F.when(more, F.col("least.visitors")).otherwise(0),
        "kept_visitors": F.col("other_visitors") - F.when(more, F.col("least.visitors")).otherwise(0),
    }).drop("n_small", "small_visitors", "other_visitors", "least")
