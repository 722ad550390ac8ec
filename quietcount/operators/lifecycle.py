"""Retention, backstops, erasure, and rollups kept true to what is left.

The first functions are frames to frames. Those that take a store change stored tables: the days that lose rows
are written anew without them, their rollups are made again from what is left, and one new version shows both.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.operators import rollups
from quietcount.sources.shared import stored
from quietcount.sources.snapshots import DAY, Change, Snapshots, by_day

RAW_DAYS, ROLLUP_DAYS, HOURLY_DAYS = 790, 790, 5 * 365
#: Rollups of a store, and how they come from events.
ROLLUPS = {"hourly": rollups.hourly, "visitor_days": rollups.visitor_days, "session_days": rollups.session_days}
BACKSTOPS = {"events": RAW_DAYS, "hourly": HOURLY_DAYS, "visitor_days": ROLLUP_DAYS, "session_days": ROLLUP_DAYS}


def cutoffs(sites: DataFrame, accounts: DataFrame, now: datetime) -> DataFrame:
    """site_id and cutoff: events before it are past their account's retention."""
    joined = sites.join(accounts, "account_id")
    return joined.select("site_id", "account_id", (F.lit(now) - F.make_dt_interval(F.col("data_retention_days"))).alias("cutoff"))


def enforced(events: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that stay, count per account and day of those that go)."""
    marked = events.join(limits, "site_id", "left").withColumn("_gone", F.coalesce(F.col("occurred_at") < F.col("cutoff"), F.lit(False)))
    gone = marked.where("_gone").groupBy("account_id", F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where("NOT _gone").drop("_gone", "cutoff", "account_id"), gone


def backstop(table: DataFrame, column: str, now: datetime, days: int) -> DataFrame:
    """Rows of the last `days`; on a table partitioned by day this drops whole partitions."""
    return table.where(F.col(column) >= F.lit(now - timedelta(days=days)))


def reconciled(rollup: DataFrame, events: DataFrame, start: datetime, end: datetime, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rollup with the days around a deleted window made anew; days without events have no rows left."""
    low = (start - timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
    high = (end + timedelta(days=2)).replace(hour=0, minute=0, second=0, microsecond=0)
    inside = (F.col("bucket") >= F.lit(low)) & (F.col("bucket") < F.lit(high))
    fresh = aggregate(events.where((F.col("occurred_at") >= F.lit(low)) & (F.col("occurred_at") < F.lit(high))))
    return rollup.where(~inside).unionByName(fresh)


def erased(events: DataFrame, site_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(events of other sites, first and last event of the erased ones): the window to reconcile."""
    gone = F.col("site_id").isin(site_ids)
    window = events.where(gone).groupBy("site_id").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return events.where(~gone), window


def _rolled_up(change: Change, days: list[str]) -> None:
    """The rollups of the days from the events that the change leaves there; a bucket never reaches over a day."""
    events = change.read("events", days)
    for name, aggregate in ROLLUPS.items():
        change.replace(name, by_day(aggregate(events.drop(DAY)), "bucket"), days)


def loaded(store: Snapshots, events: DataFrame) -> int:
    """Adds events to a store and makes the rollups of their days anew; returns the version."""
    change = store.change()
    _rolled_up(change, change.append("events", by_day(events, "occurred_at").sortWithinPartitions(DAY, "site_id", "occurred_at")))
    return change.commit()


def _days(rows: DataFrame) -> list[str]:
    return sorted(str(r[0]) for r in rows.select(DAY).distinct().collect())  # days, not rows


def _deleted(store: Snapshots, marked: Callable[[DataFrame], DataFrame], group: list[str], counts: list[Column], dry_run: bool = False) -> DataFrame:
    """Deletes the events that `marked` gives a true column _gone. Returns group, event_date, n and counts of them, written down before."""
    gone = marked(store.read("events")).where("_gone")
    report = stored(gone.groupBy(*group, DAY).agg(F.count(F.lit(1)).alias("n"), *counts), "deleted")
    days = [] if dry_run else _days(report)
    if days:
        change = store.change()
        events = store.read("events", days)
        left = marked(events).where("NOT coalesce(_gone, false)").select(*events.columns)
        left = left.repartition(DAY, F.pmod(F.xxhash64("visitor_hash"), F.lit(4))).sortWithinPartitions(DAY, "site_id", "occurred_at")
        change.replace("events", left, days)
        _rolled_up(change, days)
        change.commit()
    return report


def purge_stored(store: Snapshots, site_id: int, start: datetime, end: datetime, path_prefix: str | None = None, dry_run: bool = False, now: datetime | None = None) -> DataFrame:
    """Deletes a site's events of a half-open window (under a path). Returns event_date, n and creditable: those of now's
    calendar month, which go back to the account's allowance. A dry run only counts."""
    month = (now or datetime.now()).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    gone = (F.col("site_id") == site_id) & (F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end))
    gone &= (F.col(DAY) >= F.lit(start.date())) & (F.col(DAY) <= F.lit(end.date()))  # only these folders are read
    if path_prefix:
        gone &= F.coalesce(F.col("path").startswith(path_prefix), F.lit(False))
    credit = F.count_if(F.col("occurred_at") >= F.lit(month)).alias("creditable")
    return _deleted(store, lambda rows: rows.withColumn("_gone", gone), [], [credit], dry_run)


def retention_stored(store: Snapshots, sites: DataFrame, accounts: DataFrame, now: datetime, dry_run: bool = False) -> DataFrame:
    """Deletes what is past its account's retention. Returns account_id, event_date, n."""
    limits = cutoffs(sites, accounts, now)
    latest = limits.agg(F.max("cutoff")).first()[0]  # no younger folder is read
    latest = latest or datetime(1970, 1, 1)

    def marked(rows: DataFrame) -> DataFrame:
        old = F.col(DAY) <= F.lit(latest.date())
        return rows.join(limits, "site_id", "left").withColumn("_gone", old & F.coalesce(F.col("occurred_at") < F.col("cutoff"), F.lit(False)))

    return _deleted(store, marked, ["account_id"], [], dry_run)


def erase_stored(store: Snapshots, site_ids: list[int]) -> DataFrame:
    """Deletes all events of sites. Returns site_id, event_date, n, first and last."""
    gone = F.col("site_id").isin(site_ids)
    times = [F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last")]
    return _deleted(store, lambda rows: rows.withColumn("_gone", gone), ["site_id"], times)


def backstop_stored(store: Snapshots, now: datetime, days: dict[str, int] | None = None) -> dict[str, list[str]]:
    """Drops days older than a table keeps: a new version without them, no file is read or written. Rollups of raw days that are
    gone stay for as long as they are kept themselves."""
    change, gone = store.change(), {}
    for table, keep in (days or BACKSTOPS).items():
        first = str((now - timedelta(days=keep)).date())
        gone[table] = sorted(d for d in change.tables.get(table, {"days": {}})["days"] if d < first)
        change.drop(table, gone[table])
    if any(gone.values()):
        change.commit()
    return gone
