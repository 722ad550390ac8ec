"""Metering and operations: usage, quotas, notices, opt-outs, rejections, first events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.period import within

WARNING = 0.8


def usage(hours: DataFrame, sites: DataFrame) -> DataFrame:
    """Events per account and UTC month, from the hourly rollup."""
    joined = hours.join(sites.select("site_id", "account_id"), "site_id")
    return joined.groupBy("account_id", F.date_format("bucket", "yyyy-MM").alias("month")).agg(F.sum(F.col("pageviews") + F.col("custom_events")).alias("used"))


def snapshot(used: DataFrame, accounts: DataFrame, today: datetime) -> DataFrame:
    """Usage against each account's limit; a null limit is unlimited."""
    rows = used.join(accounts.select("account_id", "monthly_event_limit"), "account_id")
    limit, n = F.col("monthly_event_limit"), F.col("used")
    fraction = F.when(limit > 0, n / limit)
    day = F.lit(today.date())
    return rows.select(
        "account_id", "month", "used", limit.alias("monthly_event_limit"),
        F.when(fraction.isNotNull(), F.floor(F.least(fraction, F.lit(1.0)) * 100)).alias("percent"),
        F.coalesce(n > limit, F.lit(False)).alias("exceeded"),
        F.coalesce((fraction >= WARNING) & (n <= limit), F.lit(False)).alias("approaching"),
        F.greatest(n - limit, F.lit(0)).alias("refused"),
        F.greatest(limit - n, F.lit(0)).alias("remaining"),
        F.date_diff(F.date_add(F.last_day(day), 1), day).alias("days_to_reset"),
    )


def notices(snapshots: DataFrame, sent: DataFrame) -> DataFrame:
    """New threshold notices: at most one per account, month and level; exceeded comes before approaching."""
    level = F.when(F.col("exceeded"), "exceeded").when(F.col("approaching"), "approaching")
    due = snapshots.select("account_id", "month", level.alias("level")).where("level IS NOT NULL")
    return due.join(sent, ["account_id", "month", "level"], "left_anti")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (account_id, occurred_at, event_id) with seq, their number in the account's UTC month by time and id.

    Hours of a month and seconds of an hour are numbered over their totals (744 and 3,600 rows at most), events within their second:
    no window holds more of a busy account than one second of it.
    """
    account, month, hour = F.col("account_id"), F.date_trunc("month", "occurred_at"), F.date_trunc("hour", "occurred_at")
    rows = rows.withColumn("_second", F.date_trunc("second", "occurred_at"))

    def ahead(*of: str) -> Column:
        w = Window.partitionBy("account_id", of[0]).orderBy(of[1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    seconds = rows.groupBy(account, month.alias("_month"), hour.alias("_hour"), "_second").agg(F.count(F.lit(1)).alias("n"))
    hours = seconds.groupBy("account_id", "_month", "_hour").agg(F.sum("n").alias("n"))
    hours = hours.select("account_id", "_hour", ahead("_month", "_hour").alias("_before_hour"))
    seconds = seconds.select("account_id", "_hour", "_second", ahead("_hour", "_second").alias("_before")).join(hours, ["account_id", "_hour"])
    seconds = seconds.select("account_id", "_second", (F.col("_before_hour") + F.col("_before")).alias("_ahead"))
    order = Window.partitionBy("account_id", "_second").orderBy("occurred_at", "event_id")
    rows = rows.withColumn("_nth", F.row_number().over(order)).join(seconds, ["account_id", "_second"])
    return rows.withColumn("seq", F.col("_ahead") + F.col("_nth")).drop("_second", "_nth", "_ahead")


def over_quota(events: DataFrame, sites: DataFrame, accounts: DataFrame) -> DataFrame:
    """event_id, account_id, seq (its number in the account's UTC month), refused."""
    dims = sites.select("site_id", "account_id").join(accounts.select("account_id", "monthly_event_limit"), "account_id")
    rows = numbered(events.join(dims, "site_id"))
    return rows.select("event_id", "account_id", "seq", F.coalesce(F.col("seq") > F.col("monthly_event_limit"), F.lit(False)).alias("refused"))


def repaired(counters: DataFrame, recorded: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """Usage counters (account_id, month, used) raised to what was recorded, less credits, not under 0."""
    out = counters.join(recorded.withColumnRenamed("used", "recorded"), ["account_id", "month"], "full")
    out = out.withColumn("used", F.greatest(F.coalesce("used", F.lit(0)), F.coalesce("recorded", F.lit(0)))).drop("recorded")
    if credits is not None:
        out = out.join(credits, ["account_id", "month"], "left").withColumn("used", F.greatest(F.col("used") - F.coalesce("credit", F.lit(0)), F.lit(0))).drop("credit")
    return out


def opt_outs(requests: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Opted-out requests per site and hour of a range."""
    rows = within(requests.where("opted_out"), start, end)
    return rows.groupBy("site_id", F.date_trunc("hour", "occurred_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def rejections(rejects: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Rejected requests per site and reason in a look-back."""
    rows = within(rejects, now - timedelta(days=days), now)
    return rows.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def top_hosts(rejects: DataFrame, limit: int = 10) -> DataFrame:
    """The most refused hosts of each site."""
    counted = rejects.where("offending_host IS NOT NULL").groupBy("site_id", "offending_host").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("site_id").orderBy(F.col("n").desc(), "offending_host")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def first_events(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site's first event; null for sites that still wait for data."""
    return sites.select("site_id").join(events.groupBy("site_id").agg(F.min("occurred_at").alias("first_event_at")), "site_id", "left")


def recent_total(events: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Events of the instance since `hours` before now."""
    return within(events, now - timedelta(hours=hours)).agg(F.count(F.lit(1)).alias("events"))
