"""Report periods as columns of the sites frame: half-open UTC ranges of site-local days."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESETS = ("today", "yesterday", "7d", "30d", "90d", "12mo", "month", "custom")
DEFAULT, MAX_CUSTOM_DAYS = "30d", 730


def site_bounds(sites: DataFrame, preset: str, now: datetime, start: date | None = None, end: date | None = None) -> DataFrame:
    """sites with from_ts, to_ts, prev_from_ts and unit.

    An unknown preset, or a custom one without both dates, is the default; reversed dates are swapped
    and a range is capped at MAX_CUSTOM_DAYS. unit is the bucket width that the range's length asks for.
    """
    local = "from_utc_timestamp(timestamp '{}', timezone)".format(now.strftime("%Y-%m-%d %H:%M:%S.%f"))
    today = f"date_trunc('DAY', {local})"
    lower = {
        "today": today,
        "yesterday": f"{today} - INTERVAL 1 DAY",
        "7d": f"{today} - INTERVAL 6 DAYS",
        "30d": f"{today} - INTERVAL 29 DAYS",
        "90d": f"{today} - INTERVAL 89 DAYS",
        "12mo": f"date_trunc('MONTH', add_months({today}, -11))",
        "month": f"date_trunc('MONTH', {today})",
    }
    upper = today if preset == "yesterday" else f"{today} + INTERVAL 1 DAY"
    if preset == "custom" and start and end:
        start, end = min(start, end), max(start, end)
        end = min(end, start + timedelta(days=MAX_CUSTOM_DAYS))
        low, upper = f"timestamp '{start} 00:00:00'", f"timestamp '{end} 00:00:00' + INTERVAL 1 DAY"
    else:
        low = lower.get(preset, lower[DEFAULT])
    out = sites.withColumn("from_ts", F.expr(f"to_utc_timestamp({low}, timezone)")).withColumn("to_ts", F.expr(f"to_utc_timestamp({upper}, timezone)"))
    out = out.withColumn("prev_from_ts", F.col("from_ts") - (F.col("to_ts") - F.col("from_ts")))
    days = F.ceil((F.unix_timestamp("to_ts") - F.unix_timestamp("from_ts")) / 86400)
    unit = F.when(days <= 2, "hour").when(days <= 90, "day").when(days <= 400, "week").otherwise("month")
    return out.withColumn("unit", unit)


def within(rows: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows of a half-open range of times; of a table that is kept by day, only the folders that hold it are listed and opened."""
    by_day = "event_date" in rows.columns
    if start:
        rows = rows.where(F.col("occurred_at") >= F.lit(start))
        rows = rows.where(F.col("event_date") >= F.lit(start.date())) if by_day else rows
    if end:
        rows = rows.where(F.col("occurred_at") < F.lit(end))
        rows = rows.where(F.col("event_date") <= F.lit(end.date())) if by_day else rows
    return rows


def widest(preset: str, now: datetime, start: date | None = None, end: date | None = None) -> tuple[datetime, datetime]:
    """UTC times that hold the period and the one before it in every zone; for pruning files."""
    if preset == "custom" and start and end:
        a, b = min(start, end), max(start, end)
        low, high = datetime(a.year, a.month, a.day), datetime(b.year, b.month, b.day) + timedelta(days=1)
    else:
        days = {"today": 1, "yesterday": 2, "7d": 7, "30d": 30, "90d": 90, "12mo": 366, "month": 31}.get(preset, 30)
        low, high = now - timedelta(days=days), now + timedelta(days=1)
    span = high - low
    return low - span - timedelta(days=2), high + timedelta(days=2)
