"""Goals: conversions, converters and revenue of all goals in one pass; dashboards made of reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.filters import cleaned, predicate
from quietcount.functions.matchers import Matcher
from quietcount.functions.suppression import percent
from quietcount.operators import reports, sequences


@dataclass(frozen=True)
class Goal:
    goal_id: int
    matcher: Matcher


def convertible(goals: list[Goal], filters: dict | None) -> list[Goal]:
    """Under an event filter, the event goals that the filtered event can satisfy."""
    name = cleaned(filters).get("event")
    return [g for g in goals if name is None or (g.matcher.kind == "event" and g.matcher.matches(name))]


def goal_report(scope: DataFrame, goals: list[Goal], filters: dict | None = None) -> DataFrame:
    """Per site and goal: conversions, visitors, rate against the scope's visitors, revenue by currency.

    Goals are a bounded configuration; an event is dealt into a row per goal that it satisfies.
    """
    rows = scope.where(predicate(filters))
    total = rows.groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("total"))
    live = convertible(goals, filters)
    spark = scope.sparkSession
    if not live:
        return spark.createDataFrame([], "site_id long, goal_id int, conversions long, visitors long, conversion_rate double, revenue string")
    met = F.array_compact(F.array(*[F.when(g.matcher.column(), F.lit(g.goal_id)) for g in live]))
    hits = rows.select("site_id", "visitor_hash", "currency", "revenue_cents", F.explode(met).alias("goal_id"))
    by_visitor = hits.groupBy("site_id", "goal_id", "visitor_hash").agg(F.count(F.lit(1)).alias("n"))
    counts = by_visitor.groupBy("site_id", "goal_id").agg(F.sum("n").alias("conversions"), F.count(F.lit(1)).alias("visitors"))
    money = hits.where("coalesce(currency, '') <> ''").groupBy("site_id", "goal_id", "currency").agg(F.sum("revenue_cents").alias("cents")).where("cents > 0")
    money = money.groupBy("site_id", "goal_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "currency", "cents"))), ",").alias("revenue"))
    grid = total.select("site_id", "total", F.explode(F.array(*[F.lit(g.goal_id) for g in live])).alias("goal_id"))
    out = grid.join(counts, ["site_id", "goal_id"], "left").join(money, ["site_id", "goal_id"], "left").na.fill(0).na.fill("")
    return out.select("site_id", "goal_id", "conversions", "visitors", percent(F.col("visitors"), F.col("total")).alias("conversion_rate"), "revenue")


PANELS = ["page", "entry_page", "source", "country", "device", "browser", "os", "utm_campaign"]


def dashboard(scope: DataFrame, bounds: DataFrame, goals: list[Goal], filters: dict | None = None, unit: str = "day", live: DataFrame | None = None) -> dict[str, DataFrame]:
    """The default dashboard: summary, time series, panels, goals; events only where there are rows to show, properties under
    an event or property filter, next steps under a page filter; live: the visitors of the last minutes. All other parts read one frame."""
    kept = cleaned(filters)
    now = scope.where("window = 'cur'")
    out = {
        "summary": reports.compared(reports.summary(scope, bounds, filters)),
        "timeseries": reports.timeseries(now, bounds, unit, filters),
        "panels": reports.panels(now, PANELS, filters),
        "events": reports.panels(now, ["event"], filters),
        "goals": goal_report(now, goals, filters),
    }
    if live is not None:
        out["realtime"] = live
    if "event" in kept or any(k.startswith("props:") for k in kept):
        out["properties"] = reports.property_breakdown(now, filters)
    if "page" in kept:
        out["next_steps"] = sequences.flow(sequences.steps(now, True, filters), [("pageview", kept["page"])])
    return out


@dataclass(frozen=True)
class Widget:
    """A saved report: stat, timeseries, breakdown, goals or funnel, with its filters and row limit."""

    widget_id: int
    kind: str
    dimension: str | None = None
    filters: dict = field(default_factory=dict)
    row_limit: int = 5
    funnel: sequences.Funnel | None = None


def stat_widgets(scope: DataFrame, widgets: list[Widget], bounds: DataFrame) -> DataFrame:
    """widget_id, site_id, and each metric of the period beside its change, of all stat widgets; those of equal filters share a summary.

    scope tells its windows (scoped(previous=True))."""
    groups: dict[tuple, list[int]] = {}
    for w in widgets:
        if w.kind == "stat":
            groups.setdefault(tuple(sorted(cleaned(w.filters).items())), []).append(w.widget_id)
    parts = [
        reports.compared(reports.summary(scope, bounds, dict(key))).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("widget_id"), "*")
        for key, ids in groups.items()
    ]
    if not parts:
        return reports.compared(reports.summary(scope, bounds)).select(F.lit(0).alias("widget_id"), "*").limit(0)
    return reduce(DataFrame.unionByName, parts)


def saved_dashboard(scope: DataFrame, widgets: list[Widget], goals: list[Goal], bounds: DataFrame, events: DataFrame, unit: str = "day") -> DataFrame:
    """Rows of all widgets: widget_id, status, site_id, label, visitors, volume. A time series' label is its bucket, a
    funnel's its step, with those it lost as volume. What a stat widget shows beside is in `stat_widgets`.

    Widgets with equal filters share a scan: their panels come from one pass, their totals from another.
    Each panel is cut to its widget's limit after suppression. A widget that can't be drawn has
    status invalid, a funnel that is gone missing_funnel.
    """
    parts: list[DataFrame] = []
    groups: dict[tuple, list[Widget]] = {}
    for w in widgets:
        groups.setdefault(tuple(sorted(cleaned(w.filters).items())), []).append(w)
    row = ["widget_id", "status", "site_id", "label", "visitors", "volume"]
    for key, members in groups.items():
        filters = dict(key)
        shown = [w for w in members if w.kind == "breakdown" and w.dimension in reports.DIMENSIONS]
        if shown:
            found = reports.panels(scope, sorted({w.dimension for w in shown}), filters, max(w.row_limit for w in shown))
            for w in shown:
                own = found.where((F.col("dimension") == w.dimension) & (F.col("rank") <= w.row_limit))
                parts.append(own.select(F.lit(w.widget_id).alias("widget_id"), F.lit("ok").alias("status"), "site_id", F.col("value").alias("label"), "visitors", "volume"))
        stats = [w for w in members if w.kind == "stat"]
        if stats:
            totals = scope.where(predicate(filters)).groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("visitors"), reports.volume(filters).alias("volume"))
            ids = F.explode(F.array(*[F.lit(w.widget_id) for w in stats])).alias("widget_id")
            parts.append(totals.select(ids, F.lit("ok").alias("status"), "site_id", F.lit(None).cast("string").alias("label"), "visitors", "volume"))
        measured = [w for w in members if w.kind == "goals"]
        if measured:
            found = goal_report(scope, goals, filters)
            order = Window.partitionBy("site_id").orderBy(F.col("visitors").desc(), "goal_id")
            for w in measured:
                own = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= w.row_limit)
                parts.append(own.select(F.lit(w.widget_id).alias("widget_id"), F.lit("ok").alias("status"), "site_id", F.col("goal_id").cast("string").alias("label"), "visitors", F.col("conversions").alias("volume")))
        series = [w for w in members if w.kind == "timeseries"]
        if series:
            found = reports.timeseries(scope, bounds, unit, filters)
            ids = F.explode(F.array(*[F.lit(w.widget_id) for w in series])).alias("widget_id")
            parts.append(found.select(ids, F.lit("ok").alias("status"), "site_id", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("label"), "visitors", "volume"))
        funnels = [w for w in members if w.kind == "funnel" and w.funnel and w.funnel.valid]
        for w in funnels:
            found = sequences.funnel_report(sequences.funnel_counts(events, scope, w.funnel, filters))
            parts.append(found.select(F.lit(w.widget_id).alias("widget_id"), F.lit("ok").alias("status"), "site_id", F.col("step").cast("string").alias("label"), "visitors", F.col("dropped").alias("volume")))
        for w in members:
            if w not in shown + stats + measured + series + funnels:
                status = "missing_funnel" if w.kind == "funnel" and w.funnel is None else "invalid"
                none = scope.select("site_id").distinct()
                nothing = F.lit(None).cast("long")
                parts.append(none.select(F.lit(w.widget_id).alias("widget_id"), F.lit(status).alias("status"), "site_id", F.lit(None).cast("string").alias("label"), nothing.alias("visitors"), nothing.alias("volume")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*row)
