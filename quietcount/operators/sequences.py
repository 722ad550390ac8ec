"""Ordered funnels and next-step flows: sequences of a visitor's or session's events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.filters import predicate, qualified
from quietcount.functions.matchers import Matcher, any_of
from quietcount.functions.suppression import percent, top
from quietcount.operators import reports
from quietcount.schema import PAGEVIEW

DAY, MONTH = 86_400, 30 * 86_400


@dataclass(frozen=True)
class Funnel:
    """steps: for each step up to five matchers, any of which will do. window_seconds: from a step to the next."""

    funnel_id: int
    steps: tuple[tuple[Matcher, ...], ...]
    window_seconds: int = DAY
    site_id: int | None = None

    @property
    def valid(self) -> bool:
        return 2 <= len(self.steps) <= 8 and all(self.steps) and 60 <= self.window_seconds <= MONTH

    @property
    def exceeds_identity(self) -> bool:
        """Whether the window is longer than a visitor's identity lives."""
        return self.window_seconds > DAY


def funnel_counts(events: DataFrame, scope: DataFrame, funnel: Funnel, filters: dict | None = None, window_from: str = "previous", period: tuple[datetime, datetime] | None = None) -> DataFrame:
    """site_id, step, visitors. period: times that hold the scope; with it only events up to the last step's window after it are read.
    Step 0 is a visitor's first match in the filtered period; step i the earliest match
    at or after step i-1's time and at most the window later, of any event of the visitor.

    One pass over each visitor's matching events in time order: those of one instant are merged
    by their bits (an event may serve two steps), then a fold carries the times reached. Only
    matching events of visitors who enter are shuffled, grouped by (site, visitor).
    """
    masks = [any_of(list(s)) for s in funnel.steps]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(m, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)])
    entered = scope.where(predicate(filters) & masks[0]).groupBy("site_id", "visitor_hash").agg(F.min("occurred_at").alias("t0"))
    if period:
        last = period[1] + timedelta(seconds=(len(funnel.steps) - 1) * funnel.window_seconds)
        events = events.where((F.col("occurred_at") >= F.lit(period[0])) & (F.col("occurred_at") <= F.lit(last)))
    hits = events.withColumn("bits", bits).where("bits > 0").select("site_id", "visitor_hash", "occurred_at", "bits")
    hits = hits.join(entered, ["site_id", "visitor_hash"]).where("occurred_at >= t0")
    instants = hits.groupBy("site_id", "visitor_hash", "t0", "occurred_at").agg(F.bit_or("bits").alias("bits"))
    paths = instants.groupBy("site_id", "visitor_hash", "t0").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("occurred_at").alias("t"), "bits"))).alias("path"))
    window = funnel.window_seconds * 1_000_000
    # reached: the time of each step so far; an instant may take several steps at once. A later match of an
    # earlier step must not move its time: the earliest one is what the next step counts from.
    step = f"""(r, x) -> aggregate(sequence(1, {len(funnel.steps) - 1}), r, (q, i) ->
        CASE WHEN size(q) = i AND (x.bits & shiftleft(1, i)) > 0
              AND x.t <= (CASE WHEN '{window_from}' = 'first' THEN q[0] ELSE q[i - 1] END) + {window}
             THEN concat(q, array(x.t)) ELSE q END)"""
    reached = paths.withColumn("reached", F.expr(f"size(aggregate(path, array(unix_micros(t0)), {step}))"))
    counts = reached.groupBy("site_id").agg(*[F.count_if(F.col("reached") > i).alias(f"s{i}") for i in range(len(masks))])
    cells = F.array(*[F.col(f"s{i}") for i in range(len(masks))])
    return counts.select("site_id", F.posexplode(cells).alias("step", "visitors"))


def funnel_counts_by_joins(events: DataFrame, scope: DataFrame, funnel: Funnel, filters: dict | None = None) -> DataFrame:
    """The same counts as a chain of joins, one per step: the plain form that tests hold the fold against."""
    masks = [any_of(list(s)) for s in funnel.steps]
    keys = ["site_id", "visitor_hash"]
    now = scope.where(predicate(filters) & masks[0]).groupBy(*keys).agg(F.min("occurred_at").alias("t"))
    out = now.groupBy("site_id").agg(F.count(F.lit(1)).alias("visitors")).withColumn("step", F.lit(0))
    entered = now.select("site_id").distinct()
    for i, mask in enumerate(masks[1:], 1):
        later = events.where(mask).select(*keys, "occurred_at").join(now, keys)
        later = later.where(f"occurred_at >= t AND occurred_at <= t + INTERVAL {funnel.window_seconds} SECONDS")
        now = later.groupBy(*keys).agg(F.min("occurred_at").alias("t"))
        count = entered.join(now.groupBy("site_id").agg(F.count(F.lit(1)).alias("visitors")), "site_id", "left").na.fill(0)
        out = out.unionByName(count.withColumn("step", F.lit(i)))
    return out.select("site_id", "step", "visitors")


def funnel_report(counts: DataFrame) -> DataFrame:
    """Conversion against entry, drop-off against the step before, and the overall rate."""
    w = Window.partitionBy("site_id").orderBy("step")
    rows = counts.withColumn("entry", F.first("visitors").over(w)).withColumn("before", F.lag("visitors").over(w))
    rows = rows.withColumn("dropped", F.coalesce(F.col("before") - F.col("visitors"), F.lit(0)))
    last = F.last("visitors").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(
        "site_id", "step", "visitors", percent(F.col("visitors"), F.col("entry")).alias("conversion"), "dropped",
        F.when(F.col("before").isNull(), 0.0).otherwise(percent(F.col("dropped"), F.col("before"))).alias("drop_off"),
        percent(last, F.col("entry")).alias("overall"),
    )


def all_counts(events: DataFrame, bounds: DataFrame, funnels: list[Funnel], pruned: tuple[datetime, datetime] | None = None, filters: dict | None = None) -> DataFrame:
    """site_id, funnel_id, step, visitors of many funnels in one scan and one shuffle of the events.

    Every step of every funnel has a bit in a mask (an array of longs, 32 steps each); an event tells the bits that it matches and
    whether it lies in its site's period. One fold over a visitor's instants carries the times that each funnel has reached: it
    enters a funnel at its first instant in the period, and goes on as `funnel_counts` does. pruned: times that hold all periods.
    """
    width = 32
    steps_of = [(f, i, any_of(list(s))) for f in funnels for i, s in enumerate(f.steps)]
    place = {(f.funnel_id, i): n for n, (f, i, _) in enumerate(steps_of)}
    if pruned:
        last = pruned[1] + timedelta(seconds=max((len(f.steps) - 1) * f.window_seconds for f in funnels))
        events = events.where((F.col("occurred_at") >= F.lit(pruned[0])) & (F.col("occurred_at") <= F.lit(last)))
        if "event_date" in events.columns:
            events = events.where((F.col("event_date") >= F.lit(pruned[0].date())) & (F.col("event_date") <= F.lit(last.date())))
    ranges = bounds.select("site_id", "from_ts", "to_ts")
    words = []
    for w in range(0, len(steps_of), width):
        bits = [F.when(m, F.lit(1 << (n - w)).cast("long")).otherwise(F.lit(0).cast("long")) for n, (_, _, m) in list(enumerate(steps_of))[w : w + width]]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    names = [f"w{i}" for i in range(len(words))]
    matched = events.drop("from_ts", "to_ts").join(ranges, "site_id").where(F.col("occurred_at") >= F.col("from_ts"))
    matched = matched.select("site_id", "visitor_hash", "occurred_at", (F.col("occurred_at") < F.col("to_ts")).alias("inside"), F.coalesce(predicate(filters), F.lit(False)).alias("own"), *[w.alias(n) for w, n in zip(words, names, strict=True)])
    any_bit = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    # an entry needs an event of the period that fulfils the filters, the later steps don't
    enters = [F.when(F.col("inside") & F.col("own"), F.col(n)).otherwise(F.lit(0).cast("long")).alias(f"e{n}") for n in names]
    hits = matched.where(any_bit).select("site_id", "visitor_hash", F.unix_micros("occurred_at").alias("t"), *names, *enters)
    instants = hits.groupBy("site_id", "visitor_hash", "t").agg(*[F.bit_or(n).alias(n) for n in (*names, *[f"e{n}" for n in names])])
    cells = F.struct("t", F.array(*names).alias("w"), F.array(*[f"e{n}" for n in names]).alias("e"))
    paths = instants.groupBy("site_id", "visitor_hash").agg(F.sort_array(F.collect_list(cells)).alias("path"))

    def has(mask: str, funnel: Funnel, step: int) -> str:
        n = place[funnel.funnel_id, step]
        return f"(x.{mask}[{n // width}] & {1 << (n % width)}L) > 0"

    def fold(f: Funnel) -> str:
        tests = " ".join(f"WHEN {i} THEN {has('w', f, i)}" for i in range(1, len(f.steps)))
        entered = f"CASE WHEN size(r) = 0 AND {has('e', f, 0)} THEN array(x.t) ELSE r END"
        went_on = f"""aggregate(sequence(1, {len(f.steps) - 1}), {entered}, (q, i) -> CASE WHEN size(q) = i AND i > 0 AND (CASE i {tests} END)
            AND x.t <= q[i - 1] + {f.window_seconds * 1_000_000}L THEN concat(q, array(x.t)) ELSE q END)"""
        return f"size(aggregate(path, cast(array() AS array<bigint>), (r, x) -> {went_on}))"

    reached = paths.select("site_id", *[F.expr(fold(f)).alias(f"r{n}") for n, f in enumerate(funnels)])
    sums = [F.count_if(F.col(f"r{n}") > i).alias(f"c{n}_{i}") for n, f in enumerate(funnels) for i in range(len(f.steps))]
    counted = reached.groupBy("site_id").agg(*sums)
    long = [F.struct(F.lit(f.funnel_id).alias("funnel_id"), F.lit(i).alias("step"), F.col(f"c{n}_{i}").alias("visitors")) for n, f in enumerate(funnels) for i in range(len(f.steps))]
    return counted.select("site_id", F.explode(F.array(*long)).alias("c")).select("site_id", "c.*")


def funnel_summaries_at_once(events: DataFrame, bounds: DataFrame, funnels: list[Funnel], pruned: tuple[datetime, datetime] | None = None) -> DataFrame:
    """`funnel_summaries` of the bounds' sites and periods, from one scan for all funnels."""
    good = [f for f in funnels if f.valid]
    cells = [F.struct(F.lit(f.funnel_id).alias("funnel_id"), F.lit(f.valid).alias("valid"), F.lit(f.exceeds_identity).alias("exceeds_identity"), F.lit(len(f.steps) - 1).alias("last"), F.lit(f.site_id).cast("long").alias("only")) for f in funnels]
    listed = bounds.select("site_id", F.explode(F.array(*cells)).alias("f")).select("site_id", "f.*").where("only IS NULL OR only = site_id")
    if not good:
        none = F.lit(None).cast("long")
        return listed.select("site_id", "funnel_id", "valid", "exceeds_identity", none.alias("entered"), none.alias("completed"), F.lit(None).cast("double").alias("rate"))
    ends = all_counts(events, bounds, good, pruned).join(listed.where("valid").select("site_id", "funnel_id", "last"), ["site_id", "funnel_id"])
    ends = ends.groupBy("site_id", "funnel_id").agg(F.max(F.when(F.col("step") == 0, F.col("visitors"))).alias("entered"), F.max(F.when(F.col("step") == F.col("last"), F.col("visitors"))).alias("completed"))
    out = listed.join(ends, ["site_id", "funnel_id"], "left")
    entered, completed = (F.when(F.col("valid"), F.coalesce(c, F.lit(0))) for c in ("entered", "completed"))
    out = out.withColumns({"entered": entered, "completed": completed})
    return out.select("site_id", "funnel_id", "valid", "exceeds_identity", "entered", "completed", F.when(F.col("valid"), percent(F.col("completed"), F.col("entered"))).alias("rate"))


def funnel_summaries(events: DataFrame, scope: DataFrame, sites: DataFrame, funnels: list[Funnel], period: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Every funnel of every site with its entry, completions and rate; null where it can't be reported. The plain form, funnel by funnel."""
    parts = []
    for f in funnels:
        listed = sites.where(F.col("site_id") == f.site_id) if f.site_id is not None else sites
        row = listed.select("site_id", F.lit(f.funnel_id).alias("funnel_id"), F.lit(f.valid).alias("valid"), F.lit(f.exceeds_identity).alias("exceeds_identity"))
        if f.valid:
            c = funnel_counts(events, scope, f, period=period).groupBy("site_id").agg(
                F.max(F.when(F.col("step") == 0, F.col("visitors"))).alias("entered"),
                F.max(F.when(F.col("step") == len(f.steps) - 1, F.col("visitors"))).alias("completed"),
            )
            row = row.join(c, "site_id", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("entered", "completed")})
            row = row.withColumn("rate", percent(F.col("completed"), F.col("entered")))
        else:
            row = row.withColumns({"entered": F.lit(None).cast("long"), "completed": F.lit(None).cast("long"), "rate": F.lit(None).cast("double")})
        parts.append(row)
    return reduce(DataFrame.unionByName, parts)


def steps(scope: DataFrame, include_events: bool = False, filters: dict | None = None) -> DataFrame:
    """Each session's steps in order: kind and value, consecutive repeats collapsed, with their place n.

    Both windows share one partitioning and order, so the session's events are shuffled and sorted once.
    """
    rows = qualified(scope, filters)
    page = F.col("event_name") == PAGEVIEW
    if not include_events:
        rows = rows.where(page)
    labelled = rows.select(
        "site_id", "k", "session_hash", "visitor_hash", "occurred_at",
        F.when(page, "pageview").otherwise("event").alias("kind"), F.when(page, F.col("path")).otherwise(F.col("event_name")).alias("value"),
    )
    w = Window.partitionBy("site_id", "session_hash").orderBy("occurred_at", F.col("kind").desc(), "value", "visitor_hash")
    before = labelled.withColumn("pk", F.lag("kind").over(w)).withColumn("pv", F.lag("value").over(w))
    changed = before.where(~(F.col("kind").eqNullSafe(F.col("pk")) & F.col("value").eqNullSafe(F.col("pv")))).drop("pk", "pv")
    return changed.withColumn("n", F.row_number().over(w))


def _is(step: tuple[str, str | Column], kind: Column, value: Column) -> Column:
    return F.coalesce((kind == step[0]) & (value == step[1]), F.lit(False))


def flow(step_rows: DataFrame, prefix: list[tuple[str, str]], direction: str = "forward", limit: int = 8) -> DataFrame:
    """Where sessions go after `prefix` (backward: where they came from), anchored at the first arrival
    at its start. A null kind is the end (or the start) of the session."""
    w = Window.partitionBy("site_id", "session_hash").orderBy("n")
    size = len(prefix)
    rows = step_rows
    for i in range(1, size + (direction == "forward")):
        rows = rows.withColumn(f"k{i}", F.lead("kind", i).over(w)).withColumn(f"v{i}", F.lead("value", i).over(w))
    if direction == "backward":
        rows = rows.withColumn("k0", F.lag("kind").over(w)).withColumn("v0", F.lag("value").over(w))
    start = rows.where(_is(prefix[0], F.col("kind"), F.col("value")))
    first = start.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    tests = [_is(prefix[i], F.col(f"k{i}"), F.col(f"v{i}")) for i in range(1, size)]
    matched = first.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    at = "0" if direction == "backward" else str(size)
    branches = matched.groupBy("site_id", "k", F.col(f"k{at}").alias("kind"), F.col(f"v{at}").alias("value")).agg(
        F.countDistinct("visitor_hash").alias("visitors"), F.count(F.lit(1)).alias("sessions")
    )
    total = matched.groupBy("site_id").agg(F.countDistinct("visitor_hash").alias("total"))
    branches = branches.join(total, "site_id")
    kept = top(branches, ["site_id"], limit, "sessions", ("value", "kind"))
    return kept.select(
        "site_id", "kind", "value", "visitors", "sessions", "total", percent(F.col("visitors"), F.col("total")).alias("percentage"),
        "rank", "withheld_rows", "withheld_visitors",
    )


def journey_starts(scope: DataFrame) -> DataFrame:
    """site_id and start: each site's first entry page by visitors, after suppression; where a journey begins that names no path."""
    return reports.panels(scope, ["entry_page"], None, 1).select("site_id", F.col("value").alias("start"))


def default_journey(scope: DataFrame, include_events: bool = False, limit: int = 8) -> DataFrame:
    """The first branches after every site's own first entry page."""
    rows = steps(scope, include_events).join(journey_starts(scope), "site_id")
    return flow(rows, [("pageview", F.col("start"))], "forward", limit).withColumn("level", F.lit(1))


def journey(step_rows: DataFrame, path: list[tuple[str, str]], limit: int = 8) -> DataFrame:
    """The branches after each prefix of a path, up to six levels deep, over one frame of steps."""
    levels = [flow(step_rows, path[:depth], "forward", limit).withColumn("level", F.lit(depth)) for depth in range(1, min(len(path), 6) + 1)]
    return reduce(DataFrame.unionByName, levels)
