"""Revenue: monthly values, movements of subscriptions, cash, customers, and attribution to channels."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions import hosts
from quietcount.functions.period import within
from quietcount.sources.snapshots import DAY, Snapshots

#: Subscription states and kinds of revenue events.
LIVE, PAYING = ("trialing", "active", "past_due"), ("active", "past_due")
NEW, EXPANSION, CONTRACTION, CHURN, REACTIVATION = "new", "expansion", "contraction", "churn", "reactivation"
MRR_KINDS = (NEW, EXPANSION, CONTRACTION, CHURN, REACTIVATION)
CASH_KINDS = ("payment", "one_time", "refund", "dispute")
DIRECT, NONE, PRE_INSTALL = "Direct", "(none)", "(pre-install)"
CHANNEL = ["source", "medium", "campaign"]


def monthly_value(items: str) -> Column:
    """Sum over an array of struct(unit_amount, quantity, interval, interval_count), floored per item to a month."""
    per = "coalesce(x.unit_amount, 0) * coalesce(x.quantity, 1)"
    count = "greatest(coalesce(x.interval_count, 1), 1)"
    value = f"""CASE x.interval WHEN 'month' THEN floor({per} / {count}) WHEN 'year' THEN floor({per} / (12 * {count}))
        WHEN 'week' THEN floor({per} * 52 / (12 * {count})) WHEN 'day' THEN floor({per} * 365 / (12 * {count})) ELSE 0 END"""
    return F.expr(f"coalesce(aggregate({items}, 0L, (a, x) -> a + cast({value} AS bigint)), 0L)")


def change_log(changes: DataFrame) -> DataFrame:
    """Changes without repeats of an event and in event-time order per subscription: a change that
    arrives after a later one of its subscription is stale and dropped (arrival is `received_at`)."""
    once = changes.dropDuplicates(["site_id", "event_id"])
    seen = Window.partitionBy("site_id", "subscription_id").orderBy("received_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("event_at").over(seen)
    return once.withColumn("_latest", latest).where(F.col("_latest").isNull() | (F.col("event_at") >= F.col("_latest"))).drop("_latest")


def movements(log: DataFrame) -> DataFrame:
    """The revenue event of each change, if it makes one: kind, amount, mrr_delta.

    log has site_id, customer_id, subscription_id, event_id, event_at, status, mrr_cents, currency.
    """
    w = Window.partitionBy("site_id", "subscription_id").orderBy("event_at", "event_id")
    counted = F.when(F.col("status").isin(*PAYING), F.col("mrr_cents")).otherwise(0)
    live = F.col("status").isin(*LIVE)
    rows = log.withColumn("_now", counted).withColumn("_before", F.coalesce(F.lag(counted).over(w), F.lit(0)))
    rows = rows.withColumn("_was_live", F.coalesce(F.lag(live).over(w), F.lit(False))).withColumn("_delta", F.col("_now") - F.col("_before"))
    churned = F.col("_was_live") & ~live
    starts = ~churned & (F.col("_delta") != 0) & (F.col("_before") == 0)
    # a customer's first start converts; any later one is a reactivation
    c = Window.partitionBy("site_id", "customer_id").orderBy("event_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_starts", starts).withColumn("_converted", F.coalesce(F.max(F.col("_starts")).over(c), F.lit(False)))
    kind = (
        F.when(churned, CHURN).when(F.col("_delta") == 0, None)
        .when(F.col("_before") == 0, F.when(F.col("_converted"), REACTIVATION).otherwise(NEW))
        .when(F.col("_delta") > 0, EXPANSION).otherwise(CONTRACTION)
    )
    amount = F.when(F.col("kind") == CHURN, -F.abs("mrr_cents")).otherwise(F.col("_delta"))
    made = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("amount_cents", amount)
    made = made.withColumn("object_id", F.concat_ws(":", "subscription_id", F.unix_timestamp("event_at")))
    # of one kind within a second, the first counts
    once = Window.partitionBy("site_id", "object_id", "kind").orderBy("event_at", "event_id")
    return made.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(
        "site_id", "customer_id", "kind", "amount_cents", "currency", F.col("amount_cents").alias("mrr_delta_cents"),
        "object_id", F.col("event_at").alias("occurred_at"),
    )


def cash_events(invoices: DataFrame) -> DataFrame:
    """Payments, one-time sales, refunds and disputes; nothing for zero amounts.

    invoices has site_id, customer_id, object_id, type (invoice, refund, dispute), subscription_id, amount_cents, currency, occurred_at.
    """
    kind = F.when(F.col("type") == "invoice", F.when(F.col("subscription_id").isNotNull(), "payment").otherwise("one_time")).otherwise(F.col("type"))
    amount = F.when(F.col("type") == "invoice", F.col("amount_cents")).otherwise(-F.abs("amount_cents"))
    rows = invoices.withColumn("kind", kind).withColumn("amount_cents", amount).where("amount_cents <> 0")
    return rows.select(
        "site_id", "customer_id", "kind", "amount_cents", "currency", F.lit(0).cast("long").alias("mrr_delta_cents"), "object_id", "occurred_at"
    ).dropDuplicates(["site_id", "object_id", "kind"])


def normalised(revenue: DataFrame, sites: DataFrame) -> DataFrame:
    """revenue with normalized_cents: the amount where its currency is the site's base currency, else null."""
    rows = revenue.join(sites.select("site_id", "base_currency"), "site_id")
    return rows.withColumn("normalized_cents", F.when(F.col("currency") == F.col("base_currency"), F.col("amount_cents"))).drop("base_currency")


def resolved_source(source: str = "attribution_source", referrer: str = "referrer_host") -> Column:
    """The source that a customer is stored with: a mark as it is, else the source, else the referrer, both by the list that events are read with."""
    given = F.nullif(F.trim(source), F.lit(""))
    return F.when(given.isin(DIRECT, NONE, PRE_INSTALL), given).otherwise(F.coalesce(hosts.classified(source), hosts.classified(referrer)))


#: First-touch fields that calls may carry.
TOUCH = ["attribution_content", "attribution_term", "landing_path", "referrer_host"]


def identified(calls: DataFrame) -> DataFrame:
    """Customers from identify calls: every field keeps its first value that isn't blank (a pre-install mark gives
    way to a later one); first_seen_at is the earliest. calls are ordered by seq; those of TOUCH that they have are kept too."""
    touch = [c for c in TOUCH if c in calls.columns]
    if "referrer_host" in touch:
        calls = calls.withColumn("attribution_source", resolved_source())
    fields = ["external_id", "processor_id", "attribution_source", "attribution_medium", "attribution_campaign", *touch]

    def first(c: str) -> Column:
        usable = F.trim(c) != ""
        real = F.min_by(c, F.when(usable & (F.col(c) != PRE_INSTALL), F.col("seq")))
        return F.coalesce(real, F.when(F.max(F.when(F.col(c) == PRE_INSTALL, 1)) == 1, PRE_INSTALL)).alias(c)

    email = F.when(F.trim("email") != "", F.sha2(F.lower(F.trim("email")), 256))
    rows = calls.withColumn("_email", email)
    return rows.groupBy("site_id", "customer_id").agg(
        *[first(c) for c in fields], F.min_by("_email", F.when(F.col("_email").isNotNull(), F.col("seq"))).alias("email_hash"), F.min("seen_at").alias("first_seen_at")
    )


def matched(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """rows with the customer_id of their external id, else processor id, else an e-mail hash that only one customer has."""
    sides = []
    for column in ("external_id", "processor_id", "email_hash"):
        side = customers.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("site_id", column)
        side = side.agg(F.min("customer_id").alias(f"_{column}"), F.count(F.lit(1)).alias("_n"))
        sides.append((column, side.where("_n = 1").drop("_n") if column == "email_hash" else side.drop("_n")))
    for column, side in sides:
        rows = rows.join(side, ["site_id", column], "left")
    return rows.withColumn("customer_id", F.coalesce("_external_id", "_processor_id", "_email_hash")).drop("_external_id", "_processor_id", "_email_hash")


def checkout_attribution(metadata: str = "metadata", prefix: str = "tst_") -> list[Column]:
    """Attribution fields that a checkout's metadata map carries, cut to 500 characters; blanks are null."""
    names = ("external_id", "source", "medium", "campaign", "content", "term", "landing_path", "referrer_host")
    fields = [F.expr(f"nullif(left({metadata}['{prefix}{n}'], 500), '')").alias(n) for n in names]
    return [*fields, F.expr(f"try_to_timestamp({metadata}['{prefix}first_seen_at'])").alias("first_seen_at")]


def recalculated(customers: DataFrame, subscriptions: DataFrame, revenue: DataFrame) -> DataFrame:
    """Each customer's current MRR, lifetime revenue, converted_at and churned_at.

    subscriptions hold the last state of each: site_id, customer_id, status, mrr_cents, canceled_at.
    """
    keys = ["site_id", "customer_id"]
    subs = subscriptions.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("status").isin(*PAYING), F.col("mrr_cents"))), F.lit(0)).alias("current_mrr_cents"),
        F.max(F.col("status").isin(*LIVE)).alias("_live"), F.max("canceled_at").alias("_canceled"),
    )
    money = revenue.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("kind").isin(*CASH_KINDS), F.col("amount_cents"))), F.lit(0)).alias("lifetime_revenue_cents"),
        F.min(F.when(F.col("kind").isin(NEW, REACTIVATION), F.col("occurred_at"))).alias("converted_at"),
        F.max(F.when(F.col("kind") == CHURN, F.col("occurred_at"))).alias("_churned"),
    )
    out = customers.join(subs, keys, "left").join(money, keys, "left").na.fill(0, ["current_mrr_cents", "lifetime_revenue_cents"])
    out = out.withColumn("churned_at", F.when(~F.coalesce("_live", F.lit(False)), F.coalesce("_canceled", "_churned")))
    return out.drop("_live", "_canceled", "_churned")


def event_channel() -> list[Column]:
    def filled(*columns: str, default: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(default))

    return [
        filled("utm_source", "referrer_source", default=DIRECT).alias("source"),
        filled("utm_medium", default=NONE).alias("medium"),
        filled("utm_campaign", default=NONE).alias("campaign"),
    ]


def customer_channel() -> list[Column]:
    defaults = {"source": DIRECT, "medium": NONE, "campaign": NONE}
    return [F.coalesce(F.nullif(F.col(f"attribution_{c}"), F.lit("")), F.lit(d)).alias(c) for c, d in defaults.items()]


def local_day(column: str) -> Column:
    return F.expr(f"to_date(from_utc_timestamp({column}, timezone))")


def attribution_rollup(
    events: DataFrame, customers: DataFrame, subscriptions: DataFrame, revenue: DataFrame, sites: DataFrame, compat: bool = False,
    start: date | None = None, end: date | None = None,
) -> DataFrame:
    """One row per site, site-local day and channel with traffic, sign-ups, trials, conversions and revenue.

    The whole range is one job. A row appears where there was traffic, a sign-up, a trial, a conversion or money.
    Of site-local days [start, end) where given: times a day around them reach the scans, as no zone is further off.
    compat counts sign-ups and conversions once per subscription of the customer, as the original does.
    """
    zones = sites.select("site_id", "timezone")
    low, high = [d and datetime.combine(d + timedelta(days=n), time()) for d, n in ((start, -1), (end, 1))]

    def inside(rows: DataFrame) -> DataFrame:
        rows = rows if start is None else rows.where(F.col("date") >= F.lit(start))
        return rows if end is None else rows.where(F.col("date") < F.lit(end))

    events, revenue = within(events, low, high), within(revenue, low, high)
    keys = ["site_id", "date", *CHANNEL]
    traffic = events.join(zones, "site_id").select("site_id", local_day("occurred_at").alias("date"), *event_channel(), "visitor_hash")
    traffic = inside(traffic).groupBy(*keys).agg(F.countDistinct("visitor_hash").alias("visitors"))
    who = customers.join(zones, "site_id").select("site_id", "customer_id", "timezone", *customer_channel(), "identified_at", "converted_at", "lifetime_revenue_cents")
    per = ["site_id", "customer_id"]
    count = subscriptions.groupBy(*per).agg(F.count(F.lit(1)).alias("times"))
    weighed = who.join(count, per, "left") if compat else who
    times = F.coalesce("times", F.lit(1)) if compat else F.lit(1)
    marks = weighed.select("site_id", *CHANNEL, "timezone", F.explode(F.array(
        F.struct(F.lit("signup").alias("what"), F.col("identified_at").alias("at"), times.alias("n")),
        F.struct(F.lit("conversion").alias("what"), F.col("converted_at").alias("at"), times.alias("n")),
    )).alias("m")).select("site_id", *CHANNEL, "timezone", "m.what", F.col("m.at").alias("at"), "m.n")
    trials = subscriptions.where("status = 'trialing'").join(who.select(*per, *CHANNEL, "timezone"), per)
    marks = marks.unionByName(trials.select("site_id", *CHANNEL, "timezone", F.lit("trial").alias("what"), F.col("created_at").alias("at"), F.lit(1).alias("n")))
    marks = inside(marks.where("at IS NOT NULL").withColumn("date", local_day("at")))
    funnel = marks.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(f"{w}s") for w in ("signup", "trial", "conversion")])
    paid = revenue.join(who.select(*per, *CHANNEL, "timezone"), per).withColumn("date", local_day("occurred_at"))
    money = inside(paid).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("normalized_cents"))), F.lit(0)).alias(f"_{k}") for k in MRR_KINDS],
        F.count_if(F.col("normalized_cents").isNull()).alias("unconverted_events"),
    )
    lifetime = who.groupBy("site_id", *CHANNEL).agg(F.sum("lifetime_revenue_cents").alias("lifetime_revenue_cents"))
    out = traffic.join(funnel, keys, "full").join(money, keys, "full").join(lifetime, ["site_id", *CHANNEL], "left").na.fill(0)
    net = F.col(f"_{NEW}") + F.col(f"_{EXPANSION}") + F.col(f"_{CONTRACTION}") + F.col(f"_{CHURN}") + F.col(f"_{REACTIVATION}")
    return out.select(
        *keys, "visitors", "signups", "trials", "conversions",
        F.col(f"_{NEW}").alias("new_mrr_cents"), F.col(f"_{EXPANSION}").alias("expansion_mrr_cents"), F.col(f"_{CONTRACTION}").alias("contraction_mrr_cents"),
        F.abs(f"_{CHURN}").alias("churned_mrr_cents"), net.alias("net_mrr_cents"), "lifetime_revenue_cents", "unconverted_events",
    )


LOOKBACK_DAYS = 3
#: The rollup's table in a store.
ATTRIBUTION = "attribution"


def sliding_days(sites: DataFrame, now: datetime) -> tuple[date, date]:
    """[first, last) local days that a nightly run makes anew: the LOOKBACK_DAYS before today and today, over all sites' zones."""
    today = F.to_date(F.from_utc_timestamp(F.lit(now), F.col("timezone")))
    first, last = sites.agg(F.min(today), F.max(today)).first()
    return first - timedelta(days=LOOKBACK_DAYS), last + timedelta(days=1)


def write_rollup(store: Snapshots, rollup: DataFrame, start: date | None = None, end: date | None = None) -> int:
    """Puts a rollup of local days [start, end) in the place of what the store holds of these days, in one swap; returns the version.

    A run over the days of sliding_days takes in facts that came late. Days are made whole, so repeating one changes nothing, and a day
    whose events were deleted since is gone."""
    change = store.change()
    held = change.tables.get(ATTRIBUTION, {"days": {}})["days"]
    days = [d for d in held if (start is None or d >= str(start)) and (end is None or d < str(end))]
    rows = rollup.withColumnRenamed("date", DAY)
    change.replace(ATTRIBUTION, rows.repartition(DAY, F.pmod(F.xxhash64("site_id", *CHANNEL), F.lit(4))), days)
    return change.commit()


def read_rollup(store: Snapshots, start: date | None = None, end: date | None = None) -> DataFrame:
    """The stored rollup of local days [start, end); folders of other days aren't opened."""
    held = store.current()[1]["tables"][ATTRIBUTION]["days"]
    days = [d for d in held if (start is None or d >= str(start)) and (end is None or d < str(end))]
    return store.read(ATTRIBUTION, days).withColumnRenamed(DAY, "date")


SORTS = {"revenue": "net_mrr_cents", "lifetime": "lifetime_revenue_cents", "visitors": "visitors", "conversions": "conversions"}
SUMMED = ["visitors", "signups", "trials", "conversions", "new_mrr_cents", "expansion_mrr_cents", "contraction_mrr_cents", "churned_mrr_cents", "net_mrr_cents", "unconverted_events"]


def attribution_report(rollup: DataFrame, start: str, end: str, sort: str = "revenue", limit: int = 100) -> DataFrame:
    """Channels of each site over local dates [start, end): sums, the latest day's lifetime revenue, rates, totals, rank. rollup is read twice, so it is a stored one."""
    rows = rollup.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    channels = rows.groupBy("site_id", *CHANNEL).agg(*[F.sum(c).alias(c) for c in SUMMED], F.max_by("lifetime_revenue_cents", "date").alias("lifetime_revenue_cents"))
    label = F.concat_ws(" / ", "source", *[F.when(F.col(c) != NONE, F.col(c)) for c in ("medium", "campaign")])
    order = Window.partitionBy("site_id").orderBy(F.col(SORTS.get(sort, SORTS["revenue"])).desc(), "channel", "source", "medium", "campaign")
    # one row more than asked for tells whether the list was cut: each task keeps its own first rows, no window holds a site's channels
    first = channels.withColumn("channel", label).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    totals = rows.groupBy("site_id").agg(F.sum("visitors").alias("total_visitors"), F.sum("net_mrr_cents").alias("total_net_mrr_cents"))
    out = first.withColumn("truncated", F.max("rank").over(Window.partitionBy("site_id")) > limit).where(F.col("rank") <= limit).join(totals, "site_id")
    out = out.withColumn("conversion_rate", F.when(F.col("visitors") > 0, F.round(F.col("conversions") / F.col("visitors"), 6)))
    return out.withColumn("value_per_visitor_cents", F.when(F.col("visitors") > 0, F.floor(F.col("lifetime_revenue_cents") / F.col("visitors"))))


def customer_ranking(customers: DataFrame, search: str | None = None, paying_only: bool = False, page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of each site's customers by MRR, lifetime revenue and id; search is part of an id or a whole e-mail address."""
    rows = customers.where("current_mrr_cents > 0") if paying_only else customers
    if search:
        part = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        rows = rows.where(F.col("external_id").ilike(part) | F.col("processor_id").ilike(part) | (F.col("email_hash") == F.sha2(F.lower(F.trim(F.lit(search))), 256)))
    order = Window.partitionBy("site_id").orderBy(F.col("current_mrr_cents").desc(), F.col("lifetime_revenue_cents").desc(), "customer_id")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > (page - 1) * per_page) & (F.col("rank") <= page * per_page))
