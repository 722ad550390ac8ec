"""Historic import of a connected payment account: its lists of customers, subscriptions and invoices as raw JSON objects.

A list has site_id and payload. Rows whose payload can't be read, and rows of sites whose connection is revoked, are left out.
Everything is matched to what is known, so an import that is repeated, or that overlaps live webhooks, comes to the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.operators.revenue import CHANNEL, PRE_INSTALL, TOUCH, checkout_attribution, monthly_value, resolved_source
from quietcount.operators.webhooks import items_of, number_at, reference, subscription_of, text_at

#: Write-once fields of a customer's attribution.
FIELDS = [*[f"attribution_{c}" for c in CHANNEL], *TOUCH]


def objects(listed: DataFrame, connections: DataFrame) -> DataFrame:
    """site_id, object (variant), object_id: the readable objects of a list, each id once, of sites whose connection isn't revoked."""
    live = connections.where("revoked_at IS NULL").select("site_id")
    rows = listed.join(live, "site_id").select("site_id", F.try_parse_json("payload").alias("object"), "payload")
    rows = rows.withColumn("object_id", F.nullif(text_at("$.id"), F.lit(""))).where("object_id IS NOT NULL")
    # an object that a page boundary repeats counts once; equal ones meet map-side
    once = rows.groupBy("site_id", "object_id").agg(F.min("payload").alias("payload"))
    return once.select("site_id", "object_id", F.try_parse_json("payload").alias("object"))


def at(path: str) -> Column:
    return F.timestamp_seconds(F.try_variant_get("object", path, "bigint"))


def matched_customers(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed customers (site_id, processor_id, email_hash, created_at, ...) with the customer_id (string) that each comes to.

    The processor's id counts first, then an e-mail hash that one known customer has. Of the rest, those that share a hash
    that no known customer has are one customer, made by the first of them; any other makes one of its own. A made customer's id
    is the processor's id of the row that makes it, so a repeat makes the same one.
    """
    ids = known.where("processor_id <> ''").groupBy("site_id", "processor_id").agg(F.min("customer_id").alias("_by_id"))
    mails = known.where("email_hash <> ''").groupBy("site_id", "email_hash").agg(F.min("customer_id").alias("_by_mail"), F.count("*").alias("_n"))
    rows = listed.join(ids, ["site_id", "processor_id"], "left").join(mails, ["site_id", "email_hash"], "left")
    fresh = F.col("_by_id").isNull() & F.col("_n").isNull() & F.col("email_hash").isNotNull()
    makers = rows.where(fresh).groupBy("site_id", "email_hash").agg(F.min_by("processor_id", F.struct("created_at", "processor_id")).alias("_maker"))
    rows = rows.join(makers, ["site_id", "email_hash"], "left")
    own = F.coalesce(F.when(fresh, F.col("_maker")), F.col("processor_id"))
    return rows.withColumn("customer_id", F.coalesce("_by_id", F.when(F.col("_n") == 1, F.col("_by_mail")), own)).drop("_by_id", "_by_mail", "_n", "_maker")


def customers(listed: DataFrame, known: DataFrame, connections: DataFrame, since: datetime, now: datetime) -> DataFrame:
    """The customers after the import: known ones and those that the list makes.

    known has site_id, customer_id (string), external_id, processor_id, email_hash, first_seen_at, identified_at and FIELDS. Attribution is
    what the metadata carries; a customer without any is marked as of before the installation, which gives way to a real value
    once. Fields keep their first value, so a repeat or a later import undoes nothing. A customer that is found by e-mail takes the
    processor's id if it has none, so that its subscriptions and invoices are found.
    """
    rows = objects(listed, connections).withColumn("created_at", at("$.created")).where(F.col("created_at") >= F.lit(since))
    metadata = F.try_variant_get("object", "$.metadata", "map<string,string>")
    rows = rows.withColumn("metadata", metadata).select("site_id", F.col("object_id").alias("processor_id"), "created_at", _mail("$.email").alias("email_hash"), F.struct(*checkout_attribution()).alias("a"))
    told = F.coalesce(*[F.col(f"a.{f}").cast("string") for f in ("source", "medium", "campaign", "content", "term", "landing_path", "referrer_host", "first_seen_at")]).isNotNull()
    flat = {f: F.col(f"a.{f.removeprefix('attribution_')}") for f in FIELDS}
    rows = matched_customers(rows.withColumns(flat).withColumn("told", told), known)
    rows = rows.withColumn("attribution_source", F.when(F.col("told"), resolved_source()).otherwise(PRE_INSTALL))
    made = F.col("customer_id") == F.col("processor_id")
    calls = rows.select(
        "site_id", "customer_id", F.lit(None).cast("string").alias("external_id"), "processor_id", F.when(made, F.col("email_hash")).alias("email_hash"), *FIELDS,
        F.when(made, F.least("created_at", "a.first_seen_at")).otherwise(F.col("a.first_seen_at")).alias("first_seen_at"), F.lit(now).alias("identified_at"), F.struct(F.lit(1).alias("turn"), F.col("created_at").alias("at"), F.col("processor_id").alias("id")).alias("seq"),
    )
    before = known.select("site_id", "customer_id", "external_id", "processor_id", "email_hash", *FIELDS, "first_seen_at", "identified_at", F.struct(F.lit(0).alias("turn"), F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("id")).alias("seq"))

    def first(c: str) -> Column:
        usable = F.trim(c) != ""
        real = F.min_by(c, F.when(usable & (F.col(c) != PRE_INSTALL), F.col("seq")))
        return F.coalesce(real, F.max(F.when(F.col(c) == PRE_INSTALL, F.col(c)))).alias(c)

    both = before.unionByName(calls).groupBy("site_id", "customer_id")
    return both.agg(*[first(c) for c in ("external_id", "processor_id", "email_hash", *FIELDS)], F.min("first_seen_at").alias("first_seen_at"), F.min_by("identified_at", F.when(F.col("identified_at").isNotNull(), F.col("seq"))).alias("identified_at"))


def _mail(path: str) -> Column:
    """The hash of an e-mail address; null for a blank one."""
    mail = F.lower(F.trim(text_at(path)))
    return F.when(mail != "", F.sha2(mail, 256))


def _owned(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows of customers that are known by the processor's id; others are orphans and left out."""
    ids = held.where("processor_id <> ''").groupBy("site_id", "processor_id").agg(F.min("customer_id").alias("customer_id"))
    return rows.withColumn("processor_id", reference("customer")).join(ids, ["site_id", "processor_id"])


def _currency() -> Column:
    return F.coalesce(F.nullif(F.upper(text_at("$.currency")), F.lit("")), F.col("base_currency")).alias("currency")


def subscription_changes(listed: DataFrame, held: DataFrame, connections: DataFrame, sites: DataFrame, now: datetime) -> DataFrame:
    """Listed subscriptions, ended ones too, as rows of the change log that arrive now and are dated by their own history: the end, else
    the start, else the making. `held` are the customers after the import. A change that is older than one known is stale there."""
    rows = _owned(objects(listed, connections), held).join(sites.select("site_id", "base_currency"), "site_id")
    event_at = F.coalesce(at("$.canceled_at"), at("$.start_date"), at("$.created"), F.lit(now))
    rows = rows.withColumns({"items": items_of(), "event_at": event_at})
    return rows.select(
        "site_id", "customer_id", F.col("object_id").alias("subscription_id"), F.concat_ws("_", F.lit("backfill"), "object_id", F.unix_timestamp("event_at")).alias("event_id"), "event_at",
        F.lit(now).alias("received_at"), text_at("$.status").alias("status"), monthly_value("items").alias("mrr_cents"), _currency(), at("$.canceled_at").alias("canceled_at"),
    )


def invoices(listed: DataFrame, held: DataFrame, connections: DataFrame, sites: DataFrame, since: datetime) -> DataFrame:
    """Paid invoices since a time as `revenue.cash_events` takes them; they are dated by their payment, else by their making."""
    rows = objects(listed, connections).where((text_at("$.status") == "paid") & (at("$.created") >= F.lit(since)))
    rows = _owned(rows, held).join(sites.select("site_id", "base_currency"), "site_id")
    return rows.select(
        "site_id", "customer_id", "object_id", F.lit("invoice").alias("type"), subscription_of().alias("subscription_id"), number_at("$.amount_paid").alias("amount_cents"), _currency(),
        F.coalesce(at("$.status_transitions.paid_at"), at("$.created")).alias("occurred_at"),
    )


def merged_cash(known: DataFrame, imported: DataFrame) -> DataFrame:
    """known revenue events and those imported ones whose object and kind aren't booked yet."""
    keys = ["site_id", "object_id", "kind"]
    return known.unionByName(imported.join(known.select(*keys).distinct(), keys, "left_anti"))


def merged_changes(known: DataFrame, imported: DataFrame) -> DataFrame:
    """The change log with the imported changes behind what arrived before; stale ones are left out. An imported change is compared with
    the last known one of its subscription, found by an aggregate rather than by a window over the log."""
    last = known.groupBy("site_id", "subscription_id").agg(F.max("event_at").alias("_last"))
    new = imported.join(last, ["site_id", "subscription_id"], "left").where("_last IS NULL OR event_at >= _last")
    new = new.join(known.select("site_id", "event_id").distinct(), ["site_id", "event_id"], "left_anti")
    return known.unionByName(new.select(*known.columns))


def report(connections: DataFrame, counts: dict[str, DataFrame], now: datetime) -> DataFrame:
    """site_id, the number of rows of each list that were taken, and backfilled_at; revoked connections are refused."""
    parts = [rows.groupBy("site_id").agg(F.count("*").alias("n")).select("site_id", F.lit(name).alias("list"), "n") for name, rows in counts.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    per = rows.groupBy("site_id").agg(*[F.coalesce(F.sum(F.when(F.col("list") == name, F.col("n"))), F.lit(0)).alias(name) for name in counts])
    live = F.col("revoked_at").isNull()
    out = connections.select("site_id", (~live).alias("refused"), F.when(live, F.lit(now)).alias("backfilled_at")).join(per, "site_id", "left")
    return out.na.fill(0, list(counts))
