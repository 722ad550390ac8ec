"""Payment webhooks from raw JSON: dispatch by type, and replay of failed deliveries in event order.

A delivery is applied once, however often it came. Those that were processed count in the order in which they were; failed
and unprocessed ones follow in a sweep, by the time of their event. A subscription's change that is older than one applied before
it is stale and stays unprocessed; a cash object is booked once per kind. So a replay that is repeated, or that dies and starts
again, comes to the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.operators.revenue import monthly_value

#: Event types by handler.
HANDLERS = {
    "customer.created": "customer", "customer.updated": "customer", "checkout.session.completed": "checkout", "invoice.paid": "invoice",
    "invoice.payment_failed": "noted", "charge.refunded": "refund", "charge.dispute.created": "dispute", "account.application.deauthorized": "deauthorized",
}
#: Outcomes after which a delivery stays unprocessed and is tried again.
FAILED = ("malformed", "no_customer", "stale")


def deliveries(raw: DataFrame) -> DataFrame:
    """site_id, event_id, event_type, occurred_at, object (variant), processed_at, n_deliveries: each event of a log (site_id, payload, received_at,
    processed_at) once; it is processed if one of its deliveries is. Payloads without an id are kept as malformed ones."""
    head = F.from_json("payload", "id string, type string, created long, data struct<object: string>")
    rows = raw.withColumn("e", head)
    event = F.coalesce("e.id", F.concat(F.lit("malformed_"), F.md5(F.coalesce("payload", F.lit("")).cast("binary"))))
    rows = rows.select("site_id", event.alias("event_id"), F.struct("received_at", F.col("e.type").alias("type"), F.col("e.created").alias("created"), F.col("e.data.object").alias("object")).alias("d"), "processed_at")
    # the first delivery counts; equal events meet map-side
    once = rows.groupBy("site_id", "event_id").agg(F.min("d").alias("d"), F.min("processed_at").alias("processed_at"), F.count("*").alias("n_deliveries"))
    return once.select(
        "site_id", "event_id", F.col("d.type").alias("event_type"), F.coalesce(F.timestamp_seconds("d.created"), F.col("d.received_at")).alias("occurred_at"),
        F.try_parse_json("d.object").alias("object"), "processed_at", "n_deliveries",
    )


def text_at(path: str) -> Column:
    return F.try_variant_get("object", path, "string")


def reference(field: str) -> Column:
    """An id that is given as such or as an object with an id; null for a blank one."""
    inside = F.try_variant_get("object", f"$.{field}.id", "string")
    kind = F.schema_of_variant(F.try_variant_get("object", f"$.{field}", "variant"))
    return F.nullif(F.coalesce(inside, F.when(kind == "STRING", text_at(f"$.{field}"))), F.lit(""))


def number_at(path: str) -> Column:
    return F.coalesce(F.try_variant_get("object", path, "bigint"), F.lit(0).cast("long"))


def subscription_of() -> Column:
    """The subscription of an invoice, which newer payloads hold under its parent; null for a one-time sale."""
    return F.coalesce(reference("subscription"), reference("parent.subscription_details.subscription"))


def items_of() -> Column:
    """A subscription's items as `monthly_value` takes them."""
    items = F.try_variant_get("object", "$.items.data", "array<struct<price struct<unit_amount bigint, recurring struct<interval string, interval_count bigint>>, quantity bigint>>")
    return F.transform(items, lambda x: F.struct(x["price"]["unit_amount"].alias("unit_amount"), x["quantity"].alias("quantity"), x["price"]["recurring"]["interval"].alias("interval"), x["price"]["recurring"]["interval_count"].alias("interval_count")))


def dispatched(log: DataFrame, sites: DataFrame) -> DataFrame:
    """log (of `deliveries`) with handler, processor_id, object_id, subscription_id, status, mrr_cents, kind, amount_cents, currency (the site's
    where none is given) and problem (malformed, no_customer, or null)."""
    known = F.create_map(*[F.lit(x) for pair in HANDLERS.items() for x in pair])
    handler = F.when(F.col("event_type").startswith("customer.subscription."), "subscription").otherwise(F.coalesce(F.try_element_at(known, F.col("event_type")), F.lit("ignored")))
    rows = log.join(sites.select("site_id", "base_currency"), "site_id", "left").withColumn("handler", handler)
    is_ = lambda *names: F.col("handler").isin(*names)
    customer = F.when(is_("customer"), F.nullif(text_at("$.id"), F.lit(""))).otherwise(reference("customer"))
    subscription = F.when(is_("subscription"), F.nullif(text_at("$.id"), F.lit(""))).when(is_("invoice"), subscription_of())
    amount = F.when(is_("invoice"), number_at("$.amount_paid")).when(is_("refund"), -F.abs(number_at("$.amount_refunded"))).when(is_("dispute"), -F.abs(number_at("$.amount")))
    rows = rows.withColumn("items", items_of()).withColumns({
        "processor_id": customer, "object_id": text_at("$.id"), "subscription_id": subscription, "status": F.when(is_("subscription"), text_at("$.status")),
        "mrr_cents": F.when(is_("subscription"), monthly_value("items")), "amount_cents": amount,
        "currency": F.coalesce(F.nullif(F.upper(text_at("$.currency")), F.lit("")), F.col("base_currency")),
    })
    kind = F.when(is_("invoice"), F.when(F.col("subscription_id").isNotNull(), "payment").otherwise("one_time")).when(is_("refund", "dispute"), F.col("handler"))
    needs = is_("customer", "checkout", "subscription", "invoice", "refund", "dispute")
    bad = F.col("event_type").isNull() | F.col("object").isNull() | (is_("subscription") & F.col("subscription_id").isNull()) | (F.col("amount_cents").isNotNull() & F.col("object_id").isNull())
    problem = F.when(~is_("ignored") & bad | F.col("event_type").isNull(), "malformed").when(needs & F.col("processor_id").isNull(), "no_customer")
    return rows.withColumns({"kind": kind, "problem": problem}).drop("object", "items", "base_currency")


def replayed(rows: DataFrame) -> DataFrame:
    """dispatched rows with outcome: applied, stale, duplicate, zero, noted, ignored, malformed, no_customer; and attempted: whether the sweep took it.

    A subscription, or a cash object, is the unit whose deliveries are put in order."""
    sweep = F.col("processed_at").isNull()
    unit = F.coalesce(F.when(F.col("handler") == "subscription", F.col("subscription_id")), F.when(F.col("kind").isNotNull(), F.concat_ws(":", "kind", "object_id")), F.col("event_id"))
    order = [sweep.asc(), F.col("processed_at").asc(), F.col("occurred_at").asc(), F.col("event_id").asc()]
    w = Window.partitionBy("site_id", "handler", "unit").orderBy(*order)
    counts = F.col("problem").isNull() & ((F.col("handler") == "subscription") | F.coalesce(F.col("amount_cents") != 0, F.lit(False)))
    marked = rows.withColumn("unit", unit).withColumn("_at", F.when(counts, F.col("occurred_at")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_latest", F.max("_at").over(before))
    outcome = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("handler").isin("noted", "ignored"), F.col("handler"))
        .when((F.col("handler") == "subscription") & F.coalesce(F.col("occurred_at") < F.col("_latest"), F.lit(False)), "stale")
        .when(F.col("kind").isNotNull() & (F.col("amount_cents") == 0), "zero")
        .when(F.col("kind").isNotNull() & F.col("_latest").isNotNull(), "duplicate").otherwise("applied")
    )
    return marked.select(*rows.columns, sweep.alias("attempted"), outcome.alias("outcome"))


def changes(rows: DataFrame) -> DataFrame:
    """The applied subscription changes of replayed rows, as `revenue.movements` takes them (customer_id: the processor's)."""
    out = rows.where("handler = 'subscription' AND outcome = 'applied'")
    return out.select("site_id", F.col("processor_id").alias("customer_id"), "subscription_id", "event_id", F.col("occurred_at").alias("event_at"), "status", "mrr_cents", "currency")


def cash(rows: DataFrame) -> DataFrame:
    """The booked payments, sales, refunds and disputes of replayed rows."""
    return rows.where("kind IS NOT NULL AND outcome = 'applied'").select("site_id", F.col("processor_id").alias("customer_id"), "kind", "amount_cents", "currency", "object_id", "occurred_at")


def sweep_report(rows: DataFrame) -> DataFrame:
    """site_id, attempted, applied (which are processed now), left (tried again with the next sweep)."""
    tried = rows.where("attempted")
    return tried.groupBy("site_id").agg(F.count("*").alias("attempted"), F.count_if(~F.col("outcome").isin(*FAILED)).alias("applied"), F.count_if(F.col("outcome").isin(*FAILED)).alias("left"))
