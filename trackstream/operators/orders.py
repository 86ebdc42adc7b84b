"""Orders, items, deliveries and shifts: totals, nesting, durations and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream.functions import geo

PICKUP_TIMEOUT_MS = 600_000
#: Rows of a partition of a check of references, about.
PART_ROWS = 1_000_000
#: Time buckets in which intervals and events meet.
BUCKET_MS = 600_000


def order_totals(items: DataFrame) -> DataFrame:
    """Exact decimal totals by order."""
    line = F.col("unit_price").cast("decimal(12,2)") * F.col("quantity")
    return items.groupBy("order_id").agg(F.sum(line).cast("decimal(18,2)").alias("total"), F.count("*").alias("n_items"))


def with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with an array of their items, by line; empty where there are none."""
    item = F.struct("line", "quantity", "unit_price")
    lists = items.groupBy("order_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<struct<line:int,quantity:int,unit_price:decimal(12,2)>>")
    return orders.join(lists, orders["id"] == lists["order_id"], "left").drop("order_id").withColumn("items", F.coalesce("items", empty))


def total_mismatches(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored total is not the sum of their items."""
    return orders.join(order_totals(items), orders["id"] == F.col("order_id")).where("total_amount <> total").select("id", F.col("total_amount").alias("stored"), F.col("total").alias("recomputed"))


def by_status(rows: DataFrame, status: str | None = None) -> DataFrame:
    return rows.where(F.col("status") == status) if status else rows


def shift_hours(shifts: DataFrame, now_ms: int) -> DataFrame:
    """Time on shift by driver; an open shift runs until ``now_ms``."""
    return shifts.groupBy("driver_id").agg(F.sum(F.coalesce("ended_ms", F.lit(now_ms)) - F.col("started_ms")).alias("on_shift_ms"), F.count("*").alias("shifts"))


def route_lengths(deliveries: DataFrame) -> DataFrame:
    """Straight-line metres from pickup to dropoff, by driver."""
    m = geo.haversine_m(*[F.col(c) for c in ("pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon")])
    return deliveries.groupBy("driver_id").agg(geo.round2(F.avg(m)).alias("avg_m"), geo.round2(F.max(m)).alias("max_m"), F.count("*").alias("deliveries"))


def delivery_p95(deliveries: DataFrame) -> DataFrame:
    """Exact 95th percentile from assignment to delivery, by restaurant and hour."""
    done = deliveries.where("delivered_ms is not null")
    return done.groupBy("restaurant_id", geo.window_start(F.col("assigned_ms"), 3_600_000).alias("hour_ms")).agg(
        geo.round2(F.percentile(F.col("delivered_ms") - F.col("assigned_ms"), 0.95)).alias("p95_ms"), F.count("*").alias("deliveries")
    )


def completed_per_minute(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("delivered_ms is not null").groupBy(geo.window_start(F.col("delivered_ms"), 60_000).alias("minute_ms")).agg(F.count("*").alias("delivered"))


def pickup_to_delivered(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("delivered_ms is not null").select("order_id", (F.col("delivered_ms") - F.col("picked_up_ms")).alias("latency_ms"))


def pickup_timeouts(deliveries: DataFrame, timeout_ms: int = PICKUP_TIMEOUT_MS) -> DataFrame:
    """Alerts for orders that nobody picked up in time after a driver was assigned."""
    late = deliveries.where(F.col("picked_up_ms").isNull() | (F.col("picked_up_ms") - F.col("assigned_ms") > timeout_ms))
    at = F.col("assigned_ms") + timeout_ms
    return late.select(F.concat_ws(":", F.lit("ORDER_PICKUP_TIMEOUT"), F.col("order_id"), at).alias("alert_id"), "order_id", "driver_id", at.alias("event_ms"))


def within(spans: DataFrame, low: str, high: str, events: DataFrame, at: str, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Spans met with the events of equal ``keys`` at a time in [low, high], both ends included.

    Keys alone would pair all spans of a driver with all its events, so both sides meet by time bucket as well: a span is
    dealt to the buckets that it touches, an event to its own, hence every pair is made once. Columns other than ``keys``
    must differ. Spans with a null end meet nothing.
    """
    first, last = F.floor(F.col(low) / bucket_ms), F.floor(F.col(high) / bucket_ms)
    dealt = spans.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    near = events.withColumn("_bucket", F.floor(F.col(at) / bucket_ms))
    return dealt.join(near, [*keys, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def missed_fences(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Our reading of a missed geofence: picked up without entering a restaurant fence since assignment."""
    enters = events.where("transition = 'ENTER' and fence_type = 'RESTAURANT'").select("driver_id", F.col("event_ms").alias("enter_ms"))
    picked = deliveries.where("picked_up_ms is not null").select("id", "order_id", "driver_id", "assigned_ms", "picked_up_ms")
    seen = within(picked, "assigned_ms", "picked_up_ms", enters, "enter_ms", ["driver_id"]).select("id").distinct()
    return picked.join(seen, "id", "left_anti").select("order_id", "driver_id", F.col("picked_up_ms").alias("event_ms"))


def delivery_events(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Deliveries met with the fence events of their driver between assignment and delivery (interval join)."""
    spans = deliveries.select("order_id", "driver_id", "assigned_ms", F.coalesce("delivered_ms", F.col("picked_up_ms") + 3_600_000).alias("until_ms"))
    return within(spans, "assigned_ms", "until_ms", events.select("driver_id", "fence_id", "transition", "event_ms"), "event_ms", ["driver_id"]).select("order_id", "driver_id", "fence_id", "transition", "event_ms")


def gaps_on_delivery(deliveries: DataFrame, gaps: DataFrame) -> DataFrame:
    """(driver_id, event_ms) of gap alerts that fall between pickup and delivery."""
    spans = deliveries.select("driver_id", "picked_up_ms", F.coalesce("delivered_ms", F.col("picked_up_ms") + 3_600_000).alias("until_ms"))
    return within(spans, "picked_up_ms", "until_ms", gaps.select("driver_id", "event_ms"), "event_ms", ["driver_id"]).select("driver_id", "event_ms").distinct()


def rule_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null for a row is not broken. One pass for all rules."""
    checks = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(True)).alias("ok")) for name, ok in rules.items()])
    return rows.select(F.col(key).alias("key"), F.explode(checks).alias("c")).where("not c.ok").select("key", "c.rule")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; null keys may repeat."""
    present = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent.

    Keys compress so well that adaptive execution would put all of them into a few partitions, which grow with the tables.
    A big child therefore gets partitions by its number of rows, and its parent's keys the same, if they are not few.
    """
    rows, keys = child.where(F.col(child_key).isNotNull()), parent.select(F.col(parent_key).alias(child_key))
    parts = rows.count() // PART_ROWS
    if parts > 1 and keys.count() > 100 * parts:
        rows, keys = rows.repartition(parts, child_key), keys.repartition(parts, child_key)
    return rows.join(keys, child_key, "left_anti")
