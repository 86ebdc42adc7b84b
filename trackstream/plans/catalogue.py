"""Registered fleet queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackstream import schemas
from trackstream.functions.geo import round2
from trackstream.operators import cdc, geofence, ingest, motion, orders, quantiles, serving, sinks
from trackstream.operators.manifests import FactTable, KeyedTable
from trackstream.plans.oracle import SQL
from trackstream.sources import tables as t
from trackstream.sources import topics
from trackstream.streaming import twins

Query = Callable[[SparkSession, str], DataFrame]


def gated(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gate(ingest.decode(t.location_messages(spark, d)))


def valid(spark: SparkSession, d: str) -> DataFrame:
    return ingest.valid(gated(spark, d))


def fence_events(spark: SparkSession, d: str) -> DataFrame:
    return geofence.transitions(valid(spark, d), t.fences(spark))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """The fence event log as a replacing table holds it: every third event was written again later."""
    e = fence_events(spark, d)
    first = e.withColumn("ingested_at", F.col("event_ms") + 1_000)
    again = e.where("event_ms % 3 = 0").withColumn("ingested_at", F.col("event_ms") + 60_000)
    return first.unionByName(again)


def normalised(spark: SparkSession, d: str) -> DataFrame:
    return cdc.normalise(t.order_messages(spark, d))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return cdc.changes(normalised(spark, d))


def narrow(spark: SparkSession, d: str, before: list[str], after: list[str]) -> DataFrame:
    """Normalised messages of which only some columns of the images are parsed."""
    return cdc.normalise(t.order_messages(spark, d), schemas.envelope(before, after))


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as customer_id", "o_orderstatus as status", "cast(o_totalprice as decimal(12, 2)) as total_amount")


def row_rules(spark: SparkSession, d: str) -> DataFrame:
    items = orders.rule_violations(t.order_items(spark, d), "order_id", {"quantity > 0": F.col("quantity") > 0, "unit_price >= 0": F.col("unit_price") >= 0})
    totals = orders.rule_violations(order_rows(spark, d), "id", {"total >= 0": F.col("total_amount") >= 0})
    return items.unionByName(totals).unionByName(orders.rule_violations(t.shifts(spark, d), "id", {"ended >= started": F.col("ended_ms") >= F.col("started_ms")}))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = motion.snapshots(valid(spark, d), t.NOW_MS)
    return s.withColumns({"derived_speed_kph": round2(F.col("derived_speed_kph")), "trip_distance_m": round2(F.col("trip_distance_m"))})


def evolved(spark: SparkSession, d: str) -> DataFrame:
    v = valid(spark, d).drop("arrival_ms")
    old = v.where("event_id % 2 <> 0").select(*[f.split()[0] for f in schemas.LOCATION_V1.split(", ")])
    return ingest.union_versions(old, v.where("event_id % 2 = 0"))


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of decode failures whole; of invalid samples, up to the reason (floats print differently elsewhere)."""
    letters = ingest.dead_letters(gated(spark, d))
    start = F.when(F.col("reason") == "decode-failure", F.col("payload")).otherwise(F.regexp_extract("payload", r'^\{"reason":"[^"]*"', 0))
    return letters.select("offset", "reason", start.alias("payload_start"))


def dead_letter_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the payloads, read back from their JSON text, and the order in which they stand."""
    letters = ingest.dead_letters(gated(spark, d))
    parsed = F.from_json("payload", "reason string, error string, driverId long, latitude double, longitude double, eventTime long, topic string, partition int, `offset` long, rawBase64 string")
    return letters.select(F.col("offset").alias("id"), F.array_join(F.json_object_keys("payload"), ",").alias("fields"), parsed.alias("p")).select("id", "fields", "p.*")


def framed(spark: SparkSession, d: str) -> DataFrame:
    """Records of both schema versions on one topic, each framed with its schema's id and decoded by it."""
    v = valid(spark, d).drop("arrival_ms")
    names = {1: schemas.LOCATION_V1, 2: schemas.LOCATION}
    each = [topics.framed(v.where(f"event_id % 2 = {2 - k}").select(*[f.split()[0] for f in schema.split(", ")]), k) for k, schema in names.items()]
    rows = each[0].unionByName(each[1])
    return ingest.union_versions(*[topics.framed_rows(rows, schema, k).select("record.*") for k, schema in names.items()])


def strict(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.decode(t.location_messages(spark, d)).where("error is null")
    return rows.select("event_id", ingest.strictly_valid().alias("strictly_valid"), ingest.has_kinematics().alias("has_kinematics"))


def split_windows(spark: SparkSession, d: str) -> DataFrame:
    return motion.speed_windows(motion.with_lateness(valid(spark, d)).where("not late"))


def fence_lookup(spark: SparkSession, d: str) -> DataFrame:
    inside = geofence.membership(valid(spark, d).select("event_id", "latitude", "longitude"), t.fences(spark))
    return inside.groupBy("event_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("fence_id").cast("string"))), ",").alias("fences"), F.count("*").alias("n")).drop("n")


def fence_versions(spark: SparkSession, d: str) -> DataFrame:
    """Events with the version of their fence's definition; each fence changes once."""
    first = t.fences(spark).select(F.col("id").alias("fence_id"), F.lit(0).cast("long").alias("valid_from"), F.lit(1).alias("version"))
    second = first.select("fence_id", (F.lit(t.EPOCH_MS + 3_600_000) + F.col("fence_id") * 60_000).alias("valid_from"), F.lit(2).alias("version"))
    return geofence.as_of(fence_events(spark, d).select("event_id", "fence_id", "event_ms"), first.unionByName(second), "fence_id", ["version"])


def fence_history(spark: SparkSession) -> DataFrame:
    """Two versions of each fence: the second, from a time of its own, is half as wide and lies further east."""
    boxes = t.fences(spark)
    change = F.lit(t.EPOCH_MS + 600_000) + F.col("id") * 60_000
    first = boxes.withColumns({"valid_from": F.lit(0).cast("long"), "valid_to": change})
    second = spark.createDataFrame([(i, n, k, t.shifted(w)) for i, n, k, w in t.FENCES], schemas.FENCE).withColumns({"valid_from": change, "valid_to": F.lit(None).cast("long")})
    return first.unionByName(second)


def zone_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Samples within the suppliers' zones, whose definitions are read from JSON files; unusable ones are left out."""
    path = t.scratch(spark, "zones")
    t.zones(spark, d).write.json(path)
    zones = topics.fences_json(spark, path, multi_line=False)
    return geofence.membership(valid(spark, d).select("event_id", "latitude", "longitude"), zones).select("event_id", "fence_id")


def zones_rejected(spark: SparkSession, d: str) -> DataFrame:
    return geofence.split_fences(t.zones(spark, d))[1].select("id", "name")


def latest(spark: SparkSession, d: str) -> DataFrame:
    return serving.latest(valid(spark, d), ["driver_id"], ["event_ms", "event_id"])


def insert_ignore_twice(spark: SparkSession, d: str) -> DataFrame:
    rows, path = valid(spark, d).select("driver_id", "event_ms", "event_id"), t.scratch(spark, "insert-ignore")
    for _ in range(2):  # the second time, nothing is new
        sinks.insert_ignore(rows, path, ["driver_id", "event_ms"], "event_ms")
    return spark.read.parquet(path).select("driver_id", "event_ms", "event_id")


def replacing_twice(spark: SparkSession, d: str) -> DataFrame:
    path = t.scratch(spark, "replacing")
    for _ in range(2):
        sinks.append_versions(versions(spark, d).select("event_id", "transition", "event_ms", "ingested_at"), path, "event_ms")
    return serving.newest_version(spark.read.parquet(path), "event_id", "ingested_at").select("event_id", "transition", "event_ms", "ingested_at")


def upsert_three_times(spark: SparkSession, d: str) -> DataFrame:
    rows = valid(spark, d).select("driver_id", "event_ms", "event_id", "latitude", "longitude")
    half = F.expr(f"event_ms < {t.EPOCH_MS} + 600000")
    table = KeyedTable(spark, t.scratch(spark, "upsert"), ["driver_id"], ["event_ms", "event_id"])
    table.merge(rows.where(~half), 1)
    table.merge(rows.where(half), 2)  # older rows change nothing newer
    table.merge(rows.where(half), 3)
    return table.read()


def facts_twice(spark: SparkSession, d: str) -> DataFrame:
    path = t.scratch(spark, "facts")
    done = t.deliveries(spark, d).where("delivered_ms is not null").selectExpr("order_id", "restaurant_id", "delivered_ms", "delivered_ms - delivered_ms % 86400000 as day_ms")
    for _ in range(2):
        sinks.merge_facts(done, path, "order_id", "day_ms")
    return spark.read.parquet(path).select("order_id", "restaurant_id", "delivered_ms", F.col("day_ms").cast("long").alias("day_ms"))


def facts_moved(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries merged as facts by the day of pickup, and again as they are delivered: some change their day, all their
    time, and the second batch comes twice. Every eleventh order is delivered three days later, so that its partition changes."""
    table = FactTable(spark, t.scratch(spark, "facts"), "order_id", "day_ms", ["known_ms"])
    rows = t.deliveries(spark, d)
    day = "{0} - {0} % 86400000 as day_ms"
    table.merge(rows.selectExpr("order_id", "restaurant_id", "picked_up_ms as known_ms", day.format("picked_up_ms")), 0)
    done = rows.where("delivered_ms is not null").selectExpr("order_id", "restaurant_id", "delivered_ms + if(order_id % 11 = 3, 259200000, 0) as known_ms")
    for number in (1, 1):
        table.merge(done.selectExpr("*", day.format("known_ms")), number)
    return table.read()


def _near_rank(values: DataFrame, told: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, within_bound): whether the rank of a sketch's 95th percentile is within its bound in the values."""
    n, error = F.col("values"), quantiles.rank_error()
    both = values.join(told, key).groupBy(key, "values", "p95").agg(F.count_if(F.col(value) <= F.col("p95")).alias("upto"), F.count_if(F.col(value) < F.col("p95")).alias("below"))
    within = (F.col("upto") >= (0.95 - error) * n) & (F.col("below") <= (0.95 + error) * n)
    return both.select(key, "values", within.alias("within_bound"))


def delivery_p95_long(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of delivery times over all hours, from stored sketches of each hour, held against the values."""
    rows = t.deliveries(spark, d).where("delivered_ms is not null").selectExpr("restaurant_id", "assigned_ms", "delivered_ms - assigned_ms as took")
    path = t.scratch(spark, "sketches")
    quantiles.hourly(rows, ["restaurant_id"], "assigned_ms", "took").write.partitionBy("hour_ms").parquet(path)
    return _near_rank(rows, quantiles.merged(spark.read.parquet(path), ["restaurant_id"], {"p95": 0.95}), "restaurant_id", "took")


def dwell_p95_long(spark: SparkSession, d: str) -> DataFrame:
    """The same of stays in fences."""
    rows = geofence.dwells(fence_events(spark, d))
    told = quantiles.merged(quantiles.hourly(rows, ["fence_id"], "enter_ms", "dwell_ms"), ["fence_id"], {"p95": 0.95})
    return _near_rank(rows, told, "fence_id", "dwell_ms")


def speed_windows_twice(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows inserted twice: nothing is new the second time, and no window of a key is replaced."""
    path, rows = t.scratch(spark, "windows"), motion.speed_windows(valid(spark, d))
    sinks.insert_ignore(rows, path, ["driver_id", "window_start"], "window_start", sinks.HOUR_MS)
    sinks.insert_ignore(rows.withColumn("sample_count", F.col("sample_count") + 1), path, ["driver_id", "window_start"], "window_start", sinks.HOUR_MS)
    return spark.read.parquet(path).drop("slice")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of all kinds with nullable order and driver ids."""
    none = F.lit(None).cast("long").alias("order_id")
    v = valid(spark, d)
    speed = motion.impossible_speeds(v).select("alert_id", "kind", none, "driver_id", "event_ms")
    gaps = motion.gps_gaps(v).select("alert_id", "kind", none, "driver_id", "event_ms")
    late = orders.pickup_timeouts(t.deliveries(spark, d)).select("alert_id", F.lit("ORDER_PICKUP_TIMEOUT").alias("kind"), "order_id", F.lit(None).cast("long").alias("driver_id"), "event_ms")
    return speed.unionByName(gaps).unionByName(late)


def alerts_twice(spark: SparkSession, d: str) -> DataFrame:
    path = t.scratch(spark, "alerts")
    for k in (1, 2):
        sinks.append_versions(alerts(spark, d).withColumn("ingested_at", F.col("event_ms") + 1_000 * k), path, "event_ms", 30 * sinks.DAY_MS)
    return serving.newest_version(spark.read.parquet(path), "alert_id", "ingested_at").drop("slice")


def derived_topics(spark: SparkSession, d: str) -> DataFrame:
    """Speed windows, fence events and alerts sent as messages and scanned again by topic, each with its own schema."""
    path = t.scratch(spark, "topics")
    sent = {"speed.windows": (motion.speed_windows(valid(spark, d)), "driver_id"), "geofence.events": (fence_events(spark, d), "driver_id"), "alerts": (alerts(spark, d), "alert_id")}
    for topic, (rows, key) in sent.items():
        sinks.to_topic(rows, key, topic).write.mode("append").parquet(path)
    scans = [topics.topic_scan(spark.read.parquet(path), topic, rows.schema) for topic, (rows, _) in sent.items()]
    told = [
        scans[0].select("topic", "key", F.concat_ws("|", "window_start", "sample_count").alias("told")),
        scans[1].select("topic", "key", F.concat_ws("|", "event_id", "transition").alias("told")),
        scans[2].select("topic", "key", F.concat_ws("|", "kind", F.coalesce(F.col("order_id").cast("string"), F.lit("-")), "event_ms").alias("told")),
    ]
    return told[0].unionByName(told[1]).unionByName(told[2])


def status_with_items(spark: SparkSession, d: str) -> DataFrame:
    nested = orders.with_items(orders.by_status(order_rows(spark, d), "P"), t.order_items(spark, d))
    return nested.select("id", "customer_id", "status", F.expr("array_join(transform(items, i -> concat_ws(':', i.line, i.quantity, i.unit_price)), ',')").alias("items"))


def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Values that occur more than once under a key that must be unique; nulls may repeat."""
    again = t.deliveries(spark, d).where("order_id % 500 = 3").selectExpr("id + 1 as id", "order_id")
    keys = {
        "customers.email": (t.customers(spark, d), "email"),
        "vehicles.plate": (t.vehicles(spark, d), "plate"),
        "deliveries.order_id": (t.deliveries(spark, d).select("id", "order_id").unionByName(again), "order_id"),
        "driver_shifts.driver_id active": (t.shifts(spark, d).where("status = 'ACTIVE'"), "driver_id"),
    }
    found = [orders.repeated(rows, [key]).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("value"), "n") for name, (rows, key) in keys.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all seven references whose parent is not there (some parents are taken away to have any)."""
    o = order_rows(spark, d).withColumn("restaurant_id", F.expr("id % 40 % 4 + 1"))
    dr, de = t.drivers(spark, d), t.deliveries(spark, d)
    keys = {
        "drivers.vehicle_id": (dr, "id", "vehicle_id", t.vehicles(spark, d), "id"),
        "driver_shifts.driver_id": (t.shifts(spark, d), "id", "driver_id", dr.where("id % 37 <> 0"), "id"),
        "orders.customer_id": (o, "id", "customer_id", t.customers(spark, d).where("id % 101 <> 0"), "id"),
        "orders.restaurant_id": (o, "id", "restaurant_id", t.restaurants(spark), "id"),
        "order_items.order_id": (t.order_items(spark, d), "line", "order_id", o.where("id % 211 <> 0"), "id"),
        "deliveries.order_id": (de, "id", "order_id", o.where("id % 211 <> 0"), "id"),
        "deliveries.driver_id": (de, "id", "driver_id", dr.where("id % 37 <> 0"), "id"),
    }
    found = None
    for name, (child, id_col, key, parent, parent_key) in keys.items():
        rows = orders.orphans(child.select(F.col(id_col).cast("long").alias("_id"), key), key, parent, parent_key)
        rows = rows.select(F.lit(name).alias("reference"), F.col("_id").alias("id"), F.col(key).cast("long").alias("missing"))
        found = rows if found is None else found.unionByName(rows)
    return found


def zone_rules(spark: SparkSession, d: str) -> DataFrame:
    return orders.rule_violations(t.zones(spark, d), "id", {"polygon is not blank": F.trim("polygonWkt") != ""})


def fact_dims(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with customer, driver, vehicle and restaurant; a vehicle that is not there leaves nulls."""
    o = order_rows(spark, d).select(F.col("id").alias("order_id"), "customer_id")
    named = [df.select(F.col("id").alias(key), F.col(value).alias(name), *more) for df, key, value, name, more in (
        (t.customers(spark, d), "customer_id", "name", "customer", []), (t.drivers(spark, d), "driver_id", "name", "driver", ["vehicle_id"]),
        (t.vehicles(spark, d), "vehicle_id", "type", "vehicle", []), (t.restaurants(spark), "restaurant_id", "name", "restaurant", []))]
    facts = t.deliveries(spark, d).select("order_id", "driver_id", "restaurant_id").join(o, "order_id")
    facts = facts.join(named[0], "customer_id").join(named[1], "driver_id").join(named[2], "vehicle_id", "left").join(named[3], "restaurant_id")
    return facts.select("order_id", "customer", "driver", "vehicle", "restaurant")


def captured(spark: SparkSession, d: str, tables: tuple[str, ...]) -> DataFrame:
    """Changes of the named tables, as read from their topics only."""
    messages = t.captured_messages(spark, d).where(F.col("topic").isin(*[f"fleet.public.{name}" for name in tables]))
    return cdc.changes(cdc.normalise(messages, schemas.ENVELOPE_ANY)).where(F.col("table").isin(*tables))


def captured_events(spark: SparkSession, d: str) -> DataFrame:
    return cdc.business_events(captured(spark, d, ("deliveries", "driver_shifts")))


def captured_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes of all captured tables by the topic that they are routed to."""
    rows = cdc.normalise(t.captured_messages(spark, d), schemas.ENVELOPE_BARE).where("error is null").withColumn("topic", cdc.routed(F.concat(F.lit("fleet.public."), F.col("table"))))
    return rows.groupBy("topic", "table", "op").agg(F.count("*").alias("n"))


def terminal_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = captured(spark, d, ("deliveries",)).select(F.col("after").getItem("status").alias("status"))
    return rows.where(F.col("status").isin(*cdc.TERMINAL_DELIVERIES)).groupBy("status").agg(F.count("*").alias("n"))


def with_item_text(spark: SparkSession, d: str) -> DataFrame:
    nested = orders.with_items(order_rows(spark, d), t.order_items(spark, d))
    return nested.select("id", "status", F.expr("array_join(transform(items, i -> concat_ws(':', i.line, i.quantity, i.unit_price)), ',')").alias("items"))


def current_orders(spark: SparkSession, d: str) -> DataFrame:
    return cdc.current(cdc.changes(narrow(spark, d, ["id"], ["id", "customer_id", "status", "total_amount"]))).select("id", "customer_id", "status", "total_amount", "lsn")


def one_trail(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the last order that went all the way: only its own are put in order, as a replay changes no maximum."""
    told = cdc.changes(narrow(spark, d, ["status"], ["id", "status"]))
    chosen = told.where("op = 'UPDATE' and after.status = 'DELIVERED'").agg(F.max("after.id").cast("string").alias("key"))
    messages = t.order_messages(spark, d).join(F.broadcast(chosen), "key", "left_semi")  # one row
    mine = cdc.deduplicated(cdc.changes(cdc.normalise(messages)))
    return mine.select("key", "op", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"), "lsn")


def state_by_lsn(spark: SparkSession, d: str) -> DataFrame:
    """Status by key, never moved backwards: later lsns first, then the earlier ones replayed."""
    rows = changes(spark, d).where("op <> 'DELETE'").select("key", F.col("after.status").alias("status"), "lsn")
    late, early = rows.where("lsn % 100 > 2"), rows.where("lsn % 100 <= 2")
    return sinks.latest_state(sinks.latest_state(None, late, ["key"], ["lsn"]), early, ["key"], ["lsn"])


def normalised_flat(spark: SparkSession, d: str) -> DataFrame:
    return narrow(spark, d, ["status"], ["status"]).select("op", "key", "lsn", "ts_ms", "from_snapshot", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"), "tombstone", "error", "offset")


def enriched_facts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with their customers. No hint: the customer table grows, so the join strategy is left to its size."""
    named = order_rows(spark, d).join(t.table(spark, d, "customer"), F.col("customer_id") == F.col("c_custkey")).select("id", "c_name")
    return t.deliveries(spark, d).drop("id").join(named, F.col("order_id") == F.col("id")).select("order_id", "c_name", "restaurant_id", "driver_id")


def gap_on_delivery(spark: SparkSession, d: str) -> DataFrame:
    return orders.gaps_on_delivery(t.deliveries(spark, d), motion.gps_gaps(valid(spark, d), 90_000))


def enriched_state(spark: SparkSession, d: str) -> DataFrame:
    zone = fence_events(spark, d).where("fence_id = 4").select("driver_id", "event_ms", F.col("transition").alias("zone_state"), F.lit(None).cast("long").alias("current_order"))
    given = serving.latest(t.deliveries(spark, d).select("driver_id", F.col("assigned_ms").alias("event_ms"), F.col("order_id").alias("current_order")), ["driver_id", "event_ms"], ["current_order"])
    shift = t.shifts(spark, d)
    turns = shift.selectExpr("driver_id", "started_ms as event_ms", "'ACTIVE' as shift_status").unionByName(shift.where("ended_ms is not null").selectExpr("driver_id", "ended_ms as event_ms", "status as shift_status"))
    updates = zone.unionByName(given, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)
    return motion.enrich_latest(valid(spark, d), updates, ["zone_state", "current_order", "shift_status"])


def joined_orders(spark: SparkSession, d: str) -> DataFrame:
    return order_rows(spark, d).join(t.deliveries(spark, d).withColumnRenamed("id", "delivery_id"), F.col("id") == F.col("order_id")).select("order_id", "status", "delivery_id", "driver_id")


def legs(spark: SparkSession, d: str) -> DataFrame:
    return motion.legs(valid(spark, d)).where("prev_ms is not null")


QUERIES: dict[str, Query] = {
    "ingest_validate": valid,
    "dead_letters": dead_letters,
    "dead_letter_fields": dead_letter_fields,
    "framed_schema_route": framed,
    "geofence_events_versioned": lambda s, d: geofence.transitions(valid(s, d), fence_history(s)).select("driver_id", "fence_id", "transition", "lat", "lon", "event_ms"),
    "zone_lookup_json": zone_lookup,
    "zones_rejected": zones_rejected,
    "driver_speed_stats": lambda s, d: motion.speed_stats(valid(s, d)),
    "sink_speed_windows_replay": speed_windows_twice,
    "sink_alerts_replay": alerts_twice,
    "derived_topic_scan": derived_topics,
    "orders_by_status_with_items": status_with_items,
    "dq_unique_keys": unique_keys,
    "dq_foreign_keys": foreign_keys,
    "dq_zone_rules": zone_rules,
    "fact_dims_enrich": fact_dims,
    "cdc_captured_op_counts": captured_counts,
    "cdc_captured_events": captured_events,
    "cdc_surviving_image": lambda s, d: cdc.changes(narrow(s, d, ["status", "total_amount"], ["status", "total_amount"])).withColumn("image", cdc.surviving()).select("key", "lsn", "op", "image.status", "image.total_amount", "offset"),
    "terminal_deliveries": terminal_deliveries,
    "ingest_quality_counts": lambda s, d: ingest.quality_counts(gated(s, d)),
    "ingest_quality_rate_1m": lambda s, d: ingest.quality_rate(gated(s, d)),
    "strict_validity": strict,
    "schema_evolution_union": evolved,
    "legs": lambda s, d: legs(s, d).select("event_id", "driver_id", "leg_ms", round2(F.col("leg_m")).alias("leg_m"), round2(F.col("leg_kph")).alias("leg_kph")),
    "leg_bearings": lambda s, d: legs(s, d).where("leg_m > 0").select("event_id", F.round(F.col("bearing"), 1).alias("bearing")),
    "driver_sessions": lambda s, d: motion.session_totals(valid(s, d)),
    "driver_snapshots": snapshots,
    "impossible_speed_alerts": lambda s, d: motion.impossible_speeds(valid(s, d)).withColumn("leg_kph", round2(F.col("leg_kph"))),
    "gps_gap_alerts": lambda s, d: motion.gps_gaps(valid(s, d)),
    "speed_window_1m": lambda s, d: motion.speed_windows(valid(s, d)),
    "speed_window_1m_late_split": split_windows,
    "late_samples": lambda s, d: ingest.late_letters(motion.with_lateness(valid(s, d)).where("late")),
    "speed_sliding_5m": lambda s, d: motion.sliding_speeds(valid(s, d)),
    "active_drivers_30s": lambda s, d: motion.active_drivers(valid(s, d)),
    "driver_mean_speed": lambda s, d: motion.mean_speeds(valid(s, d)),
    "geofence_membership": lambda s, d: geofence.membership(valid(s, d), t.fences(s)).select("event_id", "fence_id", "fence_name", "fence_type"),
    "geofence_lookup": fence_lookup,
    "geofence_events": fence_events,
    "geofence_dwell_p95": lambda s, d: geofence.dwell_p95(fence_events(s, d)),
    "geofence_versions": fence_versions,
    "driver_current_state": lambda s, d: latest(s, d).select("driver_id", "event_id", "event_ms", "latitude", "longitude", "speed_kph"),
    "latest_positions_top10": lambda s, d: latest(s, d).selectExpr("driver_id", "event_ms", "latitude", "longitude", "floor(speed_kph * 10 + 0.5) / 10 as speed_kph").orderBy("driver_id").limit(10),
    "events_dedup_final": lambda s, d: serving.newest_version(versions(s, d), "event_id", "ingested_at").select("event_id", "driver_id", "fence_id", "transition", "event_ms", "ingested_at"),
    "raw_vs_unique": lambda s, d: serving.raw_and_unique(versions(s, d), "event_id"),
    "distinct_keys": lambda s, d: serving.distinct_keys(valid(s, d), ["driver_id", "event_ms"]),
    "row_counts": lambda s, d: serving.row_counts({"driver_state": valid(s, d), "speed_windows": motion.speed_windows(valid(s, d)), "geofence_events": fence_events(s, d)}),
    "sink_insert_ignore_replay": insert_ignore_twice,
    "sink_replacing_replay": replacing_twice,
    "latest_state_upsert": upsert_three_times,
    "fact_merge": facts_twice,
    "delivery_p95_rollup": delivery_p95_long,
    "geofence_dwell_p95_rollup": dwell_p95_long,
    "fact_merge_updates": facts_moved,
    "order_totals": lambda s, d: orders.order_totals(t.order_items(s, d)),
    "order_with_items": with_item_text,
    "order_total_mismatch": lambda s, d: orders.total_mismatches(order_rows(s, d), t.order_items(s, d)),
    "orders_by_status": lambda s, d: orders.by_status(order_rows(s, d), "P").select("id", "customer_id", "status"),
    "drivers_by_status": lambda s, d: orders.by_status(t.shifts(s, d), "ACTIVE").select("id", "driver_id", "status").orderBy("id"),
    "dq_row_rules": row_rules,
    "dq_uniqueness": lambda s, d: orders.repeated(t.shifts(s, d).where("status = 'ACTIVE'"), ["driver_id"]),
    "dq_orphans": lambda s, d: orders.orphans(order_rows(s, d), "customer_id", t.table(s, d, "customer").where("c_custkey % 101 <> 0"), "c_custkey").select("id", "customer_id"),
    "illegal_transitions": lambda s, d: cdc.transitions(cdc.changes(narrow(s, d, ["status"], ["status"]))),
    "terminal_orders": lambda s, d: t.order_steps(s, d).where(F.col("status").isin(*cdc.TERMINAL_ORDERS)).groupBy("status").agg(F.count("*").alias("n")),
    "cdc_normalised": normalised_flat,
    "cdc_op_counts": lambda s, d: cdc.op_counts(normalised(s, d)),
    "cdc_current_orders": current_orders,
    "cdc_order_history": lambda s, d: cdc.history(cdc.changes(narrow(s, d, ["status"], ["status"]))),
    "cdc_dedup": lambda s, d: cdc.deduplicated(cdc.changes(narrow(s, d, ["status"], ["status"]))).select("key", "lsn", "op"),
    "cdc_changed_columns": lambda s, d: cdc.changed_columns(changes(s, d), ["id", "customer_id", "status", "total_amount"]),
    "cdc_lsn_regressions": lambda s, d: cdc.regressions(changes(s, d)),
    "cdc_business_events": lambda s, d: cdc.business_events(changes(s, d)),
    "cdc_trail_for_order": one_trail,
    "cdc_state_by_lsn": state_by_lsn,
    "shift_hours": lambda s, d: orders.shift_hours(t.shifts(s, d), t.NOW_MS),
    "delivery_route_distance": lambda s, d: orders.route_lengths(t.deliveries(s, d)),
    "delivery_p95_by_hour": lambda s, d: orders.delivery_p95(t.deliveries(s, d)),
    "deliveries_completed_1m": lambda s, d: orders.completed_per_minute(t.deliveries(s, d)),
    "pickup_to_delivered": lambda s, d: orders.pickup_to_delivered(t.deliveries(s, d)),
    "order_delivery_join": joined_orders,
    "fact_dim_enrich": enriched_facts,
    "pickup_timeouts": lambda s, d: orders.pickup_timeouts(t.deliveries(s, d)),
    "gps_gap_on_delivery": gap_on_delivery,
    "geofence_missed": lambda s, d: orders.missed_fences(t.deliveries(s, d), fence_events(s, d)),
    "delivery_events_interval_join": lambda s, d: orders.delivery_events(t.deliveries(s, d), fence_events(s, d)),
    "driver_state_enriched": enriched_state,
}


def queries() -> dict[str, Query]:
    return QUERIES | twins.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | twins.SQL
