"""Input tables, and the fleet and order streams derived from them (event, order and line item tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackstream import schemas
from trackstream.sources.scratch import scratch as scratch  # noqa: PLC0414

# Four fences as WKT; the first three are restaurants.
FENCES = [
    (1, "Republic Square pickup", "RESTAURANT", "POLYGON((44.5126 40.1770, 44.5140 40.1770, 44.5140 40.1782, 44.5126 40.1782, 44.5126 40.1770))"),
    (2, "Opera pickup", "RESTAURANT", "POLYGON((44.5146 40.1866, 44.5160 40.1866, 44.5160 40.1878, 44.5146 40.1878, 44.5146 40.1866))"),
    (3, "Cascade pickup", "RESTAURANT", "POLYGON((44.5187 40.1901, 44.5201 40.1901, 44.5201 40.1913, 44.5187 40.1913, 44.5187 40.1901))"),
    (4, "Kentron delivery zone", "ZONE", "POLYGON((44.4980 40.1700, 44.5300 40.1700, 44.5300 40.1950, 44.4980 40.1950, 44.4980 40.1700))"),
]
# The order statuses from first to last, and the one for a cancelled order.
PATH = ["CREATED", "CONFIRMED", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP", "OUT_FOR_DELIVERY", "DELIVERED"]
CANCELLED = "CANCELLED"

EPOCH_MS = 1_704_067_200_000
#: All times of a run are measured against this instant where "now" is needed.
NOW_MS = EPOCH_MS + 40 * 86_400_000


#: Rows of a table that one task makes messages of, about.
SPREAD_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, per_task: int = SPREAD_ROWS) -> DataFrame:
    """The rows of a file dealt over tasks by their number.

    Tables of keys compress so well that splits by bytes, or a file's few row groups, give fewer tasks than there are
    cores, and each row becomes several messages.
    """
    parts = -(-rows.count() // per_task)
    return rows.repartition(parts, key) if parts > 1 else rows


def locations(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """GPS samples in the order of ``(arrival_ms, event_id)``, a few of them bad, late or not decodable."""
    rows = table(spark, sf_dir, "events")
    e = (spread(rows, "event_id", 2 * SPREAD_ROWS) if dealt else rows).selectExpr(
        "event_id", "user_id as driver_id", "value", "event_type",
        "cast(get_json_object(props, '$.k') as int) as k",
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1920000 as e",
    )
    p = e.selectExpr("*", f"{EPOCH_MS} + e as event_ms", "40 + (driver_id % 7) * 15 as v")
    return p.selectExpr(
        "event_id", "driver_id", "event_ms",
        "case when event_id % 307 = 0 then 999.0d else (40165000 + abs(((e * v) div 1000 + driver_id * 997) % 70000 - 35000)"
        " + case when event_id % 211 = 0 then 500000 else 0 end) / 1000000.0d end as latitude",
        "(44490000 + abs(((e * (v + 10)) div 1000 + driver_id * 1499) % 96000 - 48000)) / 1000000.0d as longitude",
        "case when event_type = 'signup' then null when event_id % 401 = 0 then -5.0d else value end as speed_kph",
        "cast((k * 37) div 10 as int) as heading_degrees",
        "element_at(array('BICYCLE', 'SCOOTER', 'MOTORCYCLE', 'CAR', 'VAN'), cast(driver_id % 5 as int) + 1) as vehicle_type",
        "event_ms + (event_id * 7919) % 9000 + case when event_id % 97 = 0 then 90000 else 0 end as arrival_ms",
        "event_id % 503 = 0 as undecodable",
    )


def location_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as topic rows: value (bytes of JSON, or of something else), topic, partition, offset, timestamp."""
    fields = [f.split()[0] for f in schemas.LOCATION.split(", ")]
    rows = locations(spark, sf_dir, dealt=True)
    value = F.when(F.col("undecodable"), F.expr("concat(x'00ff', cast(cast(event_id as string) as binary))")).otherwise(
        F.to_json(F.struct(*fields)).cast("binary")
    )
    made = rows.select(value.alias("made"), "driver_id", "event_id", "arrival_ms")  # before the generator, which is not compiled
    return made.select(
        F.explode(F.array("made")).alias("value"),  # made once a row, as if read from a topic
        F.lit("driver.location").alias("topic"),
        F.expr("cast(driver_id % 24 as int)").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("arrival_ms").alias("timestamp"),
    )


def fences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FENCES, schemas.FENCE)


def shifted(wkt: str) -> str:
    """The fixed boxes, their western edge moved to the middle."""
    points = [p.split() for p in wkt[9:-2].split(", ")]
    xs = sorted({float(x) for x, _ in points})
    return "POLYGON((" + ", ".join(f"{(xs[0] + xs[1]) / 2 if float(x) == xs[0] else float(x):.4f} {y}" for x, y in points) + "))"


def order_steps(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Each status that an order goes through: k, customer_id, total_amount, n, i, status, before, lsn, ts_ms."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    o = (spread(rows, "o_orderkey") if dealt else rows).selectExpr(
        "o_orderkey as k", "o_custkey as customer_id", "cast(o_totalprice as decimal(12, 2)) as total_amount",
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz)) div 1000 as t0",
        "case when o_orderkey % 11 = 0 then 3 when o_orderstatus = 'F' then 7 when o_orderstatus = 'P' then 5 else 2 end as n",
    )
    path = ", ".join(f"'{s}'" for s in PATH)
    s = o.selectExpr("*", "explode(sequence(1, n)) as i").where("not (k % 13 = 0 and n >= 5 and i = 3)")
    return s.selectExpr(
        "k", "customer_id", "total_amount", "n", "i",
        f"case when k % 11 = 0 and i = 3 then '{CANCELLED}' else element_at(array({path}), i) end as status",
        f"case when i > 1 then element_at(array({path}), case when k % 13 = 0 and n >= 5 and i = 4 then 2 else i - 1 end) end as before",
        "k * 100 + i as lsn", "t0 + i * 300000 + case when i >= 4 then (k % 7) * 60000 else 0 end as ts_ms",
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps as change envelopes on a topic, with deletes, tombstones, replays and malformed values."""
    s = order_steps(spark, sf_dir, dealt=True)
    image = "named_struct('id', k, 'customer_id', customer_id, 'status', {}, 'total_amount', cast(total_amount as string))"
    told = s.selectExpr(
        "*", "explode(concat(array(i * 2), if(i = n and k % 17 = 0, array(i * 2 + 1), array()), if(i = n and k % 19 = 0, array(180, 181), array()), if(i = n and k % 1009 = 0, array(190), array()))) as nth"
    )
    envelope = (
        f"to_json(named_struct('before', case when nth = 180 then {image.format('status')} when before is not null then {image.format('before')} end, "
        f"'after', case when nth <> 180 then {image.format('status')} end, 'source', named_struct('table', 'orders', 'lsn', if(nth = 180, k * 100 + 90, lsn), "
        "'snapshot', if(nth <> 180 and i = 1 and k % 5 = 0, 'true', 'false')), 'op', case when nth = 180 then 'd' when i > 1 then 'u' when k % 5 = 0 then 'r' else 'c' end, 'ts_ms', ts_ms))"
    )
    value = f"case when nth = 181 then null when nth = 190 then 'not-json' else {envelope} end as made"
    return once(told.selectExpr("'fleet.public.orders' as topic", "cast(k as string) as key", value, "k * 1000 + nth as offset"))


def once(made: DataFrame) -> DataFrame:
    """Messages whose values (``made``) are made once a row, as if read from a topic, and not again where a filter asks for them.

    What stands within the generator is not compiled, so the values are made before it.
    """
    return made.select("topic", "key", F.explode(F.array("made")).alias("value"), "offset")


def order_items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return (spread(rows, "l_orderkey", 5 * SPREAD_ROWS) if dealt else rows).selectExpr(
        "l_orderkey as order_id", "l_linenumber as line",
        "case when l_orderkey % 997 = 0 then 0 else cast(l_quantity as int) end as quantity",
        "cast(floor(l_extendedprice / l_quantity * 100 + 0.5d) / 100 as decimal(12, 2)) as unit_price",
    )


def deliveries(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One delivery for each order that came to be picked up."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    drivers = table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("drivers"))
    o = (spread(rows, "o_orderkey") if dealt else rows).where("o_orderkey % 11 <> 0 and o_orderstatus in ('F', 'P')").crossJoin(F.broadcast(drivers))  # one row
    d = o.selectExpr(
        "o_orderkey", "o_orderstatus", "o_custkey % drivers as driver_id", "o_orderkey % 3 as r", f"{EPOCH_MS} + (o_orderkey * 90007) % 1200000 as assigned_ms"
    ).selectExpr("*", "assigned_ms + 60000 + (o_orderkey % 23) * 45000 as picked_up_ms")
    return d.selectExpr(
        "o_orderkey * 10 as id", "o_orderkey as order_id", "driver_id", "r + 1 as restaurant_id", "assigned_ms", "picked_up_ms",
        "case when o_orderstatus = 'F' then picked_up_ms + 120000 + (o_orderkey % 31) * 10000 end as delivered_ms",
        "element_at(array(40.1776d, 40.1872d, 40.1907d), cast(r as int) + 1) as pickup_lat", "element_at(array(44.5133d, 44.5153d, 44.5194d), cast(r as int) + 1) as pickup_lon",
        "(40170100 + (o_orderkey * 37) % 24800) / 1000000.0d as delivery_lat", "(44498100 + (o_orderkey * 53) % 31800) / 1000000.0d as delivery_lon",
    )


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shift a driver, open for every tenth; every fiftieth has a second open one."""
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("driver_id")).distinct()
    open_ = "driver_id % 10 = 0"
    first = d.selectExpr(
        "driver_id * 10 as id", "driver_id", f"if({open_}, 'ACTIVE', 'ENDED') as status", f"{EPOCH_MS} + (driver_id % 12) * 600000 as started_ms",
        f"if({open_}, null, {EPOCH_MS} + (driver_id % 12) * 600000 + 14400000 + (driver_id % 9) * 900000) as ended_ms",
    )
    second = d.where("driver_id % 50 = 0").selectExpr("driver_id * 10 + 1 as id", "driver_id", "'ACTIVE' as status", f"{EPOCH_MS} + 20000000 as started_ms", "cast(null as long) as ended_ms")
    return first.unionByName(second)


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers with a vehicle each; every forty-first has one that is not there."""
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return d.selectExpr(
        "id", "concat('driver ', id) as name", "element_at(array('OFFLINE', 'AVAILABLE', 'ON_DELIVERY'), cast(id % 3 as int) + 1) as status",
        "if(id % 41 = 0, -id - 1, id % 97 + 1) as vehicle_id",
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vehicle for each part; plates repeat for every two hundredth, and a few are unknown."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "element_at(array('BICYCLE', 'SCOOTER', 'CAR'), cast(p_partkey % 3 as int) + 1) as type",
        "case when p_partkey % 300 = 7 then null when p_partkey % 200 = 0 then concat('P', p_partkey - 1) else concat('P', p_partkey) end as plate",
    )


def restaurants(spark: SparkSession) -> DataFrame:
    return fences(spark).where("type = 'RESTAURANT'").select("id", "name")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an email each, which every hundredth shares with the one before."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name", "concat('c', if(c_custkey % 100 = 0, c_custkey - 1, c_custkey), '@mail.example') as email")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery zone for each supplier: a box, but for some without a text."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "44.49 + (s_suppkey * 7 % 100) * 0.0005 as x", "40.165 + (s_suppkey * 13 % 60) * 0.0005 as y")
    box = "concat('POLYGON((', {0}, ' ', {1}, ', ', {2}, ' ', {1}, ', ', {2}, ' ', {3}, ', ', {0}, ' ', {3}, ', ', {0}, ' ', {1}, '))')"
    at = [f"format_string('%.4f', cast({v} as double))" for v in ("x", "y", "x + 0.002", "y + 0.002")]
    return s.selectExpr("id", "concat('zone ', id) as name", "'ZONE' as type", f"case id % 17 when 3 then '  ' when 5 then 'not a polygon' else {box.format(*at)} end as polygonWkt")


def captured_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change envelopes of all five captured tables on their topics: (topic, key, value, offset)."""
    source = "named_struct('table', '{}', 'lsn', lsn, 'snapshot', 'false')"
    envelope = "to_json(named_struct('before', before, 'after', after, 'source', {}, 'op', op, 'ts_ms', ts_ms))"

    def on(rows: DataFrame, name: str) -> DataFrame:
        value = envelope.format(source.format(name))
        return once(rows.selectExpr(f"'fleet.public.{name}' as topic", "key", f"{value} as made", "lsn as offset"))

    steps = deliveries(spark, sf_dir, dealt=True).selectExpr(
        "id", "order_id", "driver_id", "explode(array_compact(array("
        "named_struct('i', 1, 'was', cast(null as string), 'is', 'DRIVER_ASSIGNED', 'at', assigned_ms), named_struct('i', 2, 'was', 'DRIVER_ASSIGNED', 'is', 'AT_PICKUP', 'at', picked_up_ms - 30000), "
        "named_struct('i', 3, 'was', 'AT_PICKUP', 'is', 'PICKED_UP', 'at', picked_up_ms), if(delivered_ms is not null, named_struct('i', 4, 'was', 'PICKED_UP', 'is', if(order_id % 29 = 0, 'FAILED', 'DELIVERED'), 'at', delivered_ms), null)))) as s",
    )
    image = "map('id', cast(id as string), 'status', {})"
    delivery = steps.selectExpr(
        "cast(id as string) as key", f"if(s.i > 1, {image.format('s.was')}, null) as before", f"{image.format('s.is')} as after", "id * 10 + s.i as lsn", "if(s.i = 1, 'c', 'u') as op", "s.at as ts_ms"
    )
    shift = shifts(spark, sf_dir).selectExpr("*", "explode(if(ended_ms is null, array(1), array(1, 2))) as i").selectExpr(
        "cast(id as string) as key", f"if(i = 2, {image.format(chr(39) + 'ACTIVE' + chr(39))}, null) as before", f"{image.format('if(i = 2, status, ' + chr(39) + 'ACTIVE' + chr(39) + ')')} as after",
        "id * 10 + i as lsn", "if(i = 1, 'c', 'u') as op", "if(i = 1, started_ms, ended_ms) as ts_ms",
    )
    none = "cast(null as map<string, string>) as before"
    driver = drivers(spark, sf_dir).selectExpr("cast(id as string) as key", none, f"{image.format('status')} as after", "id as lsn", "'r' as op", f"{EPOCH_MS} as ts_ms")
    item = order_items(spark, sf_dir, dealt=True).selectExpr("concat(order_id, '-', line) as key", none, "map('order_id', cast(order_id as string), 'quantity', cast(quantity as string)) as after", "order_id * 10 + line as lsn", "'c' as op", f"{EPOCH_MS} as ts_ms")
    rows = order_messages(spark, sf_dir).select("topic", "key", "value", "offset")
    for name, df in (("deliveries", delivery), ("driver_shifts", shift), ("drivers", driver), ("order_items", item)):
        rows = rows.unionByName(on(df, name))
    return rows
