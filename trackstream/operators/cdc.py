"""Database change envelopes: normalise, replay, diff and interpret."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackstream import schemas

# Operation codes of a change envelope.
OPS = {"c": "CREATE", "r": "READ", "u": "UPDATE", "d": "DELETE", "t": "TRUNCATE", "m": "MESSAGE"}
# Which order status may follow which.
NEXT_STATUS = {
    "CREATED": ["CONFIRMED", "CANCELLED"],
    "CONFIRMED": ["PREPARING", "CANCELLED"],
    "PREPARING": ["READY_FOR_PICKUP", "CANCELLED"],
    "READY_FOR_PICKUP": ["PICKED_UP", "CANCELLED"],
    "PICKED_UP": ["OUT_FOR_DELIVERY", "CANCELLED"],
    "OUT_FOR_DELIVERY": ["DELIVERED", "CANCELLED"],
}
TERMINAL_ORDERS = ("DELIVERED", "CANCELLED")
TERMINAL_DELIVERIES = ("DELIVERED", "FAILED", "CANCELLED")
# Business events by table and new status.
EVENTS = {
    ("orders", "CREATED"): "ORDER_CREATED",
    ("orders", "CONFIRMED"): "ORDER_CONFIRMED",
    ("orders", "PICKED_UP"): "ORDER_PICKED_UP",
    ("orders", "DELIVERED"): "ORDER_DELIVERED",
    ("orders", "CANCELLED"): "ORDER_CANCELLED",
    ("driver_shifts", "ACTIVE"): "DRIVER_SHIFT_STARTED",
    ("driver_shifts", "ENDED"): "DRIVER_SHIFT_ENDED",
    ("deliveries", "DRIVER_ASSIGNED"): "DRIVER_ASSIGNED",
    ("deliveries", "AT_PICKUP"): "DRIVER_ARRIVED",
}


def table_of(topic: Column, pattern: str = r"^fleet\.public\.(.+)$") -> Column:
    """Table name of a capture topic; null for other topics."""
    return F.nullif(F.regexp_extract(topic, pattern, 1), F.lit(""))


def routed(topic: Column) -> Column:
    """The derived topic that a table's changes are routed to."""
    return F.concat(F.lit("fleet."), table_of(topic), F.lit(".cdc"))


def normalise(messages: DataFrame, envelope: str = schemas.ENVELOPE) -> DataFrame:
    """Topic rows (topic, key, value, offset) to change rows; a null value is a DELETE without images, a bad one has an error.

    Of ``before`` and ``after``, those that ``envelope`` names are parsed and returned.
    """
    e = F.from_json("value", f"{envelope}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    images = [n for n in ("before", "after") if f"{n} " in envelope]
    rows = messages.select("*", e.alias("_e")).select("*", F.explode(F.array("_e")).alias("e"))  # parsed once a row, not once a field
    tombstone = F.col("value").isNull()
    bad = ~tombstone & (F.col("e").isNull() | F.col("e._bad").isNotNull() | F.col("e.op").isNull())
    named = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return rows.select(
        F.when(tombstone, "DELETE").when(~bad, F.coalesce(F.try_element_at(named, F.col("e.op")), F.lit("UNKNOWN"))).alias("op"),
        F.coalesce("e.source.table", table_of(F.col("topic"))).alias("table"),
        F.col("e.ts_ms").alias("ts_ms"),
        F.col("e.source.lsn").alias("lsn"),
        F.coalesce(F.lower("e.source.snapshot") != "false", F.lit(False)).alias("from_snapshot"),
        *[F.when(~bad, F.col(f"e.{n}")).alias(n) for n in images],
        "key",
        tombstone.alias("tombstone"),
        F.when(bad, "malformed envelope").alias("error"),
        F.when(bad, F.col("value")).alias("raw"),
        "offset",
    )


def changes(normalised: DataFrame) -> DataFrame:
    """Row changes only: no tombstones, no malformed envelopes."""
    return normalised.where("error is null and not tombstone")


def surviving(op: str = "op") -> Column:
    """The image that a change leaves to look at: before a delete, after anything else."""
    return F.when(F.col(op) == "DELETE", F.col("before")).otherwise(F.col("after"))


def op_counts(normalised: DataFrame) -> DataFrame:
    return normalised.where("error is null").groupBy("table", "op", "from_snapshot", "tombstone").agg(F.count("*").alias("n"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each (table, key, lsn): the first by offset.

    Rows of a key are sorted once, by (lsn, offset), so what follows by (table, key) in that order needs no further shuffle.
    """
    log = W.partitionBy("table", "key").orderBy("lsn", "offset")
    again = F.col("lsn").eqNullSafe(F.lag("lsn").over(log)) & (F.row_number().over(log) > 1)
    return rows.withColumn("_again", again).where("not _again").drop("_again")


def current(rows: DataFrame) -> DataFrame:
    """The table that the changes amount to: last image by lsn for each key, deleted keys gone."""
    last = rows.groupBy("table", "key").agg(F.max_by(F.struct("op", "after", "lsn"), F.struct("lsn", "offset")).alias("last"))
    return last.where("last.op <> 'DELETE'").select("last.after.*", F.col("last.lsn").alias("lsn"))


def history(rows: DataFrame) -> DataFrame:
    """Status trail by key: entered_ms and time in status (null in the last)."""
    order = W.partitionBy("table", "key").orderBy("lsn", "offset")
    trail = deduplicated(rows.select("table", "key", "lsn", "offset", "op", "after.status", "ts_ms")).where("op <> 'DELETE'")
    return trail.select("key", "lsn", "status", F.col("ts_ms").alias("entered_ms"), (F.lead("ts_ms").over(order) - F.col("ts_ms")).alias("in_status_ms"))


def changed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Names of the columns in which before and after differ, for updates."""
    differ = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns]
    return rows.where("op = 'UPDATE'").select("key", "lsn", F.array_join(F.array_compact(F.array(*differ)), ",").alias("changed"))


def regressions(rows: DataFrame) -> DataFrame:
    """Changes whose lsn is not above the one that came before for the same key."""
    order = W.partitionBy("table", "key").orderBy("offset")
    return rows.withColumn("prev_lsn", F.lag("lsn").over(order)).where("lsn <= prev_lsn").select("key", "lsn", "prev_lsn", "offset")


def transitions(rows: DataFrame) -> DataFrame:
    """Status changes by key, labelled legal, noop or illegal; the first status of a key is not a change."""
    order = W.partitionBy("table", "key").orderBy("lsn", "offset")
    told = rows.select("table", "key", "lsn", "offset", "op", F.col("after.status").alias("to_status"))  # no images are moved
    trail = deduplicated(told).where("op <> 'DELETE'").withColumn("from_status", F.lag("to_status").over(order))
    allowed = F.create_map(*[x for k, v in NEXT_STATUS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    legal = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("from_status")), F.col("to_status")), F.lit(False))
    label = F.when(F.col("from_status") == F.col("to_status"), "noop").when(legal, "legal").otherwise("illegal")
    return trail.where("from_status is not null").select("key", "lsn", "from_status", "to_status", label.alias("verdict"))


def business_events(rows: DataFrame) -> DataFrame:
    """Events that row changes stand for: a status that is new to the row, by table."""
    spark = rows.sparkSession
    mapping = spark.createDataFrame([(*k, v) for k, v in EVENTS.items()], "`table` string, to_status string, event_type string")
    is_new = F.expr("before is null or before.status <> after.status")
    told = rows.select("table", "key", "lsn", "offset", "op", "ts_ms", is_new.alias("_new"), F.col("after.status").alias("to_status"))  # no images are moved
    fresh = deduplicated(told).where("op <> 'DELETE' and _new")
    named = fresh.join(F.broadcast(mapping), ["table", "to_status"])  # a fixed table of nine rows
    return named.select("key", "lsn", "event_type", F.col("ts_ms").alias("event_ms"))
