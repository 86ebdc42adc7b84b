"""The ingestion gate: decode without ever failing, validate, and split into valid rows and dead letters.

Every function is ``DataFrame -> DataFrame`` and works on batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackstream import schemas
from trackstream.functions.geo import on_earth

RAW_BYTES = 256
MAX_KPH = 400
STRICT_MAX_KPH = 300


def decode(messages: DataFrame, schema: str = schemas.LOCATION) -> DataFrame:
    """Topic rows to typed rows plus ``error``, ``raw_base64`` (of the first 256 bytes), topic, partition, offset, timestamp."""
    text = F.col("value").cast("string")
    record = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = messages.select("*", F.explode(F.array(record)).alias("_r"))  # parsed once a row, not once a field
    broken = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.coalesce(F.substring(F.ltrim(text), 1, 1) == "{", F.lit(False))
    error = F.when(F.col("value").isNull(), "tombstone / null value").when(broken, "not decodable")
    fields = [f.split()[0] for f in schema.split(", ")]
    return rows.withColumn("error", error).select(
        *[F.when(F.col("error").isNull(), F.col(f"_r.{f}")).alias(f) for f in fields],
        "error",
        F.when(F.col("error").isNotNull(), F.base64(F.substring("value", 1, RAW_BYTES))).alias("raw_base64"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def invalid_reason(max_kph: float = MAX_KPH) -> Column:
    """The first rule that a sample breaks, or null; missing kinematics break none."""
    speed, heading = F.col("speed_kph"), F.col("heading_degrees")
    return (
        F.when(~on_earth(F.col("latitude"), F.col("longitude")), "coordinate out of range")
        .when(F.isnan(speed) | (speed < 0) | (speed > max_kph), "impossible speed")
        .when((heading < 0) | (heading >= 360), "heading out of range")
    )


def gate(decoded: DataFrame) -> DataFrame:
    """Decoded rows with ``reason``: null for valid ones, ``decode-failure``, or the rule that is broken."""
    return decoded.withColumn("reason", F.when(F.col("error").isNotNull(), "decode-failure").otherwise(invalid_reason()))


def valid(gated: DataFrame) -> DataFrame:
    return gated.where("reason is null").select(*[f.split()[0] for f in schemas.LOCATION.split(", ")], F.col("timestamp").alias("arrival_ms"))


def dead_letters(gated: DataFrame) -> DataFrame:
    """(reason, payload): a JSON text with all that is known of a rejected row, nulls included."""
    keep = {"ignoreNullFields": "false"}
    failed = F.to_json(F.struct("reason", "error", "topic", "partition", "offset", F.col("raw_base64").alias("rawBase64")), keep)
    invalid = F.to_json(
        F.struct(
            "reason",
            F.col("driver_id").alias("driverId"),
            "latitude",
            "longitude",
            F.col("event_ms").alias("eventTime"),
            "topic",
            "partition",
            "offset",
        ),
        keep,
    )
    return gated.where("reason is not null").select("offset", "reason", F.when(F.col("error").isNotNull(), failed).otherwise(invalid).alias("payload"))


def late_letters(late: DataFrame) -> DataFrame:
    return late.select("event_id", F.to_json(F.struct(F.lit(True).alias("late"), F.col("driver_id").alias("driverId"), F.col("event_ms").alias("eventTime"))).alias("payload"))


def observed(gated: DataFrame, name: str = "ingest") -> DataFrame:
    """``gated`` with running counters of valid and dead-lettered rows, for a query listener."""
    return gated.observe(name, F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("dlq"))


def quality_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


def quality_rate(gated: DataFrame) -> DataFrame:
    """Valid and dead-lettered rows a second, by minute of arrival."""
    minute = F.col("timestamp") - F.pmod("timestamp", F.lit(60_000))
    return gated.groupBy(minute.alias("minute_ms"), F.col("reason").isNull().alias("ok")).agg((F.count("*") / 60.0).alias("per_second"))


def strictly_valid() -> Column:
    """The stricter rule of the record type itself: all keys present, speed to 300."""
    speed, heading = F.col("speed_kph"), F.col("heading_degrees")
    return (
        F.col("driver_id").isNotNull()
        & F.col("event_ms").isNotNull()
        & on_earth(F.col("latitude"), F.col("longitude"))
        & F.coalesce(speed.between(0, STRICT_MAX_KPH) & ~F.isnan(speed), F.lit(True))
        & F.coalesce((heading >= 0) & (heading < 360), F.lit(True))
    )


def has_kinematics() -> Column:
    return F.col("speed_kph").isNotNull() & F.col("heading_degrees").isNotNull()


def union_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of the first and the second schema version together; what the first lacks is null."""
    return new.unionByName(old, allowMissingColumns=True)
