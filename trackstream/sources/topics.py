"""Scans of topics, files and serving tables. Kafka, Avro and JDBC need Spark's packages for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackstream import schemas

#: Bytes before the record in a registry-framed message: a zero byte and a four-byte schema id.
FRAME = 5


def topic_rows(rows: DataFrame) -> DataFrame:
    """Kafka rows with the columns that the operators take; time in milliseconds."""
    return rows.select("key", "value", "topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp"))


def schema_id(rows: DataFrame) -> DataFrame:
    """Rows with ``schema_id``: null unless the value is framed as the registry does."""
    framed = (F.length("value") > FRAME) & (F.hex(F.substring("value", 1, 1)) == "00")
    return rows.withColumn("schema_id", F.when(framed, F.conv(F.hex(F.substring("value", 2, 4)), 16, 10).cast("long")))


def avro_rows(rows: DataFrame, schema_json: str, id_: int) -> DataFrame:
    """Records written with one schema, decoded permissively (null where the bytes do not fit)."""
    from pyspark.sql.avro.functions import from_avro

    framed = schema_id(rows).where(F.col("schema_id") == id_)
    body = F.substring(F.col("value"), F.lit(FRAME + 1), F.length("value"))
    return framed.withColumn("record", from_avro(body, schema_json, {"mode": "PERMISSIVE"}))


def framed(rows: DataFrame, id_: int) -> DataFrame:
    """Rows as registry-framed messages with JSON bodies: a zero byte, the schema's id in four bytes, the record."""
    head = F.unhex(F.lit(f"00{id_:08x}"))
    return rows.select(F.concat(head, F.to_json(F.struct("*")).cast("binary")).alias("value"))


def framed_rows(rows: DataFrame, schema: str, id_: int) -> DataFrame:
    """Messages framed with one schema's id, their JSON bodies decoded by it; a body that does not fit gives nulls.

    The same route as ``avro_rows``, for where Spark's Avro package is not there.
    """
    body = F.expr(f"substring(value, {FRAME + 1})").cast("string")
    return schema_id(rows).where(F.col("schema_id") == id_).withColumn("record", F.from_json(body, schema))


def topic_scan(messages: DataFrame, topic: str, schema: StructType) -> DataFrame:
    """Messages of one topic with the fields of their JSON values beside topic and key."""
    return messages.where(F.col("topic") == topic).select("topic", "key", F.from_json("value", schema).alias("r")).select("topic", "key", "r.*")


def fences_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Fence definitions from one JSON array, or from files with one definition a line; the schema is declared."""
    return spark.read.schema(schemas.FENCE).option("multiLine", multi_line).json(path)


def series(spark: SparkSession, path: str, time_col: str, from_ms: int, to_ms: int, slice_ms: int) -> DataFrame:
    """Rows of a time-sliced table within [from_ms, to_ms): only the slices touched are listed and read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("slice").between(from_ms // slice_ms, (to_ms - 1) // slice_ms) & (F.col(time_col) >= from_ms) & (F.col(time_col) < to_ms))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
