"""Replay-safe sinks over time-partitioned Parquet, as batch writes and as ``foreachBatch`` functions.

A replayed batch leaves every table as it was: insert-ignore keeps the first row of a key, replacing keeps all rows and
lets reads take the newest, upsert keeps the row of latest event time. Sinks that would append a retried batch again commit
by its number: files through ``manifests.Published``, database tables through a staging table and one transaction. Tables
of many keys, and facts that change, are in ``manifests``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackstream.operators import ingest
from trackstream.operators.manifests import Published
from trackstream.sources.scratch import staged

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _sliced(rows: DataFrame, time_col: str, slice_ms: int) -> DataFrame:
    return rows.withColumn("slice", F.floor(F.col(time_col) / slice_ms))


def insert_ignore(batch: DataFrame, path: str, keys: list[str], time_col: str, slice_ms: int = DAY_MS, by: list[str] | None = None) -> None:
    """Append the rows whose key is not there yet; of rows of one key in a batch, the first by ``by`` (all columns).

    Null is a key value like any other.

    ``time_col`` is part of the key, so only the slices that the batch touches are read. The batch is written once into the
    table's own staging folder, so its source is not computed twice.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in keys]
    order = F.struct(*(by or rest or keys))
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*(rest or keys)), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    with staged(_sliced(first.select(batch.columns), time_col, slice_ms), "staged") as fresh:
        if _exists(spark, path):
            known = spark.read.parquet(path)
            touched = [r[0] for r in fresh.select("slice").distinct().collect()]  # slices of one batch
            here = F.col("slice").isin([x for x in touched if x is not None]) | (F.col("slice").isNull() if None in touched else F.lit(False))
            known = known.where(here).select(*[F.col(c).alias(f"_{c}") for c in ("slice", *keys)])
            fresh = fresh.join(known, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("slice", *keys)]), "left_anti")
        fresh.write.mode("append").partitionBy("slice").parquet(path)


def append_versions(batch: DataFrame, path: str, time_col: str, slice_ms: int = DAY_MS) -> None:
    """Append everything, with its ``ingested_at``; reads take the newest version of a key."""
    _sliced(batch, time_col, slice_ms).write.mode("append").partitionBy("slice").parquet(path)


def compact_versions(spark: SparkSession, path: str, into: str, key: str, version: str) -> None:
    """Write only the newest version of each key to ``into``."""
    order = W.partitionBy("slice", key).orderBy(F.desc(version))
    rows = spark.read.parquet(path).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    rows.write.partitionBy("slice").parquet(into)


def latest_state(current: DataFrame | None, batch: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """State after a batch: a row is replaced only by one of later ``by``."""
    both = batch if current is None else current.withColumn("_old", F.lit(1)).unionByName(batch.withColumn("_old", F.lit(0)))
    if current is None:
        both = both.withColumn("_old", F.lit(0))
    rest = [c for c in batch.columns if c not in keys]
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by, "_old")).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Version numbers of the complete states in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(p)] if fs.exists(p) else []
    done = [f.getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done if n.startswith("v=") and n[2:].isdigit())


def upsert_latest(batch: DataFrame, folder: str, keys: list[str], by: list[str], version: int) -> str:
    """Write the state after a batch as ``folder/v=<version>``, from the greatest complete version below.

    Versions may have gaps; a repeated version is rewritten from what was before it. A version below all that are there
    has lost its base and is refused. The whole state is rewritten, which suits a row for each key.
    """
    spark = batch.sparkSession
    there = _versions(spark, folder)
    below = [v for v in there if v < version]
    if there and not below and version not in there:
        raise ValueError(f"{folder} begins with version {there[0]}, so version {version} has no state to start from")
    current = spark.read.parquet(f"{folder}/v={below[-1]}") if below else None
    latest_state(current, batch, keys, by).write.mode("overwrite").parquet(f"{folder}/v={version}")
    return f"{folder}/v={version}"


def merge_facts(facts: DataFrame, path: str, key: str, date_col: str, by: list[str] | None = None) -> None:
    """Append staged facts that are not in the warehouse yet, one for each key (the first by ``by``), partitioned by date.

    A key fixes its date, so only the partitions of the batch's dates are read.
    """
    spark = facts.sparkSession
    rest = [c for c in facts.columns if c != key]
    first = facts.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*(by or rest))).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    with staged(first.select(facts.columns), "facts") as fresh:
        if _exists(spark, path):
            dates = [r[0] for r in fresh.select(date_col).distinct().collect()]  # dates of one batch
            known = spark.read.parquet(path).where(F.col(date_col).isin(dates)).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").partitionBy(date_col).parquet(path)


def to_topic(rows: DataFrame, key: str, topic: str) -> DataFrame:
    """Rows as messages: (topic, key, value), the key as text and the row as JSON with its nulls."""
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def split_letters(gated: DataFrame, into: Published, batch: int) -> bool:
    """One pass of a gated batch into two sinks, ``valid`` rows and ``letters``, which show the batch together and once."""
    with staged(gated, "gated") as rows:
        return into.write({"valid": ingest.valid(rows), "letters": ingest.dead_letters(rows)}, batch)


def to_jdbc(batch: DataFrame, url: str, table: str, rows: int = 500, **options: str) -> None:
    """Append to a database table in statements of ``rows`` rows; a failed task is tried again by Spark."""
    batch.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", rows).options(**options).mode("append").save()


def to_jdbc_once(batch: DataFrame, url: str, table: str, number: int, rows: int = 500, retries: int = 3, **options: str) -> None:
    """Put a micro-batch into a database table once, however often it is tried; ``batch_id`` tells its number there.

    The rows go to a staging table of the sink, which an attempt overwrites, and from there into the table in one transaction
    that first takes away what an earlier attempt had put there. A failed attempt is repeated up to ``retries`` times.
    """
    told, stage = batch.withColumn("batch_id", F.lit(number).cast("long")), f"{table}_stage"
    for attempt in range(retries + 1):
        try:
            to_jdbc(told.limit(0), url, table, rows, **options)  # makes the table where there is none
            told.write.format("jdbc").option("url", url).option("dbtable", stage).option("batchsize", rows).options(**options).mode("overwrite").save()
            _transaction(batch.sparkSession, url, [f'DELETE FROM {table} WHERE "batch_id" = {int(number)}', f"INSERT INTO {table} SELECT * FROM {stage}"], options)
            return
        except Exception:
            if attempt == retries:
                raise


def _transaction(spark: SparkSession, url: str, statements: list[str], options: dict[str, str]) -> None:
    """All statements or none, on one connection of the driver."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    login = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            login.setProperty(name, options[name])
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            connection.createStatement().executeUpdate(text)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def each_batch(write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; the batch is kept while it is used more than once."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            write(batch)
        finally:
            batch.unpersist()

    return run
