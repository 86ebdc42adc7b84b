"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Documents can be long: 10,000 of them, Spark's default, fill a Python worker's memory.
BATCH_ROWS = 500
#: Bytes of an Arrow batch: a batch of very long documents ends here, well before ``BATCH_ROWS`` rows.
BATCH_BYTES = "32m"
#: A key is hot with more than one in so many of all rows: there are at most so many such keys, whatever the size.
HOT_KEYS = 1000
#: Bytes up to which an estimate alone may have a table broadcast: estimates are sizes of compressed files and leave out what
#: an explode adds, so the table in memory can be some hundred times as large.
ESTIMATED = 256 << 10


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, if they are larger, and to ``size`` bytes.

    Python functions read these two settings when their query runs, so they stay lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, only a local master may go on."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/trackstream-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back: cuts lineage and survives lost
    executors.

    What it shuffled is deleted once it is written. The table stays until ``discard``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    for scope in _SCOPES:
        scope.paths.append(path)
    with shuffles_deleted(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """The tables written within ``temporary``."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` outlives the scope: the tables that it reads stay."""
        read = "".join(df.inputFiles())
        self.paths = [p for p in self.paths if p.rsplit("/", 1)[-1] not in read]
        return df


_SCOPES: list[Scope] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """Tables that are materialized within go at the end, also after an error, but for those that ``keep`` names."""
    scope = Scope()
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)
        for path in scope.paths:
            remove(spark, path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the query that wrote them has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, joins broadcast tables that adaptive execution has measured to be within the session's threshold, but tables
    that are only estimated to be so up to ``ESTIMATED`` alone."""
    estimate, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (estimate, measured)}
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if before[measured] is None:
        spark.conf.set(measured, str(most))
    spark.conf.set(estimate, str(min(most, ESTIMATED)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing will read any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = re.match(r"(.*/tables/[^/]+-[0-9a-f]{32})/", files[0])
            if folder:
                remove(spark, folder[1])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_values(rows: DataFrame, values: DataFrame, key: str, n_col: str, merged: bool = False) -> DataFrame:
    """``rows`` joined with ``values``, one row per key that tells in ``n_col`` how many rows have it.

    The rows of a key with more than one in ``HOT_KEYS`` of all are dealt over several tasks, in proportion, and its value
    is repeated for each. There are fewer than ``HOT_KEYS`` such keys, whatever the size, so their list is broadcast; the
    values are not, unless Spark estimates them to be small; with ``merged``, not even then. Rows without a value, and null
    keys, are left out.
    """
    total = values.agg(F.sum(n_col)).first()[0] or 0
    told = values.withColumn("_salts", F.ceil(F.col(n_col) / max(64, total // HOT_KEYS))).drop(n_col)
    hot = F.broadcast(told.where("_salts > 1").select(key, F.col("_salts").alias("_of")))
    salt = F.when(F.col("_of").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_of"))).cast("long")
    dealt = told.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    dealt = dealt.hint("merge") if merged else dealt
    return rows.join(hot, key, "left").withColumn("_salt", salt).drop("_of").join(dealt, [key, "_salt"]).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def sampled(id_col: Column, share: float) -> Column:
    """A repeatable pseudo-random share of ids."""
    return F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000)


def text_input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under internal names, so further or clashing columns of ``df`` never matter."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
