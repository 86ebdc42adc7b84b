"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, only a local master may go on."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/trackstream-checkpoints"
    return f"{root.rstrip('/')}/fleet/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def staged(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """``rows`` written once, for a sink that reads them several times; gone at the end."""
    path = scratch(rows.sparkSession, name)
    try:
        rows.write.parquet(path)
        yield rows.sparkSession.read.schema(rows.schema).parquet(path)
    finally:
        remove(rows.sparkSession, path)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back, for plans that read them several times."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
