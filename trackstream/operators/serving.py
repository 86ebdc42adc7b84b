"""Serving views: latest row, dedup on read, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` for each key; partial maxima meet, no group is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def newest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Dedup on read: the row of greatest ``version`` for each key, as a replacing table shows it."""
    order = W.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def raw_and_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.count("*").alias("raw_rows"), F.count_distinct(key).alias("unique_ids"))


def distinct_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct().agg(F.count("*").alias("n"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)
