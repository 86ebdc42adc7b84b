"""Quantiles of long times from sketches stored by hour: a report over 90 days merges sketches and holds no values.

The sketches are Spark's own KLL sketches of whole numbers. Up to ``k`` values a sketch holds them all and is exact; beyond
that, the rank of what it returns is off by no more than ``rank_error(k)`` of all values, with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackstream.functions import geo

HOUR_MS = 3_600_000
#: Values that a sketch holds at least; a sketch takes some 3 to 4 times as many bytes times eight at most.
K = 4_000


def rank_error(k: int = K) -> float:
    """Published error of the sketch's rank, one quantile at a time."""
    return 2.296 / k**0.9723


def hourly(rows: DataFrame, keys: list[str], time_col: str, value_col: str, k: int = K) -> DataFrame:
    """(keys, hour_ms, values, sketch) for each hour. Null values count as nothing; partial sketches are made in each task."""
    known = rows.where(F.col(value_col).isNotNull())
    hour = geo.window_start(F.col(time_col), HOUR_MS).alias("hour_ms")
    return known.groupBy(*keys, hour).agg(F.count("*").alias("values"), F.kll_sketch_agg_bigint(F.col(value_col).cast("long"), k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], shares: dict[str, float], from_ms: int | None = None, to_ms: int | None = None, k: int = K) -> DataFrame:
    """(keys, values, one column for each of ``shares``) over the hours within [from_ms, to_ms): the least value that at
    least such a share of all values does not exceed."""
    hours = sketches
    if from_ms is not None:
        hours = hours.where(F.col("hour_ms") >= from_ms)
    if to_ms is not None:
        hours = hours.where(F.col("hour_ms") < to_ms)
    whole = hours.groupBy(*keys).agg(F.sum("values").alias("values"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    return whole.select(*keys, "values", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share))).alias(name) for name, share in shares.items()])
