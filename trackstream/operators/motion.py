"""What follows from consecutive samples of a driver: legs, state, alerts and speed windows.

Samples have driver_id, event_id, event_ms, latitude, longitude, speed_kph, heading_degrees, vehicle_type and
arrival_ms. Event order is (event_ms, event_id). One shuffle by driver serves all windows of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackstream.functions import geo, ids
from trackstream.sources.scratch import written

GAP_MS = 120_000
MAX_KPH = 150.0
WINDOW_MS = 60_000
OUT_OF_ORDER_MS = 5_000
#: Rows of a slice of arrival time, about, and quantiles that arrival time is cut at, at most.
SLICE_ROWS = 100_000
COARSE = 1_000


def _of_driver(*more: str):
    return W.partitionBy("driver_id", *more).orderBy("event_ms", "event_id")


def _leg_columns(order) -> dict[str, Column]:
    def prev(c: str) -> Column:
        return F.lag(c).over(order)

    return {"prev_lat": prev("latitude"), "prev_lon": prev("longitude"), "prev_ms": prev("event_ms")}


def legs(samples: DataFrame, *within: str) -> DataFrame:
    """Samples with the way from the previous one of the driver: metres, ms, km/h (null unless time passed), bearing."""
    paired = samples.withColumns(_leg_columns(_of_driver(*within)))
    there = [F.col(c) for c in ("prev_lat", "prev_lon", "latitude", "longitude")]
    return paired.withColumns(
        {
            "leg_m": geo.haversine_m(*there),
            "leg_ms": F.col("event_ms") - F.col("prev_ms"),
            "bearing": geo.bearing_deg(*there),
        }
    ).withColumn("leg_kph", geo.kph(F.col("leg_m"), F.col("leg_ms")))


def sessions(samples: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Samples with ``session``: numbered per driver, a new one after more than ``gap_ms`` of silence."""
    order = _of_driver()
    silent = (F.col("event_ms") - F.lag("event_ms").over(order)) > gap_ms
    return samples.withColumn("_new", F.coalesce(silent, F.lit(False)).cast("long")).withColumn("session", F.sum("_new").over(order)).drop("_new")


def session_totals(samples: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    return sessions(samples, gap_ms).groupBy("driver_id", "session").agg(
        F.min("event_ms").alias("start_ms"), F.max("event_ms").alias("end_ms"), F.count("*").alias("samples")
    )


def snapshots(samples: DataFrame, now_ms: int, gap_ms: int = GAP_MS) -> DataFrame:
    """Driver state after each sample; state starts afresh with each session."""
    run = _of_driver("session").rowsBetween(W.unboundedPreceding, W.currentRow)
    state = legs(sessions(samples, gap_ms), "session")
    return state.select(
        "event_id",
        "driver_id",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "prev_lat",
        "prev_lon",
        F.last("speed_kph", ignorenulls=True).over(run).alias("reported_speed_kph"),
        F.col("leg_kph").alias("derived_speed_kph"),
        F.last("heading_degrees", ignorenulls=True).over(run).alias("heading"),
        "vehicle_type",
        F.sum(F.coalesce("leg_m", F.lit(0.0))).over(run).alias("trip_distance_m"),
        F.count("*").over(run).alias("sample_count"),
        "event_ms",
        F.greatest(F.lit(0), F.lit(now_ms) - F.col("event_ms")).alias("processing_lag_ms"),
    )


def impossible_speeds(samples: DataFrame, max_kph: float = MAX_KPH) -> DataFrame:
    """Alerts for consecutive samples that imply more than ``max_kph``."""
    kind = F.lit("IMPOSSIBLE_SPEED")
    detail = F.format_string("%.0f km/h over %.1fs between samples", F.col("leg_kph"), F.col("leg_ms") / 1000.0)
    return legs(samples).where(F.col("leg_kph") > max_kph).select(
        ids.alert_id(kind, F.col("driver_id"), F.col("event_ms")).alias("alert_id"), kind.alias("kind"), "driver_id", "event_ms", "leg_kph", detail.alias("detail")
    )


def gps_gaps(samples: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Alerts ``gap_ms`` after a sample that no other follows by then; the last sample of each driver has one too."""
    kind = F.lit("GPS_GAP")
    quiet = samples.withColumn("next_ms", F.lead("event_ms").over(_of_driver()))
    quiet = quiet.where(F.col("next_ms").isNull() | (F.col("next_ms") - F.col("event_ms") > gap_ms)).withColumn("alert_ms", F.col("event_ms") + gap_ms)
    return quiet.select(
        ids.alert_id(kind, F.col("driver_id"), F.col("alert_ms")).alias("alert_id"), kind.alias("kind"), "driver_id", F.col("alert_ms").alias("event_ms"),
        F.format_string("no GPS sample for %ds (event time)", F.lit(gap_ms // 1000)).alias("detail"),
    )


def speed_windows(samples: DataFrame, size_ms: int = WINDOW_MS) -> DataFrame:
    """Tumbling windows by driver: samples, metres, average and top km/h. Legs do not cross a window's edge.

    The average is all metres over the time of legs in which time passed.
    """
    windowed = samples.withColumn("window_start", geo.window_start(F.col("event_ms"), size_ms))
    moved = F.when(F.col("leg_ms") > 0, F.col("leg_ms"))
    sums = legs(windowed, "window_start").groupBy("driver_id", "window_start").agg(
        F.count("*").alias("sample_count"),
        F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("metres"),
        F.sum(moved).alias("moved_ms"),
        F.coalesce(F.max("leg_kph"), F.lit(0.0)).alias("top"),
    )
    return sums.select(
        "driver_id",
        "window_start",
        (F.col("window_start") + size_ms).alias("window_end"),
        "sample_count",
        geo.round2(F.coalesce(geo.kph(F.col("metres"), F.col("moved_ms")), F.lit(0.0))).alias("avg_speed_kph"),
        geo.round2(F.col("top")).alias("max_speed_kph"),
        geo.round2(F.col("metres")).alias("distance_m"),
    )


def arrival_slices(samples: DataFrame, rows: int = SLICE_ROWS, coarse: int = COARSE) -> DataFrame:
    """Samples with ``slice``, a number that rises with arrival time; a slice has about ``rows`` rows, however many there are.

    Arrival time is cut at up to ``coarse`` quantiles, so bursts get slices of their own, and each of those cells evenly.
    """
    n = samples.count()
    cells = max(1, min(coarse, n // rows))
    cuts = samples.agg(F.percentile_approx("arrival_ms", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 100 * cells)).first()[0] if cells > 1 else []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    cut = samples.withColumn("cell", F.size(F.filter(bounds, lambda c: c < F.col("arrival_ms"))))
    known = cut.groupBy("cell").agg(F.min("arrival_ms").alias("low"), F.max("arrival_ms").alias("high"), F.ceil(F.count("*") / rows).alias("parts"))
    offsets = known.withColumn("first", F.coalesce(F.sum("parts").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most ``coarse`` rows
    part = F.floor((F.col("arrival_ms") - F.col("low")) * F.col("parts") / (F.col("high") - F.col("low") + 1))
    return cut.join(F.broadcast(offsets), "cell").withColumn("slice", F.col("first") + part).drop("cell", "low", "high", "parts", "first")


def with_lateness(samples: DataFrame, size_ms: int = WINDOW_MS, bound_ms: int = OUT_OF_ORDER_MS, rows: int = SLICE_ROWS) -> DataFrame:
    """Samples with ``late``: their window had closed when they came, by a watermark over all drivers in arrival order.

    A running maximum over the whole table would be one task. Arrival time is cut into slices of about ``rows`` rows; each
    slice's maximum is known first, and the running maxima of those are joined back, so each slice is worked through on
    its own. Samples are read several times, so they are written once first.
    """
    cut = arrival_slices(written(samples, "lateness"), rows)
    tops = cut.groupBy("slice").agg(F.max("event_ms").alias("top"))
    before = tops.select("slice", F.max("top").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("before"))  # one row a slice
    own = W.partitionBy("slice").orderBy("arrival_ms", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = cut.join(before, "slice").withColumn("seen", F.greatest("before", F.max("event_ms").over(own)))
    closes = geo.window_start(F.col("event_ms"), size_ms) + size_ms - 1
    return seen.withColumn("late", closes <= F.col("seen") - bound_ms - 1).drop("slice", "before", "seen")


def sliding_speeds(samples: DataFrame, size_ms: int = 300_000, slide_ms: int = 60_000) -> DataFrame:
    """Average and top leg speed by driver over sliding windows."""
    moving = legs(samples).where("leg_kph is not null")
    last = geo.window_start(F.col("event_ms"), slide_ms)
    each = moving.select("driver_id", "leg_kph", F.explode(F.sequence(last - (size_ms - slide_ms), last, F.lit(slide_ms))).alias("window_start"))
    return each.groupBy("driver_id", "window_start").agg(
        geo.round2(F.avg("leg_kph")).alias("avg_speed_kph"), geo.round2(F.max("leg_kph")).alias("max_speed_kph"), F.count("*").alias("legs")
    )


def active_drivers(samples: DataFrame, size_ms: int = 30_000, slide_ms: int = 10_000) -> DataFrame:
    """Distinct drivers over sliding windows. Drivers are made distinct per step first, before rows are multiplied."""
    steps = samples.select("driver_id", geo.window_start(F.col("event_ms"), slide_ms).alias("last")).distinct()
    each = steps.select("driver_id", F.explode(F.sequence(F.col("last") - (size_ms - slide_ms), F.col("last"), F.lit(slide_ms))).alias("window_start"))
    return each.distinct().groupBy("window_start").agg(F.count("*").alias("drivers"))


def speed_stats(samples: DataFrame) -> DataFrame:
    """One row: samples processed, and drivers seen, which are those with a reported speed."""
    return samples.agg(F.count("*").alias("processed"), F.count_distinct(F.when(F.col("speed_kph").isNotNull(), F.col("driver_id"))).alias("drivers_seen"))


def mean_speeds(samples: DataFrame) -> DataFrame:
    """Mean reported speed by driver; samples without a speed count as processed only."""
    return samples.groupBy("driver_id").agg(
        geo.round2(F.avg("speed_kph")).alias("mean_speed_kph"), F.count("speed_kph").alias("with_speed"), F.count("*").alias("processed")
    )


def enrich_latest(samples: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Samples with the latest value of each column from ``updates`` (driver_id, event_ms, columns) at or before them.

    Both streams are put into one per driver; at equal times an update comes before a sample.
    """
    told = updates.select("driver_id", "event_ms", F.lit(None).cast("long").alias("event_id"), *columns, F.lit(0).alias("_rank"))
    asked = samples.select("driver_id", "event_ms", "event_id", *[F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in columns], F.lit(1).alias("_rank"))
    order = W.partitionBy("driver_id").orderBy("event_ms", "_rank", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = told.unionByName(asked).withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns})
    return both.where("_rank = 1").drop("_rank")
