"""Geofences: membership, ENTER and EXIT transitions, dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackstream.functions import geo, ids

#: Fences up to this number are broadcast whole; more are met by shape and grid cell.
BROADCAST_FENCES = 2_000


def split_fences(fences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable fences with edges, rejected rows)."""
    made = geo.with_edges(fences)
    return made.where("edges is not null"), made.where("edges is null").select(*fences.columns)


def _validity(fences: DataFrame) -> list[str]:
    return [c for c in ("valid_from", "valid_to") if c in fences.columns]


def _shaped(fences: DataFrame) -> DataFrame:
    """Fences with ``_shape``: a digest of edges and validity."""
    return fences.withColumn("_shape", F.sha2(F.to_json(F.struct("edges", *_validity(fences))), 256))


def _spread(shaped: DataFrame) -> DataFrame:
    """One row for each distinct shape and cell. The cells of a shape are as wide as its box, to the next power of two (its
    ``_level``), so it has at most four, be it large or small."""
    corners = ["min_x", "max_x", "min_y", "max_y"]
    kinds = shaped.groupBy("_shape").agg(*[F.first(c).alias(c) for c in ("edges", *corners, *_validity(shaped))])  # equal in all
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))
    level = kinds.withColumn("_level", F.ceil(F.log2(wide)).cast("int"))
    across = level.withColumn("_cx", F.explode(F.sequence(_cell("min_x"), _cell("max_x"))))
    return across.withColumn("_cy", F.explode(F.sequence(_cell("min_y"), _cell("max_y"))))


def _cell(c: str) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))


def _of_many(at: DataFrame, fences: DataFrame, inside: Column, broadcast_cells: int) -> DataFrame:
    """Points met with distinct shapes by cell, and then with all fences of each shape."""
    shaped = _shaped(fences)
    spread = _spread(shaped)
    levels = [r[0] for r in spread.select("_level").distinct().collect()]  # powers of two
    here = at.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"_cx": _cell("lon"), "_cy": _cell("lat")})
    spread = F.broadcast(spread) if spread.limit(broadcast_cells + 1).count() <= broadcast_cells else spread
    hit = here.join(spread, ["_level", "_cx", "_cy"]).where(inside).select(*at.columns, "_shape")
    return hit.join(shaped.select("_shape", "fence_id", "fence_name", "fence_type"), "_shape")


def membership(points: DataFrame, fences: DataFrame, broadcast_fences: int = BROADCAST_FENCES) -> DataFrame:
    """(point columns, fence_id, fence_name, fence_type) for each point strictly inside a fence.

    ``points`` have latitude and longitude. The number of fences is checked: few are broadcast, many are joined by shape,
    on grid cells of about the shape's size, so that each shape is tested once however many fences have it. Fences with ``valid_from`` and ``valid_to`` (null: open) are versions of a
    definition, and a point with ``event_ms`` is held against the one that was valid then.
    """
    usable, _ = split_fences(fences)
    shapes = usable.select(F.col("id").alias("fence_id"), F.col("name").alias("fence_name"), F.col("type").alias("fence_type"), "edges", "min_x", "max_x", "min_y", "max_y", *_validity(fences))
    inside = F.expr(geo.INSIDE)
    if "valid_from" in fences.columns:
        inside &= (F.col("event_ms") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("event_ms") < F.col("valid_to")))
    at = points.withColumns({"lat": F.col("latitude"), "lon": F.col("longitude")})
    if usable.limit(broadcast_fences + 1).count() <= broadcast_fences:
        joined = at.join(F.broadcast(shapes), inside)
    else:
        joined = _of_many(at, shapes, inside, broadcast_fences)
    return joined.select(*points.columns, "fence_id", "fence_name", "fence_type")


def transitions(samples: DataFrame, fences: DataFrame) -> DataFrame:
    """ENTER and EXIT events by driver and fence; a driver starts outside, and only changes are told. A new version of a
    fence (see ``membership``) keeps who was inside: the next sample tells whether that changed.

    A fence sample is an ENTER if the driver's sample before it was not inside, and the sample after the last inside one
    is the EXIT, so samples outside every fence are never multiplied by the fences.
    """
    order = W.partitionBy("driver_id").orderBy("event_ms", "event_id")
    here = {"nth": F.row_number().over(order), "next_lat": F.lead("latitude").over(order), "next_lon": F.lead("longitude").over(order), "next_ms": F.lead("event_ms").over(order)}
    inside = membership(samples.select("driver_id", "event_id", "event_ms", "latitude", "longitude").withColumns(here), fences)
    at = W.partitionBy("driver_id", "fence_id").orderBy("nth")
    near = inside.withColumns({"before": F.lag("nth").over(at), "after": F.lead("nth").over(at)})
    enters = near.where("before is null or before < nth - 1").select(
        "driver_id", "fence_id", "fence_name", "fence_type", F.lit("ENTER").alias("transition"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "event_ms"
    )
    exits = near.where("(after is null or after > nth + 1) and next_ms is not null").select(
        "driver_id", "fence_id", "fence_name", "fence_type", F.lit("EXIT").alias("transition"), F.col("next_lat").alias("lat"), F.col("next_lon").alias("lon"), F.col("next_ms").alias("event_ms")
    )
    both = enters.unionByName(exits)
    return both.withColumn("event_id", ids.geofence_event_id(F.col("driver_id"), F.col("fence_id"), F.col("transition"), F.col("event_ms")))


def dwells(events: DataFrame) -> DataFrame:
    """Completed stays: driver_id, fence_id, enter_ms, exit_ms, dwell_ms."""
    order = W.partitionBy("driver_id", "fence_id").orderBy("event_ms", F.desc("transition"))
    paired = events.withColumns({"next": F.lead("transition").over(order), "exit_ms": F.lead("event_ms").over(order)})
    return paired.where("transition = 'ENTER' and next = 'EXIT'").select("driver_id", "fence_id", F.col("event_ms").alias("enter_ms"), "exit_ms", (F.col("exit_ms") - F.col("event_ms")).alias("dwell_ms"))


def dwell_p95(events: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Exact 95th percentile of dwell time by fence and hour of entry."""
    return dwells(events).groupBy("fence_id", geo.window_start(F.col("enter_ms"), bucket_ms).alias("hour_ms")).agg(
        F.count("*").alias("stays"), geo.round2(F.percentile("dwell_ms", 0.95)).alias("p95_dwell_ms")
    )


def as_of(events: DataFrame, versions: DataFrame, key: str, columns: list[str], broadcast_keys: int = BROADCAST_FENCES) -> DataFrame:
    """Events with the version of ``key`` that was valid at ``event_ms``; ``versions`` have key, valid_from and columns.

    A key's versions are few and travel as one sorted array, broadcast where the keys are few (checked), so that events of
    a busy fence stay where they are. Events before the first version, or of an unknown key, get nulls.
    """
    told = versions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("valid_from", *columns))).alias("_v"))
    told = F.broadcast(told) if told.limit(broadcast_keys + 1).count() <= broadcast_keys else told
    last = F.try_element_at(F.filter("_v", lambda v: v["valid_from"] <= F.col("event_ms")), F.lit(-1))
    return events.join(told, key, "left").withColumn("_v", last).select(*events.columns, *[F.col(f"_v.{c}").alias(c) for c in columns])
