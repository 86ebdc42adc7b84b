"""Geospatial column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null if any input is."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))  # least() would pass over a null


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 <= b < 360."""
    y = F.sin(F.radians(lon2) - F.radians(lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(
        F.radians(lon2) - F.radians(lon1)
    )
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def on_earth(lat: Column, lon: Column) -> Column:
    """Coordinates in range; null and NaN are not."""
    ok = (~F.isnan(lat)) & (~F.isnan(lon)) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))


def kph(metres: Column, ms: Column) -> Column:
    """Kilometres an hour; null unless time passed."""
    return F.when(ms > 0, metres / (ms / 1000.0) * 3.6)


def round2(x: Column) -> Column:
    """Two decimals, half up on the binary value."""
    return F.floor(x * 100 + 0.5) / 100


def window_start(ms: Column, size_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(size_ms))


def with_edges(fences: DataFrame, wkt_col: str = "polygonWkt") -> DataFrame:
    """Fences with ``edges`` (array of x1, y1, x2, y2) and bounding box; ``edges`` is null for bad WKT."""
    rings = F.expr(
        f"transform(regexp_extract_all({wkt_col}, '\\\\(([^()]+)\\\\)', 1), r -> transform(split(trim(r), ' *, *'), "
        "p -> struct(try_cast(split(p, ' +')[0] as double) as x, try_cast(split(p, ' +')[1] as double) as y)))"
    )
    good = F.expr(
        f"{wkt_col} rlike '^ *POLYGON *\\\\(' and size(rings) > 0 and forall(rings, r -> size(r) >= 4 and r[0] = r[size(r) - 1] "
        "and forall(r, p -> p.x is not null and p.y is not null))"
    )
    edges = F.expr(
        "flatten(transform(rings, r -> transform(sequence(1, size(r) - 1), "
        "i -> struct(r[i - 1].x as x1, r[i - 1].y as y1, r[i].x as x2, r[i].y as y2))))"
    )
    made = fences.withColumn("rings", rings).withColumn("edges", F.when(good, edges)).drop("rings")
    return made.withColumns({f"{f}_{c}": F.expr(f"array_{f}(transform(edges, e -> e.{c}1))") for f in ("min", "max") for c in "xy"})


#: The point (lon, lat) is strictly inside the polygon given by ``edges``: even-odd crossings, boundary excluded.
INSIDE = """
min_x <= lon and lon <= max_x and min_y <= lat and lat <= max_y
and not exists(edges, s -> (s.x2 - s.x1) * (lat - s.y1) = (s.y2 - s.y1) * (lon - s.x1)
    and lon between least(s.x1, s.x2) and greatest(s.x1, s.x2) and lat between least(s.y1, s.y2) and greatest(s.y1, s.y2))
and aggregate(edges, 0, (n, s) -> n + if((s.y1 > lat) <> (s.y2 > lat)
    and lon < (s.x2 - s.x1) * (lat - s.y1) / (s.y2 - s.y1) + s.x1, 1, 0)) % 2 = 1
"""
