"""Distances on the sphere and to polylines, as column expressions."""

from pyspark.sql import Column, functions as F

from dealsift import rules


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * rules.EARTH_RADIUS_MILES) * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), 1 - chord)))


def _segment_miles(lat: Column, lon: Column, a: Column, b: Column) -> Column:
    """Planar distance to a segment, scaled at the latitude of the point."""
    sx = F.cos(F.radians(lat)) * rules.MILES_PER_DEGREE_LON
    sy = F.lit(rules.MILES_PER_DEGREE_LAT)
    ax, ay = (a["lon"] - lon) * sx, (a["lat"] - lat) * sy
    dx, dy = (b["lon"] - a["lon"]) * sx, (b["lat"] - a["lat"]) * sy
    # without length the quotient is null, which counts as the start; no branch, so compiled code works out each part once
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy)))
    return F.hypot(ax + along * dx, ay + along * dy)


def point_to_polyline_miles(lat: Column, lon: Column, vertices: Column) -> Column:
    """Least distance to an array of (lat, lon) vertices; null for an empty line."""
    count = F.size(vertices)
    starts = F.slice(vertices, F.lit(1), F.greatest(count - 1, F.lit(0)))
    ends = F.slice(vertices, F.lit(2), F.greatest(count - 1, F.lit(0)))
    return (
        F.when(count == 1, haversine_miles(lat, lon, vertices[0]["lat"], vertices[0]["lon"]))
        .when(count > 1, F.array_min(F.zip_with(starts, ends, lambda a, b: _segment_miles(lat, lon, a, b))))
    )


def segments(vertices: Column) -> Column:
    """The pieces of a polyline as (a, b) structs; a single vertex is a piece without length."""
    count = F.size(vertices)
    starts = F.slice(vertices, F.lit(1), F.greatest(count - 1, F.lit(1)))
    ends = F.when(count > 1, F.slice(vertices, F.lit(2), F.greatest(count - 1, F.lit(1)))).otherwise(starts)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_miles(lat: Column, lon: Column, piece: Column) -> Column:
    """Planar distance to one of the segments; null for none."""
    return _segment_miles(lat, lon, piece["a"], piece["b"])


def polyline_center(vertices: Column) -> Column:
    """Mean latitude and longitude of the vertices; null for an empty line."""
    def mean(field: str) -> Column:
        total = F.aggregate(vertices, F.lit(0.0), lambda acc, v: acc + v[field])
        return F.when(F.size(vertices) > 0, total / F.size(vertices))

    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def envelope(lat: Column, lon: Column, radius: float) -> Column:
    """Bounding box around a point: radius in degrees of latitude and longitude."""
    d_lat = F.lit(radius / rules.MILES_PER_DEGREE_LAT)
    d_lon = F.lit(radius) / F.greatest(F.lit(1.0), F.cos(F.radians(lat)) * rules.MILES_PER_DEGREE_LON)
    return F.struct(
        (lat - d_lat).alias("south"), (lat + d_lat).alias("north"),
        (lon - d_lon).alias("west"), (lon + d_lon).alias("east"),
    )


def normalize_pair(first: Column, second: Column) -> Column:
    """Swap a coordinate pair that is clearly given as longitude, latitude."""
    swapped = second.between(24, 50) & first.between(-125, -66) & ~(
        first.between(24, 50) & second.between(-125, -66))
    return F.struct(
        F.when(swapped, second).otherwise(first).alias("lat"),
        F.when(swapped, first).otherwise(second).alias("lon"),
    )
