"""The scalar functions as SQL functions of a session; they are expanded by the optimiser, with no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_R = "6371.0D"
_HAVERSINE = f"{_R} * 2 * atan2(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)), sqrt(1 - (pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"
_FOUR = "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE"

SQL_FUNCTIONS = {
    "haversine_km": (_FOUR, "DOUBLE", _HAVERSINE),
    "bearing_degrees": (_FOUR, "DOUBLE", "degrees(atan2(cos(radians(lat2)) * sin(radians(lon2) - radians(lon1)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))))"),
    "heading_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN abs(a - b) <= 180.0D THEN abs(a - b) ELSE abs(360.0D - greatest(a, b) + least(a, b)) END"),
    "is_turning_point": ("a DOUBLE, b DOUBLE, threshold DOUBLE", "BOOLEAN", "CASE WHEN abs(a - b) <= 180.0D THEN abs(a - b) ELSE abs(360.0D - greatest(a, b) + least(a, b)) END >= threshold"),
    "geodetic_to_cartesian": ("lon DOUBLE, lat DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>", f"named_struct('x', {_R} * cos(radians(lat)) * cos(radians(lon)), 'y', {_R} * cos(radians(lat)) * sin(radians(lon)), 'z', {_R} * sin(radians(lat)))"),
    "polygon_contains": (
        "ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>, lon DOUBLE, lat DOUBLE",
        "BOOLEAN",
        "aggregate(zip_with(concat(slice(ring, size(ring), 1), slice(ring, 1, size(ring) - 1)), ring, (a, b) -> named_struct('a', a, 'b', b)), false, (c, e) -> c != (((e.a.lat <= lat AND lat < e.b.lat) OR (e.b.lat <= lat AND lat < e.a.lat)) AND coalesce(lon < try_divide((e.b.lon - e.a.lon) * (lat - e.a.lat), e.b.lat - e.a.lat) + e.a.lon, false)))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones; returns their names."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
