"""Polygons as arrays of points: WKT, point-in-polygon, area, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<lon:double,lat:double>>"


def parse_wkt(text: Column) -> Column:
    """Outer ring of a WKT polygon, with or without quotes; null if no polygon can be read."""
    body = F.regexp_extract(text, r"(?i)POLYGON\s*\(\(([^)]*)\)\)", 1)
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lon"), F.get(p, F.lit(1)).try_cast("double").alias("lat")))
    good = (F.length(body) > 0) & F.forall(ring, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.when(good, ring)


def format_wkt(ring: Column, quoted: bool = False) -> Column:
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    text = F.concat(F.lit("POLYGON (("), points, F.lit("))"))
    return F.concat(F.lit('"'), text, F.lit('"')) if quoted else text


def _shifted(ring: Column) -> Column:
    """For each point the one before it, the last one before the first."""
    return F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule, half open in latitude: an edge counts from its lower end up to its upper one."""
    pairs = F.zip_with(_shifted(ring), ring, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))

    def crossed(e: Column) -> Column:
        between = ((e["y1"] <= lat) & (lat < e["y2"])) | ((e["y2"] <= lat) & (lat < e["y1"]))
        left = lon < F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return between & F.coalesce(left, F.lit(False))

    return F.when(F.size(ring) > 0, F.aggregate(pairs, F.lit(False), lambda c, e: c != crossed(e))).otherwise(False)


def area(ring: Column) -> Column:
    """Area in square degrees (shoelace)."""
    terms = F.zip_with(_shifted(ring), ring, lambda a, b: a["lon"] * b["lat"] - a["lat"] * b["lon"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)
