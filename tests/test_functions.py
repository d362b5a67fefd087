import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periplus.functions import geo, polygons
from periplus.functions.grid import MEDITERRANEAN, PORTS, Grid
from periplus.operators import hulls


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_distances_and_angles(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km"),
        geo.heading_difference(F.lit(359.0), F.lit(1.0)).alias("wrap"),
        geo.heading_difference(F.lit(0.0), F.lit(180.0)).alias("half"),
        geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("east"),
        geo.bearing(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("west"),
        geo.truncated(F.lit(-1.9)).alias("cut"),
        geo.euclidean_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("chord"),
    ).first()
    assert row["km"] == pytest.approx(6371 * math.pi / 180)
    assert (row["wrap"], row["half"], row["cut"]) == (2.0, 180.0, -1.0)
    assert row["east"] == pytest.approx(90) and row["west"] == pytest.approx(-90)
    assert row["chord"] == pytest.approx(2 * 6371)


def test_dead_reckoning(spark):
    moved = one(spark, geo.dead_reckoning(F.lit(60.0), F.lit(90.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(3600)))
    assert moved["lat"] == 0.0 and moved["lon"] == pytest.approx(60 * 1.852 / 6371 * 180 / math.pi, abs=1e-6)
    still = one(spark, geo.dead_reckoning(F.lit(0.0), F.lit(90.0), F.lit(5.5), F.lit(6.5), F.lit(0), F.lit(3600)))
    assert (still["lon"], still["lat"]) == (5.5, 6.5)


def test_lagrange(spark):
    three = geo.lagrange3(*[F.lit(float(x)) for x in (0, 0, 1, 1, 2, 4)], F.lit(3.0))
    many = geo.lagrange(F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3)]), F.array(*[F.lit(float(x**3)) for x in (0, 1, 2, 3)]), F.lit(5.0))
    same = geo.lagrange3(*[F.lit(float(x)) for x in (0, 0, 0, 1, 2, 4)], F.lit(3.0))
    assert one(spark, three) == pytest.approx(9)
    assert one(spark, many) == pytest.approx(125)
    assert one(spark, same) is None


def test_grid_edges(spark):
    points = [(-8.0, 29.0, 1), (-8.000001, 29.0, None), (-7.8, 29.0, 2), (-7.800001, 29.0, 1), (38.199999, 47.199999, 231 * 91), (38.2, 29.0, None), (0.0, 47.2, None)]
    df = spark.createDataFrame(points, "lon double, lat double, want long")
    got = df.select("want", MEDITERRANEAN.cell_id(F.col("lon"), F.col("lat")).alias("got"), MEDITERRANEAN.cell_id(F.col("lon"), F.col("lat"), compat=True).alias("compat")).collect()
    assert [r["want"] for r in got] == [r["got"] for r in got]
    assert got[1]["compat"] == 1
    assert (MEDITERRANEAN.stride, PORTS.stride) == (231, 4621)


def test_grid_round_trip(spark):
    g = Grid(-1.0, 0.0, 1.0, 1.0, 0.5, 0.5)
    back = g.cells(spark).withColumn("again", g.cell_id(F.col("lon"), F.col("lat")))
    assert back.where("cell_id <> again").count() == 0 and back.count() == 8


def test_polygons(spark):
    square = polygons.parse_wkt(F.lit('"POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"'))
    inside = lambda x, y: one(spark, polygons.contains(square, F.lit(float(x)), F.lit(float(y))))
    assert inside(1, 1) and not inside(3, 1) and not inside(-1, 1) and not inside(1, 2) and inside(1, 0)
    assert one(spark, polygons.area(square)) == 4.0
    assert one(spark, polygons.format_wkt(square)) == "POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0))"
    assert one(spark, polygons.parse_wkt(F.lit("POINT (1 2)"))) is None


POINTS = st.lists(st.tuples(st.integers(0, 6).map(float), st.integers(0, 6).map(float)), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(POINTS)
def test_hulls_hold_all_points(points):
    ring = hulls.convex_ring(points)
    assert ring[0] == ring[-1] and set(ring) <= set(points)
    if len(ring) > 3:
        assert all(hulls._turn(a, b, p) >= -1e-9 for a, b in zip(ring, ring[1:]) for p in points)
        for p in points:
            concave = hulls.concave_ring(points, 3)
            assert p in concave or hulls.inside_ring(concave, p) or hulls._on_ring(concave, p, 1e-9)


def test_degenerate_hulls():
    assert hulls.convex_ring([]) == []
    assert hulls.convex_ring([(1.0, 1.0)]) == [(1.0, 1.0)] * 2
    assert hulls.convex_ring([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == [(0.0, 0.0), (2.0, 2.0), (0.0, 0.0)]


def vincenty(lon1, lat1, lon2, lat2):
    """Metres on the WGS84 spheroid, by iteration."""
    a, f = 6378137.0, 1 / 298.257223563
    b, d = a * (1 - f), math.radians(lon2 - lon1)
    u, v = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    at = d
    for _ in range(100):
        s = math.hypot(math.cos(v) * math.sin(at), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(at))
        if s == 0:
            return 0.0
        c = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(at)
        angle, course = math.atan2(s, c), math.cos(u) * math.cos(v) * math.sin(at) / s
        square = 1 - course**2
        mid = c - 2 * math.sin(u) * math.sin(v) / square if square > 1e-15 else 0.0
        k = f / 16 * square * (4 + f * (4 - 3 * square))
        at = d + (1 - k) * f * course * (angle + k * s * (mid + k * c * (2 * mid**2 - 1)))
    w = square * (a**2 - b**2) / b**2
    big, small = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768)), w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
    more = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return b * big * (angle - more)


def test_spheroid_against_iteration(spark):
    places = [(x, y) for x in (-170.0, -8.0, 0.0, 0.01, 23.6) for y in (-60.0, 0.0, 30.0, 37.94, 37.95, 80.0)]
    pairs = [(*p, *q) for p in places for q in places]
    assert abs(vincenty(144.424867889, -37.951033417, 143.926495528, -37.652821139) - 54972.271) < 0.01
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double").select("a", "b", "c", "d", geo.spheroid_metres("a", "b", "c", "d").alias("m")).collect()
    assert len(rows) == 900 and all(abs(r["m"] - (x := vincenty(r["a"], r["b"], r["c"], r["d"]))) <= 1e-5 * x for r in rows)
