"""Density clustering of positions: neighbour pairs by a bucketed band join, then components (reports of similar motion: ``density``).

Pairs are found by an equi-join on buckets no smaller than the radius (each row looks into its own and
the neighbouring buckets), with the exact distance as residual. Core points have ``min_points``
neighbours, themselves included; clusters are the components of core points; a border point joins the
smallest cluster next to it; noise is dropped. A cluster is named by its smallest core row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periplus.functions import geo
from periplus.operators import density, statistics
from periplus.operators.materialize import written

#: Kilometres in a degree of latitude on the sphere, rounded down so that buckets are never too small.
KM_DEGREE = 111.19
#: The least on the spheroid (a degree of latitude at the equator), rounded down.
KM_DEGREE_SPHEROID = 110.57


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for all nodes of ``a, b`` pairs, self pairs included.

    Large-star and small-star rounds over a written edge table; only a count and a checksum reach the driver.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = written(links, "star"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        links = written(small, "star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    root = links.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def labelled(points: DataFrame, pairs: DataFrame, min_points: int, key: str = "row_id") -> DataFrame:
    """``key, cluster_id`` of all clustered points. ``pairs``: ``a, b`` in both directions, a <> b."""
    pairs = written(pairs, "pairs")
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    core = points.join(degree, points[key] == degree["a"], "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_points).select(F.col(key).alias("core"))
    core = written(core, "core")
    near_core = pairs.join(core, pairs["b"] == core["core"], "left_semi")
    among = near_core.join(core, near_core["a"] == core["core"], "left_semi")
    named = components(among.select("a", "b").unionByName(core.select(F.col("core").alias("a"), F.col("core").alias("b"))))
    named = written(named, "named")
    border = near_core.join(core, near_core["a"] == core["core"], "left_anti").join(named, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("cluster_id"))
    return named.select(F.col("node").alias(key), F.col("component").alias("cluster_id")).unionByName(border.select(F.col("a").alias(key), "cluster_id"))


def _buckets(df: DataFrame, keys: list[str], lat_step: Column, lon_step: Column, near: Column, columns: list[str]) -> DataFrame:
    """Pairs ``a, b`` of rows with equal keys that lie in neighbouring buckets and satisfy ``near`` (of ``l_`` and ``r_``)."""
    at = df.withColumn("_y", F.floor(F.col("lat") / lat_step)).withColumn("_x", F.floor(F.col("lon") / lon_step))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = at.withColumn("_d", F.explode(around)).withColumn("_x", F.col("_x") + F.col("_d.dx")).withColumn("_y", F.col("_y") + F.col("_d.dy"))
    left = left.select(*keys, "_x", "_y", *[F.col(c).alias(f"l_{c}") for c in columns])
    right = at.select(*keys, "_x", "_y", *[F.col(c).alias(f"r_{c}") for c in columns])
    return left.join(right, [*keys, "_x", "_y"]).where((F.col("l_row_id") != F.col("r_row_id")) & near).select(F.col("l_row_id").alias("a"), F.col("r_row_id").alias("b"))


def geographic(df: DataFrame, eps_metres: float, min_points: int, spheroid: bool = False) -> DataFrame:
    """``df`` (``row_id, lon, lat`` and more) with ``cluster_id``; noise is dropped.

    Distances are those on the sphere, or with ``spheroid`` on the WGS84 spheroid.
    """
    places = df.select("row_id", "lon", "lat")
    top = F.least(F.max(F.abs("lat")), F.lit(89.0))
    widest = places.agg(top).first()[0] or 0.0
    degrees = eps_metres / 1000.0 / (KM_DEGREE_SPHEROID if spheroid else KM_DEGREE)
    lon_step = F.lit(degrees) / F.cos(F.radians(F.lit(min(widest + degrees, 89.9))))
    ends = ("l_lon", "l_lat", "r_lon", "r_lat")
    near = (geo.spheroid_metres(*ends) if spheroid else geo.haversine_km(*ends) * 1000.0) <= eps_metres
    pairs = _buckets(places, [], F.lit(degrees), lon_step, near, ["row_id", "lon", "lat"])
    return df.join(labelled(places, pairs, min_points), "row_id")


def adaptive_thresholds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: deviations of step distance, speed and heading (to 6 places), as limits ``d, s, h``."""
    steps = statistics.step_distances(df, keys).select(*keys, F.round("std_km", 6).alias("d"))
    rest = df.groupBy(*keys).agg(F.round(F.stddev_pop("speed"), 6).alias("s"), F.round(F.stddev_pop("cog"), 6).alias("h"))
    return rest.join(steps, keys)


def trajectories(df: DataFrame, keys: list[str], min_points: int = 6, limits: DataFrame | None = None, d: float = 0.03, s: float = 3.0, h: float = 3.0) -> DataFrame:
    """Clusters of similar reports inside groups: near in place, speed and heading.

    ``limits`` gives ``d`` (km), ``s`` (knots) and ``h`` (degrees) per group; else the same ones hold for all.
    """
    rows = df.join(limits, keys) if limits is not None else df.withColumn("d", F.lit(d)).withColumn("s", F.lit(s)).withColumn("h", F.lit(h))
    rows = rows.select(*keys, "row_id", "lon", "lat", "speed", "cog", "d", "s", "h")
    return df.join(density.similar(rows, keys, min_points, components), "row_id")


def several_voyages(clusters: DataFrame, keys: list[str], more_than: int = 0) -> DataFrame:
    """Clusters that span two voyages at least, and have more than ``more_than`` members."""
    good = clusters.groupBy(*keys).agg(F.count_distinct("voyage_id").alias("_v"), F.count(F.lit(1)).alias("_n")).where((F.col("_v") > 1) & (F.col("_n") > more_than))
    return clusters.join(good.select(*keys), keys, "left_semi")


def hull_features(clusters: DataFrame) -> DataFrame:
    """Per cluster: heading and speed statistics (hulls are joined by ``hulls.convex``)."""
    return clusters.groupBy("cluster_id", "itinerary", "cell_id").agg(*statistics.spread("cog", "heading"), *statistics.spread("speed", "speed"))
