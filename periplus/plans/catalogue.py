"""Registry of the trajectory queries. Each runs over the whole ``events`` table of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periplus.functions import geo, polygons
from periplus.functions.grid import MEDITERRANEAN, PORTS
from periplus.operators import clustering, filters, folds, hulls, interpolation, partitioning, spatial_join, statistics, voyages
from periplus.operators.materialize import work_dir, written
from periplus.plans import files, oracles
from periplus.sources import fixture

#: Step of ``interpolate`` and ``interpolate_fill``, in seconds; the queries named ``_180s`` use the operator's default.
STEP = 3600


def _ais(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.ais(spark, sf)


def _with_port(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_join.lookup(_ais(spark, sf), fixture.ports(spark))


def _voyages(spark: SparkSession, sf: str) -> DataFrame:
    return voyages.voyages(_with_port(spark, sf))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return filters.in_grid(_voyages(spark, sf))


def _lagged(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("mmsi").orderBy("seconds", "row_id")
    for c in ("lon", "lat", "cog", "speed", "seconds"):
        df = df.withColumn(f"p_{c}", F.lag(c).over(order))
    return df.where(F.col("p_seconds").isNotNull())


def _r(c, n: int = 6) -> F.Column:
    """Rounded, without negative zero."""
    return F.round(c, n) + 0.0


# -- sources, grid, polygons ---------------------------------------------------------------------


def ais_positions(spark, sf):
    return _ais(spark, sf).select("row_id", "mmsi", "seconds", "lon", "lat", "cog", "speed", "ship_type")


def cell_assign(spark, sf):
    at = MEDITERRANEAN.cell_id(F.col("lon"), F.col("lat"))
    return _ais(spark, sf).select("row_id", at.alias("cell_id"), PORTS.cell_id(F.col("lon"), F.col("lat")).alias("fine_cell_id"))


def grid_cells(spark, sf):
    return MEDITERRANEAN.cells(spark)


def format_wkt(spark, sf):
    return fixture.ports(spark).select("id", polygons.format_wkt(F.col("ring")).alias("wkt"))


def parse_wkt(spark, sf):
    text = fixture.ports(spark).select("id", polygons.format_wkt(F.col("ring"), quoted=True).alias("wkt"))
    return text.select("id", F.posexplode(polygons.parse_wkt(F.col("wkt"))).alias("place", "p")).select("id", "place", "p.lon", "p.lat")


def polygon_area(spark, sf):
    return fixture.ports(spark).select("id", _r(polygons.area(F.col("ring"))).alias("area"))


# -- filters -------------------------------------------------------------------------------------


def stopped_filter(spark, sf):
    return filters.stopped(_ais(spark, sf)).select("row_id", "mmsi", "lon", "lat")


def shiptype_filter(spark, sf):
    return filters.of_ship_type(_ais(spark, sf), "Cargo").select("row_id", "mmsi", "ship_type")


def first_per_cell_vessel(spark, sf):
    return filters.first_per_cell(_ais(spark, sf)).select("row_id", "mmsi", "cell_id")


def unique_coords(spark, sf):
    return filters.unique_coordinates(_voyages(spark, sf)).select("row_id", "voyage_id")


# -- scalar functions ----------------------------------------------------------------------------


def haversine_steps(spark, sf):
    return _lagged(_ais(spark, sf)).select("row_id", _r(geo.haversine_km("p_lon", "p_lat", "lon", "lat")).alias("km"))


def spheroid_steps(spark, sf):
    return _lagged(_ais(spark, sf)).select("row_id", _r(geo.spheroid_metres("p_lon", "p_lat", "lon", "lat"), 3).alias("metres"))


def heading_diff(spark, sf):
    return _lagged(_ais(spark, sf)).select("row_id", geo.heading_difference("p_cog", "cog").alias("degrees"))


def turning_points(spark, sf):
    return _lagged(_ais(spark, sf)).where(geo.is_turning_point("p_cog", "cog", 90.0)).select("row_id", "mmsi")


def dead_reckoning(spark, sf):
    p = geo.dead_reckoning("speed", "cog", "lon", "lat", "seconds", F.col("seconds") + 600)
    return _ais(spark, sf).select("row_id", (p["lon"] + 0.0).alias("lon_600"), (p["lat"] + 0.0).alias("lat_600"))


def to_cartesian(spark, sf):
    p = geo.to_cartesian("lon", "lat")
    return _ais(spark, sf).select("row_id", *[_r(p[k]).alias(k) for k in "xyz"])


def to_geodetic(spark, sf):
    rows = _ais(spark, sf).select("row_id", geo.to_cartesian("lon", "lat").alias("p"))
    g = geo.to_geodetic("p.x", "p.y", "p.z")
    return rows.select("row_id", _r(g["lon"]).alias("lon"), _r(g["lat"]).alias("lat"))


def euclidean(spark, sf):
    rows = _lagged(_ais(spark, sf))
    return rows.select("row_id", _r(geo.euclidean_km("p_lon", "p_lat", "lon", "lat")).alias("chord_km"), _r(geo.planar_thousandths("p_lon", "p_lat", "lon", "lat")).alias("planar"))


def bearing(spark, sf):
    rows = _lagged(_ais(spark, sf))
    return rows.select("row_id", _r(geo.bearing("p_lon", "p_lat", "lon", "lat")).alias("degrees"), _r(geo.bearing("p_lon", "p_lat", "lon", "lat", signed=False)).alias("unsigned"))


def implied_speed(spark, sf):
    rows = _lagged(_ais(spark, sf))
    return rows.select("row_id", _r(geo.implied_knots(geo.haversine_km("p_lon", "p_lat", "lon", "lat"), F.col("seconds") - F.col("p_seconds"))).alias("knots"))


def similar_steps(spark, sf):
    """Whether a report is similar to the one before it (0) or not (1), with its parts."""
    apart = geo.ais_similarity("p_lon", "p_lat", "p_speed", "p_cog", "lon", "lat", "speed", "cog", 20.0, 12.0, 90.0)
    return _lagged(_ais(spark, sf)).select("row_id", apart.alias("apart"), _r(geo.longitude_difference("p_lon", "lon")).alias("lon_apart"), geo.truncated("speed").alias("whole_knots"))


def lagrange3(spark, sf):
    order = Window.partitionBy("mmsi").orderBy("seconds", "row_id")
    rows = _ais(spark, sf)
    for name, f in (("1", F.lag), ("3", F.lead)):
        rows = rows.withColumn(f"lon{name}", f("lon").over(order)).withColumn(f"lat{name}", f("lat").over(order))
    mid = (F.col("lon") + F.col("lon3")) / 2
    return rows.select("row_id", geo.lagrange3("lon1", "lat1", "lon", "lat", "lon3", "lat3", mid).alias("lat_mid")).where(F.col("lat_mid").isNotNull())


# -- joins ---------------------------------------------------------------------------------------


def pip_waypoint_lookup(spark, sf):
    return _with_port(spark, sf).select("row_id", "port")


def pip_semi(spark, sf):
    return spatial_join.inside(_ais(spark, sf), fixture.ports(spark)).select("row_id", "mmsi")


def pip_anti(spark, sf):
    return spatial_join.outside(_ais(spark, sf), fixture.ports(spark)).select("row_id", "mmsi")


# -- voyages -------------------------------------------------------------------------------------


def gap_flags(spark, sf):
    return voyages.gaps(_ais(spark, sf)).select("row_id", "since", "is_gap")


def voyage_positions(spark, sf):
    s = voyages.segments(_with_port(spark, sf))
    return s.select("row_id", "mmsi", "voyage_seq", "prev_port", "arrive")


def voyage_segments(spark, sf):
    return _voyages(spark, sf).select("row_id", "mmsi", "voyage_id", "itinerary", "seconds", "lon", "lat")


def voyage_summary(spark, sf):
    return _voyages(spark, sf).groupBy("voyage_id", "itinerary").agg(F.count(F.lit(1)).alias("positions"), F.min("seconds").alias("start_s"), F.max("seconds").alias("end_s"))


def voyages_stream(spark, sf):
    """The streaming form over the same reports; all that has arrived is processed, then the result is read."""
    from periplus.streaming import voyages as streamed

    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    rows = written(_with_port(spark, sf).select("mmsi", "row_id", "seconds", "lon", "lat", "cog", "speed", "port"), "reports")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{work_dir(spark)}/{path.rsplit('/', 1)[1]}-voyages"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    try:
        stream = spark.readStream.schema(rows.schema).parquet(path)
        q = streamed.segment(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(streamed.OUTPUT).parquet(out).select("row_id", "mmsi", "voyage_id", "itinerary", "seconds", "lon", "lat")


def _new_points(spark, sf, step):
    new = interpolation.interpolated(_voyages(spark, sf), fixture.ports(spark), step)
    return new.select("voyage_id", "seconds", "k", "lon", "lat", _r("knots", 4).alias("knots"), _r("bearing", 4).alias("bearing"))


def _filled(spark, sf, step):
    out = interpolation.fill(_voyages(spark, sf), fixture.ports(spark), step)
    return out.groupBy("voyage_id").agg(F.count(F.lit(1)).alias("positions"), F.sum(F.col("is_interpolated").cast("bigint")).alias("interpolated"))


def interpolate(spark, sf):
    return _new_points(spark, sf, STEP)


def interpolate_fill(spark, sf):
    return _filled(spark, sf, STEP)


def interpolate_180s(spark, sf):
    return _new_points(spark, sf, interpolation.STEP_SECONDS)


def interpolate_fill_180s(spark, sf):
    return _filled(spark, sf, interpolation.STEP_SECONDS)


# -- statistics ----------------------------------------------------------------------------------


def _spread(prefix=("heading", "speed")):
    return [_r(f"{a}_{b}").alias(f"{a}_{b}") for b in prefix for a in ("mean", "std", "min", "max")]


def cell_stats(spark, sf):
    return statistics.cell_statistics(_cells(spark, sf)).select("key", "itinerary", "cell_id", *_spread())


def step_distance_stats(spark, sf):
    return statistics.step_distances(_cells(spark, sf), ["itinerary", "cell_id"]).select("itinerary", "cell_id", _r("mean_km").alias("mean_km"), _r("std_km").alias("std_km"))


def cluster_stats_quadrant(spark, sf):
    out = statistics.cluster_statistics(_voyages(spark, sf), ["itinerary"])
    return out.select("itinerary", "start_lon", "start_lat", "end_lon", "end_lat", *[_r(c).alias(c) for c in ("avg_cog", "avg_speed", "speed_deviation", "cog_deviation")])


def cluster_endpoints(spark, sf):
    out = statistics.endpoint_rows(statistics.cluster_statistics(_voyages(spark, sf), ["itinerary"]), "itinerary")
    return out.select("id", "place", "latitude", "longitude", *[_r(c).alias(c) for c in ("avgheading", "avgspeed", "speeddeviation", "headingdeviation")])


def circular_stats(spark, sf):
    return _voyages(spark, sf).groupBy("itinerary").agg(_r(F.sum(F.sin(F.radians("cog"))), 5).alias("sum_sin"), _r(geo.circular_std("cog"), 4).alias("circular_std"))


def vessel_voyage_counts(spark, sf):
    return statistics.vessel_and_voyage_counts(_voyages(spark, sf))


def key_counts(spark, sf):
    return statistics.key_counts(_ais(spark, sf), "mmsi")


def balanced_partition(spark, sf):
    rows = partitioning.balanced(_ais(spark, sf).select("mmsi", "row_id"), "mmsi", 8)
    rows = rows.select("mmsi", F.spark_partition_id().alias("p"))
    return rows.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("partitions"))


# -- clustering and hulls ------------------------------------------------------------------------


def _stops(spark, sf):
    return filters.first_per_cell(filters.stopped(_ais(spark, sf)))


def dbscan_labels(spark, sf):
    return clustering.geographic(_stops(spark, sf), 2000.0, 3).select("row_id", "cluster_id")


def dbscan_spheroid(spark, sf):
    return clustering.geographic(_stops(spark, sf), 2000.0, 3, spheroid=True).select("row_id", "cluster_id")


def waypoints(spark, sf):
    """Ports discovered from stops: clusters, with dense ids in the order of their names."""
    found = clustering.geographic(_stops(spark, sf), 2000.0, 3)
    return found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), _r(F.min("lon")).alias("west"), _r(F.max("lon")).alias("east")).select(
        (F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("bigint").alias("id"), "cluster_id", "members", "west", "east"
    )


def waypoint_hulls(spark, sf):
    found = clustering.geographic(_stops(spark, sf), 2000.0, 3)
    return hulls.convex(found, ["cluster_id"]).select("cluster_id", polygons.format_wkt(F.col("ring")).alias("polygon"))


_KEYS = ["itinerary", "cell_id"]


def _trajectories(spark, sf):
    cells = written(_cells(spark, sf), "cells")
    return clustering.trajectories(cells, _KEYS, 3, clustering.adaptive_thresholds(cells, _KEYS))


def traj_clusters(spark, sf):
    return _trajectories(spark, sf).select("row_id", "itinerary", "cell_id", "cluster_id")


def route_clusters(spark, sf):
    """Clusters with the same limits everywhere (0.03 as radius there means similarity alone)."""
    return clustering.trajectories(written(_voyages(spark, sf), "voyages"), [], 5, None, 5.0, 10.0, 60.0).select("row_id", "cluster_id")


def hull_features(spark, sf):
    good = clustering.several_voyages(_trajectories(spark, sf), ["cluster_id"])
    return clustering.hull_features(good).select("cluster_id", *_KEYS, *_spread())


def hull_rows(spark, sf):
    """Hull features with the hull as WKT."""
    good = written(clustering.several_voyages(_trajectories(spark, sf), ["cluster_id"]), "clusters")
    shape = hulls.convex(good, ["cluster_id"]).select("cluster_id", polygons.format_wkt(F.col("ring")).alias("polygon"))
    return clustering.hull_features(good).join(shape, "cluster_id").select("cluster_id", *_KEYS, *_spread(), "polygon")


def itinerary_clusters(spark, sf):
    """Per itinerary: clusters of several voyages and more than ten members, with statistics and hull."""
    found = clustering.trajectories(written(_voyages(spark, sf), "voyages"), ["itinerary"], 5, None, 10.0, 20.0, 90.0)
    good = written(clustering.several_voyages(found, ["itinerary", "cluster_id"], 10), "itinerary-clusters")
    shape = hulls.convex(good, ["itinerary", "cluster_id"]).select("itinerary", "cluster_id", polygons.format_wkt(F.col("ring")).alias("polygon"))
    stats = statistics.cluster_statistics(good, ["itinerary", "cluster_id"]).join(shape, ["itinerary", "cluster_id"])
    means = [_r(c).alias(c) for c in ("avg_cog", "avg_speed", "speed_deviation", "cog_deviation")]
    return stats.select("itinerary", "cluster_id", "start_lon", "start_lat", "end_lon", "end_lat", *means, "polygon")


def convex_hull_vertices(spark, sf):
    """Boxes and areas of the hulls of all itineraries, and the hulls."""
    ring = hulls.convex(_voyages(spark, sf), ["itinerary"])
    west, south, east, north = polygons.bounds(F.col("ring"))
    return ring.select("itinerary", F.size("ring").alias("points"), west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), polygons.format_wkt(F.col("ring")).alias("polygon"))


def hull_bounds(spark, sf):
    ring = hulls.convex(_voyages(spark, sf), ["itinerary"])
    west, south, east, north = polygons.bounds(F.col("ring"))
    return ring.select("itinerary", west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def concave_hull(spark, sf):
    return hulls.concave(_voyages(spark, sf), ["itinerary"]).select("itinerary", polygons.format_wkt(F.col("ring")).alias("polygon"))


def kfold_split(spark, sf):
    return folds.split(_voyages(spark, sf))


def kfold_rows(spark, sf):
    return folds.rows(folds.split(_voyages(spark, sf)))


def _accuracy(positions, shapes):
    out = folds.accuracy(positions, shapes, folds.split(positions))
    return out.select("fold", _r("accuracy").alias("accuracy"), _r("std").alias("std"))


def hull_accuracy(spark, sf):
    """Convex hulls of itineraries, over all positions."""
    v = written(_voyages(spark, sf), "voyages")
    return _accuracy(v, hulls.convex(v, ["itinerary"]))


def box_accuracy(spark, sf):
    """The same with the itineraries' boxes."""
    v = written(_voyages(spark, sf), "voyages")
    shapes = v.groupBy("itinerary").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    p = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    shapes = shapes.select("itinerary", F.array(p("w", "s"), p("e", "s"), p("e", "n"), p("w", "n"), p("w", "s")).alias("ring"))
    return _accuracy(v, shapes)


NAMES = (
    "ais_positions cell_assign grid_cells format_wkt parse_wkt polygon_area stopped_filter shiptype_filter first_per_cell_vessel unique_coords "
    "haversine_steps spheroid_steps heading_diff turning_points dead_reckoning to_cartesian to_geodetic euclidean bearing implied_speed similar_steps lagrange3 "
    "pip_waypoint_lookup pip_semi pip_anti gap_flags voyage_positions voyage_segments voyage_summary voyages_stream interpolate interpolate_fill interpolate_180s interpolate_fill_180s "
    "cell_stats step_distance_stats cluster_stats_quadrant cluster_endpoints circular_stats vessel_voyage_counts key_counts balanced_partition "
    "dbscan_labels dbscan_spheroid waypoints waypoint_hulls traj_clusters route_clusters hull_features hull_rows itinerary_clusters convex_hull_vertices hull_bounds concave_hull "
    "kfold_split kfold_rows hull_accuracy box_accuracy"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES} | {name: getattr(files, name) for name in files.NAMES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
