"""Whole jobs from files to files: ports, voyages, gap filling, hulls, cell statistics, routes, accuracy.

Each writes CSV with a header, which the next one's reader takes as it is.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periplus.functions.grid import MEDITERRANEAN, PORTS, Grid
from periplus.operators import clustering, filters, folds, hulls, interpolation, spatial_join, statistics, voyages
from periplus.operators.materialize import written
from periplus.sources import ais

CELL = ["itinerary", "cell_id"]


def numbered(df: DataFrame) -> DataFrame:
    """Reports with a stable ``row_id``, in file order: written once, so that it stays the same."""
    return written(df.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def discover_ports(spark: SparkSession, raw: str, out: str, ship_type: str = "Cargo", eps: float = 2000.0, min_points: int = 10, grid: Grid = PORTS) -> DataFrame:
    """Hulls of clusters of stops, numbered from 0."""
    stops = filters.first_per_cell(filters.stopped(filters.of_ship_type(numbered(ais.read_positions(spark, raw)), ship_type)), grid)
    found = clustering.geographic(stops, eps, min_points)
    shapes = hulls.convex(found, ["cluster_id"])
    ports = shapes.select((F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("int").alias("id"), "ring")
    ais.write_polygons(ports, out)
    return ais.read_polygons(spark, out)


def segment_voyages(spark: SparkSession, raw: str, ports: str, out: str, ship_type: str = "Cargo", grid: Grid = MEDITERRANEAN) -> DataFrame:
    reports = filters.of_ship_type(numbered(ais.read_positions(spark, raw)), ship_type)
    result = voyages.voyages(spatial_join.lookup(reports, ais.read_polygons(spark, ports), grid))
    ais.write_positions(result, out)
    return result


def fill_gaps(spark: SparkSession, voyage_files: str, ports: str, out: str, step: int = interpolation.STEP_SECONDS) -> DataFrame:
    result = interpolation.fill(numbered(ais.read_voyages(spark, voyage_files)), ais.read_polygons(spark, ports), step)
    ais.write_positions(result.sortWithinPartitions("voyage_id", "seconds", "is_interpolated"), out)
    return result


def cluster_hulls(spark: SparkSession, voyage_files: str, out: str, min_points: int = 6, grid: Grid = MEDITERRANEAN) -> DataFrame:
    """Per cluster of an (itinerary, cell): statistics and hull, by that group's own limits."""
    rows = written(filters.in_grid(numbered(ais.read_voyages(spark, voyage_files)), grid), "cells")
    found = clustering.trajectories(rows, CELL, min_points, clustering.adaptive_thresholds(rows, CELL))
    good = written(clustering.several_voyages(found, ["cluster_id"]), "clusters")
    result = clustering.hull_features(good).join(hulls.convex(good, ["cluster_id"]), "cluster_id")
    ais.write_table(result, out)
    return result


def cell_statistics(spark: SparkSession, voyage_files: str, ports: str, out: str, grid: Grid = MEDITERRANEAN) -> DataFrame:
    rows = spatial_join.outside(ais.read_voyages(spark, voyage_files), ais.read_polygons(spark, ports), grid)
    result = statistics.cell_statistics(filters.in_grid(rows, grid))
    ais.write_table(result, out)
    return result


def route_clusters(spark: SparkSession, raw: str, members: str, stats: str, d: float = 0.03, s: float = 3.0, h: float = 3.0, min_points: int = 10) -> DataFrame:
    """Clusters of similar reports over a whole file; members and their start and end rows are appended."""
    found = written(clustering.trajectories(numbered(ais.read_positions(spark, raw)), [], min_points, None, d, s, h), "routes")
    ais.write_positions(found, members, mode="append")
    ais.write_table(statistics.endpoint_rows(statistics.cluster_statistics(found, ["cluster_id"])), stats, mode="append")
    return found


def itinerary_clusters(spark: SparkSession, voyage_files: str, ports: str, out: str | None = None, min_points: int = 5, members: int = 10) -> DataFrame:
    """Per itinerary, clusters of several voyages outside ports: hull, start, end, means and deviations."""
    rows = spatial_join.outside(numbered(ais.read_voyages(spark, voyage_files)), ais.read_polygons(spark, ports))
    found = clustering.trajectories(rows, ["itinerary"], min_points)
    keys = ["itinerary", "cluster_id"]
    good = written(clustering.several_voyages(found, keys, members), "itinerary-clusters")
    result = statistics.cluster_statistics(good, keys).join(hulls.convex(good, keys), keys)
    if out:
        ais.write_table(result, out)
    return result


def hull_accuracy(spark: SparkSession, voyage_files: str, out: str, n: int = 10) -> DataFrame:
    """Share of the test folds' positions inside the other folds' hulls."""
    rows = numbered(ais.read_voyages(spark, voyage_files))
    result = folds.accuracy(rows, hulls.convex(rows, ["itinerary"]), folds.split(rows, n), n)
    ais.write_table(result, out)
    return result


JOBS = {"ports": discover_ports, "voyages": segment_voyages, "fill": fill_gaps, "hulls": cluster_hulls, "cells": cell_statistics, "routes": route_clusters, "itineraries": itinerary_clusters, "accuracy": hull_accuracy}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("paths", nargs="+", help="the job's paths, in order")
    args = parser.parse_args()
    JOBS[args.job](SparkSession.builder.appName(f"periplus-{args.job}").getOrCreate(), *args.paths)


if __name__ == "__main__":
    main()
