"""Queries that write a table as a file of the readers' formats and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periplus.functions import polygons
from periplus.functions.grid import MEDITERRANEAN
from periplus.operators import filters, hulls, spatial_join, statistics, voyages
from periplus.operators.materialize import work_dir
from periplus.sources import ais, fixture

_READ = ("mmsi", "imo", "lat", "lon", "cog", "heading", "speed", "seconds", "timestamp", "shipname", "ship_type", "destination", "annotation")


def _path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _voyages(spark: SparkSession, sf: str) -> DataFrame:
    found = voyages.voyages(spatial_join.lookup(fixture.ais(spark, sf), fixture.ports(spark)))
    return found.withColumn("timestamp", ais.wall_clock(F.col("seconds")))


def _raw(spark: SparkSession, sf: str) -> str:
    """A written folder of raw reports: some numbers unknown, some notes missing, texts with commas."""
    row = F.col("row_id")
    df = fixture.ais(spark, sf).withColumns({
        "imo": F.when(row % 3 == 0, "NULL").otherwise(row.cast("string")),
        "heading": F.when(row % 5 == 0, "NULL").otherwise(F.col("heading").cast("string")),
        "timestamp": ais.wall_clock(F.col("seconds")),
        "destination": F.concat(F.lit("bound, "), row.cast("string")),
        "annotation": F.when(row % 7 != 0, "note"),
    })
    path = _path(spark, "raw")
    ais.write_positions(df, path)
    return path


def _typed(df: DataFrame) -> DataFrame:
    wide = {c: F.col(c).cast("bigint") for c in ("mmsi", "imo")} | {"speed": F.round("speed", 6) + 0.0}
    return df.withColumns(wide).select(*_READ)


def positions_file(spark, sf):
    return _typed(ais.read_positions(spark, _raw(spark, sf)))


def positions_file_stream(spark, sf):
    """The same files as a stream; all that has arrived is read, then the result."""
    out = _path(spark, "streamed")
    stream = _typed(ais.stream_positions(spark, _raw(spark, sf)))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def voyages_file(spark, sf):
    path = _path(spark, "voyages")
    ais.write_positions(_voyages(spark, sf), path)
    out = ais.read_voyages(spark, path)
    return out.select("voyage_id", "itinerary", F.col("mmsi").cast("bigint").alias("mmsi"), "seconds", "lon", "lat", "cog", "heading", "speed")


def _points(shapes: DataFrame, *lead: str) -> DataFrame:
    return shapes.select(*lead, F.posexplode("ring").alias("place", "p")).select(*lead, "place", "p.lon", "p.lat")


def ports_file(spark, sf):
    path = _path(spark, "ports")
    ais.write_polygons(fixture.ports(spark), path)
    return _points(ais.read_polygons(spark, path), "id")


def hulls_file(spark, sf):
    path = _path(spark, "hulls")
    shapes = hulls.convex(_voyages(spark, sf), ["itinerary"])
    ais.write_polygons(shapes.select(F.concat(F.lit("hull "), "itinerary").alias("id"), "itinerary", "ring"), path)
    return _points(ais.read_polygons(spark, path, hulls=True), "id", "itinerary")


def grid_file(spark, sf):
    path = _path(spark, "grid")
    ais.write_grid(MEDITERRANEAN.cells(spark), path)
    return ais.read_grid(spark, path)


def wkt_file(spark, sf):
    """One polygon a line, read as text and parsed again."""
    path = _path(spark, "wkt")
    ais.write_wkt(fixture.ports(spark), path)
    lines = spark.read.text(path)
    area = F.round(polygons.area(polygons.parse_wkt(F.col("value"))), 6) + 0.0
    return lines.select(F.col("value").alias("line"), area.alias("area"))


def cell_members_file(spark, sf):
    """Members of cells, written in two parts by appending."""
    path = _path(spark, "members")
    cells = filters.in_grid(_voyages(spark, sf))
    for part in (0, 1):
        ais.write_positions(cells.where(F.col("cell_id") % 2 == part), path, mode="append")
    out = spark.read.csv(path, header=True)
    return out.select(F.col("VOYAGE_ID").alias("voyage_id"), F.col("CELL_ID").cast("bigint").alias("cell_id"), F.col("LONGITUDE").cast("double").alias("lon"), F.col("LATITUDE").cast("double").alias("lat"), F.col("TIMESTAMP").alias("timestamp"))


def cell_stats_file(spark, sf):
    """Statistics of cells, written in two parts by appending."""
    path = _path(spark, "statistics")
    stats = statistics.cell_statistics(filters.in_grid(_voyages(spark, sf)))
    numbers = [f"{a}_{b}" for b in ("heading", "speed") for a in ("mean", "std", "min", "max")]
    stats = stats.select("key", "itinerary", "cell_id", *[(F.round(c, 6) + 0.0).alias(c) for c in numbers])
    for part in (0, 1):
        ais.write_table(stats.where(F.col("cell_id") % 2 == part), path, mode="append")
    return spark.read.schema(stats.schema).csv(path, header=True).toDF(*stats.columns)


NAMES = ("positions_file", "positions_file_stream", "voyages_file", "ports_file", "hulls_file", "grid_file", "wkt_file", "cell_members_file", "cell_stats_file")
