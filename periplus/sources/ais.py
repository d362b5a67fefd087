"""Readers and writers of vessel reports, voyages, polygons, grids and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periplus.functions import polygons

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

_S = T.StringType()
#: Columns of a raw file, in order. Everything is read as text and cast by rule.
RAW = T.StructType([T.StructField(c, _S) for c in ("MMSI", "IMO", "LATITUDE", "LONGITUDE", "COG", "HEADING", "SOG", "TIMESTAMP", "NAME", "SHIP_TYPE", "DESTINATION", "ANNOTATION")])
VOYAGE_RAW = T.StructType([T.StructField("VOYAGE_ID", _S), T.StructField("ITINERARY", _S), *RAW.fields])


def epoch_seconds(column: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, as UTC whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def wall_clock(seconds: Column) -> Column:
    """Text of epoch seconds in the files' format, as UTC whatever the session's zone is."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).cast("string")


def positions(raw: DataFrame, rounded: bool = False) -> DataFrame:
    """Typed reports: NULL rules, tenths of a knot to knots, epoch seconds.

    ``imo`` NULL is -1, ``heading`` NULL is 0, a missing ``annotation`` is "NULL"; ``rounded`` rounds course,
    heading and speed to 6 places. What cannot be read is null.
    """
    number = lambda c: F.when(F.col(c) != "NULL", F.col(c)).try_cast("double")
    keep = (lambda c: F.round(c, 6)) if rounded else (lambda c: c)
    time = F.try_to_timestamp(F.col("TIMESTAMP"), F.lit(TIME_FORMAT)).cast("timestamp_ntz")
    return raw.select(
        *[c for c in raw.columns if c in ("voyage_id", "itinerary")],
        F.col("MMSI").try_cast("int").alias("mmsi"),
        F.when(F.col("IMO") == "NULL", -1).otherwise(F.col("IMO").try_cast("int")).alias("imo"),
        F.col("LATITUDE").try_cast("double").alias("lat"),
        F.col("LONGITUDE").try_cast("double").alias("lon"),
        keep(number("COG")).alias("cog"),
        keep(F.when(F.col("HEADING") == "NULL", 0.0).otherwise(number("HEADING"))).alias("heading"),
        keep(number("SOG") / 10.0).alias("speed"),
        epoch_seconds(time).alias("seconds"),
        F.col("TIMESTAMP").alias("timestamp"),
        F.col("NAME").alias("shipname"),
        F.col("SHIP_TYPE").alias("ship_type"),
        F.col("DESTINATION").alias("destination"),
        F.coalesce("ANNOTATION", F.lit("NULL")).alias("annotation"),
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Raw reports from CSV with a header (11 or 12 columns)."""
    return positions(spark.read.schema(RAW).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE"))


def stream_positions(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files that arrive in a folder."""
    return positions(spark.readStream.schema(RAW).csv(path, header=True))


def read_voyages(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(VOYAGE_RAW).csv(path, header=True)
    return positions(raw.withColumnsRenamed({"VOYAGE_ID": "voyage_id", "ITINERARY": "itinerary"}), rounded=True)


def as_records(df: DataFrame) -> DataFrame:
    """Reports in the columns of the files: speed in tenths of a knot again, no epoch seconds."""
    lead = [F.col(c).alias(c.upper()) for c in ("voyage_id", "itinerary", "cluster_id", "cell_id") if c in df.columns]
    names = dict(zip(("mmsi", "imo", "lat", "lon", "cog", "heading", "speed", "timestamp", "shipname", "ship_type", "destination", "annotation"), RAW.names))
    return df.select(*lead, *[(F.col(c) * 10.0 if c == "speed" else F.col(c)).alias(n) for c, n in names.items() if c in df.columns])


def write_positions(df: DataFrame, path: str, mode: str = "error") -> None:
    """Reports, voyages or cluster members as CSV with a header."""
    as_records(df).write.mode(mode).csv(path, header=True)


def read_polygons(spark: SparkSession, path: str, hulls: bool = False) -> DataFrame:
    """``id, ring`` of ports (``ID,POLYGON``), or ``id, itinerary, ring`` of hulls."""
    names = ["ID", "ITINERARY", "POLYGON"] if hulls else ["ID", "POLYGON"]
    raw = spark.read.schema(T.StructType([T.StructField(c, _S) for c in names])).csv(path, header=True)
    ids = F.col("ID") if hulls else F.col("ID").try_cast("int")
    return raw.select(ids.alias("id"), *([F.col("ITINERARY").alias("itinerary")] if hulls else []), polygons.parse_wkt(F.col("POLYGON")).alias("ring"))


def write_polygons(df: DataFrame, path: str, mode: str = "error") -> None:
    lead = [F.col(c).alias(c.upper()) for c in df.columns if c != "ring"]
    df.select(*lead, polygons.format_wkt(F.col("ring")).alias("POLYGON")).write.mode(mode).csv(path, header=True)


def write_wkt(df: DataFrame, path: str, mode: str = "error") -> None:
    """One polygon per line of text."""
    df.select(polygons.format_wkt(F.col("ring"), quoted=True).alias("value")).write.mode(mode).text(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ID bigint, LONGITUDE double, LATITUDE double").csv(path, header=True).toDF("cell_id", "lon", "lat")


def write_grid(cells: DataFrame, path: str, mode: str = "error") -> None:
    cells.select(F.col("cell_id").alias("ID"), F.col("lon").alias("LONGITUDE"), F.col("lat").alias("LATITUDE")).write.mode(mode).csv(path, header=True)


def write_table(df: DataFrame, path: str, mode: str = "error", fmt: str = "csv") -> None:
    """Statistics, hull features or accuracies, with named columns; rings go out as WKT."""
    out = df.select(*[polygons.format_wkt(F.col(c)).alias("POLYGON") if c == "ring" else F.col(c).alias(c.upper()) for c in df.columns])
    writer = out.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
