"""Statistics of motion per group; all aggregate partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periplus.functions import geo


def spread(column: str, name: str) -> list[Column]:
    return [F.avg(column).alias(f"mean_{name}"), F.stddev_pop(column).alias(f"std_{name}"), F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}")]


def cell_statistics(df: DataFrame) -> DataFrame:
    """Per ``itinerary, cell_id``: mean, deviation, least and largest course and speed."""
    out = df.groupBy("itinerary", "cell_id").agg(*spread("cog", "heading"), *spread("speed", "speed"))
    return out.withColumn("key", F.concat_ws("-", "itinerary", F.col("cell_id").cast("string")))


def step_distances(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: mean and deviation of the distance between consecutive reports; 0 for a single one."""
    order = Window.partitionBy(*keys).orderBy("voyage_id", "seconds", "row_id")
    km = geo.haversine_km(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    out = df.withColumn("_km", km).groupBy(*keys).agg(F.avg("_km").alias("mean_km"), F.stddev_pop("_km").alias("std_km"))
    return out.withColumn("mean_km", F.coalesce("mean_km", F.lit(0.0))).withColumn("std_km", F.coalesce("std_km", F.lit(0.0)))


def cluster_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster: means, deviations, and start and end by the quadrant of the mean course."""
    g = df.groupBy(*keys).agg(
        F.avg("cog").alias("avg_cog"), F.avg("speed").alias("avg_speed"), F.stddev_pop("speed").alias("speed_deviation"), F.stddev_pop("cog").alias("cog_deviation"),
        F.min("lon").alias("_w"), F.max("lon").alias("_e"), F.min("lat").alias("_s"), F.max("lat").alias("_n"),
    )
    c = F.col("avg_cog")
    q = F.when((c >= 0) & (c <= 90), 1).when((c > 90) & (c <= 180), 2).when((c > 180) & (c <= 270), 3).otherwise(4)
    pick = lambda a, b, d, e: F.when(q == 1, F.col(a)).when(q == 2, F.col(b)).when(q == 3, F.col(d)).otherwise(F.col(e))
    return g.select(
        *keys,
        pick("_w", "_w", "_e", "_e").alias("start_lon"), pick("_s", "_n", "_n", "_s").alias("start_lat"),
        pick("_e", "_e", "_w", "_w").alias("end_lon"), pick("_n", "_s", "_s", "_n").alias("end_lat"),
        "avg_cog", "avg_speed", "speed_deviation", "cog_deviation",
    )


def endpoint_rows(stats: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Two rows per cluster, start and end, in the columns of the statistics file."""
    row = lambda p: F.struct(F.col(f"{p}_lat").alias("latitude"), F.col(f"{p}_lon").alias("longitude"))
    out = stats.select(key, F.posexplode(F.array(row("start"), row("end"))).alias("place", "p"), "avg_cog", "avg_speed", "speed_deviation", "cog_deviation")
    return out.select(F.col(key).alias("id"), "place", "p.latitude", "p.longitude", F.col("avg_cog").alias("avgheading"), F.col("avg_speed").alias("avgspeed"), F.col("speed_deviation").alias("speeddeviation"), F.col("cog_deviation").alias("headingdeviation"))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def vessel_and_voyage_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("itinerary").agg(F.count_distinct("mmsi").alias("vessels"), F.count_distinct("voyage_id").alias("voyages"), F.count(F.lit(1)).alias("positions"))
