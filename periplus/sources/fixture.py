"""Vessel reports and ports derived from the test tables, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periplus.sources.ais import epoch_seconds


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per event; each user is a vessel that shuttles along its lane."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    u = F.col("user_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.withColumn("k", k.cast("bigint")).withColumn("ph", (F.col("k") * (3 + u % 5) + u * 7) % 40)
    tri = F.when(F.col("ph") < 20, F.col("ph")).otherwise(40 - F.col("ph"))
    e = e.withColumn("tri", tri)
    cog = ((F.col("event_id") * 37) % 360).cast("double")
    speed = F.when(F.col("tri").isin(0, 20), 0.0).otherwise((F.floor(F.col("value") * 100) % 300) / 10.0)
    return e.select(
        F.col("event_id").alias("row_id"),
        u.alias("mmsi"),
        epoch_seconds(F.col("ts")).alias("seconds"),
        ((-700 + (u % 20) * 200 + F.col("tri") * 5) / 100.0).alias("lon"),
        ((3000 + (u % 15) * 100 + (F.col("k") * F.col("k") + u) % 7) / 100.0).alias("lat"),
        cog.alias("cog"),
        cog.alias("heading"),
        speed.alias("speed"),
        F.element_at(F.array(F.lit("Cargo"), F.lit("Tanker"), F.lit("Passenger")), (u % 3 + 1).cast("int")).alias("ship_type"),
        F.lit(-1).alias("imo"),
        F.concat(F.lit("VESSEL "), u.cast("string")).alias("shipname"),
        F.lit("NULL").alias("destination"),
        F.lit("NULL").alias("annotation"),
    )


def ports(spark: SparkSession) -> DataFrame:
    """Two rectangles per lane: ``id int, ring``."""
    lane = F.col("id")
    x, y = -700 + (lane % 20) * 200, 3000 + (lane % 15) * 100
    box = lambda dx: F.array(*[F.struct(((x + a + dx) / 100.0).alias("lon"), ((y + b) / 100.0).alias("lat")) for a, b in ((-2, -2), (12, -2), (12, 8), (-2, 8), (-2, -2))])
    both = F.array(F.struct((2 * lane).cast("int").alias("id"), box(0).alias("ring")), F.struct((2 * lane + 1).cast("int").alias("id"), box(90).alias("ring")))
    return spark.range(60).select(F.explode(both).alias("p")).select("p.id", "p.ring")
