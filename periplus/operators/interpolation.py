"""Filling gaps in voyages with a quadratic through three reports, in closed form per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periplus.functions import geo
from periplus.operators import filters, spatial_join
from periplus.sources.ais import wall_clock

STEP_SECONDS = 180


def interpolated(voyages: DataFrame, ports: DataFrame, step: int = STEP_SECONDS, compat: bool = False) -> DataFrame:
    """Only the new positions, with the untruncated ``knots`` and ``bearing`` they were computed from.

    Between the second and third report of each three, if they are more than two steps and some
    longitude apart, n - 1 points are set, n being their time apart in steps less one. Longitudes go
    from the second towards the third (always eastwards with ``compat``); a frame in which two
    longitudes agree sets none. Points inside a port are left out.
    """
    order = Window.partitionBy("voyage_id").orderBy("seconds", "row_id")
    clean = spatial_join.outside(filters.unique_coordinates(voyages), ports)
    f = clean
    for name, column in (("1", F.lag), ("3", F.lead)):
        for c in ("lon", "lat", "seconds"):
            f = f.withColumn(f"{c}{name}", column(c).over(order))
    f = f.where(F.col("lon1").isNotNull() & F.col("lon3").isNotNull())
    apart = F.col("seconds3") - F.col("seconds")
    f = f.where((apart > 2 * step) & (F.col("lon3") != F.col("lon")) & (F.col("lon1") != F.col("lon")) & (F.col("lon1") != F.col("lon3")))
    f = f.withColumn("n", (F.floor(apart / step) - 1).cast("bigint")).where("n >= 2")
    distance = geo.longitude_difference("lon", "lon3") if compat else F.col("lon3") - F.col("lon")
    f = f.withColumn("inc", F.try_divide(distance, F.col("n").cast("double"))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)))
    at = lambda lon: geo.lagrange3("lon1", "lat1", "lon", "lat", "lon3", "lat3", lon)
    f = f.withColumn("lon_k", F.col("lon") + F.col("k") * F.col("inc")).withColumn("lat_k", at(F.col("lon_k")))
    lon_before = F.when(F.col("k") == 1, F.col("lon")).otherwise(F.col("lon") + (F.col("k") - 1) * F.col("inc"))
    f = f.withColumn("lon_p", lon_before).withColumn("lat_p", F.when(F.col("k") == 1, F.col("lat")).otherwise(at(F.col("lon_p"))))
    f = f.withColumn("knots", geo.implied_knots(geo.haversine_km("lon_p", "lat_p", "lon_k", "lat_k"), F.lit(float(step))))
    f = f.withColumn("bearing", geo.bearing("lon_p", "lat_p", "lon_k", "lat_k", signed=not compat))
    f = f.withColumn("cog", geo.truncated("bearing")).withColumn("heading", F.col("cog")).withColumn("speed", geo.truncated("knots", 1))
    f = f.withColumn("lon", F.col("lon_k")).withColumn("lat", F.col("lat_k")).withColumn("seconds", (F.col("seconds") + F.col("k") * step).cast("bigint"))
    if "timestamp" in voyages.columns:
        f = f.withColumn("timestamp", wall_clock(F.col("seconds")))
    f = f.select(*voyages.columns, "k", "knots", "bearing")
    return spatial_join.outside(f, ports)


def fill(voyages: DataFrame, ports: DataFrame, step: int = STEP_SECONDS, compat: bool = False) -> DataFrame:
    """All reports and the new positions, flagged ``is_interpolated``; order within a voyage is by seconds."""
    new = interpolated(voyages, ports, step, compat).select(*voyages.columns).withColumn("is_interpolated", F.lit(True))
    return voyages.withColumn("is_interpolated", F.lit(False)).unionByName(new)
