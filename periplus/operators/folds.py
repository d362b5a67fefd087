"""K folds of itineraries, and the accuracy of hulls over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periplus.functions import polygons
from periplus.operators import spatial_join
from periplus.operators.materialize import written


def split(itineraries: DataFrame, folds: int = 10, seed: int = 7) -> DataFrame:
    """``itinerary, fold``: disjoint folds of near-equal size, by rank of a checksum of name and seed."""
    names = itineraries.select("itinerary").distinct()
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "itinerary")), "itinerary")
    return names.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def rows(folds: DataFrame, n: int = 10) -> DataFrame:
    """``fold, type, itinerary``: TEST in its own fold, TRAIN in all the others."""
    every = folds.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return every.select("fold", F.when(F.col("fold") == F.col("own"), "TEST").otherwise("TRAIN").alias("type"), "itinerary")


def accuracy(positions: DataFrame, hulls: DataFrame, folds: DataFrame, n: int = 10) -> DataFrame:
    """Per fold, the share of the test itineraries' positions in hulls of the other folds; fold -1 is the mean and deviation.

    A position is located once for each hull that holds it (its own cells, exact test); a hull counts
    for all folds but its own, so no fold is computed on its own.
    """
    own = positions.join(folds, "itinerary").select("row_id", "lon", "lat", "fold")
    shapes = written(hulls.join(folds.withColumnRenamed("fold", "hull_fold"), "itinerary").select("hull_fold", "ring"), "shapes")
    index = spatial_join.placed(spatial_join.cell_index(shapes), spatial_join.index_bytes(shapes))
    grid = spatial_join.MEDITERRANEAN
    at = own.withColumn("cell_id", grid.cell_id(F.col("lon"), F.col("lat")))
    hit = at.join(index, "cell_id").where((F.col("fold") != F.col("hull_fold")) & polygons.contains(F.col("ring"), F.col("lon"), F.col("lat")))
    hit = hit.select("row_id").distinct().withColumn("hit", F.lit(1.0))
    per = own.join(hit, "row_id", "left").groupBy("fold").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("accuracy"))
    per = per.withColumn("std", F.lit(None).cast("double"))
    return per.unionByName(per.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("std")).select(F.lit(-1).alias("fold"), "accuracy", "std"))
