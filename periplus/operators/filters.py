"""Filters and reductions of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periplus.functions.grid import MEDITERRANEAN, PORTS, Grid


def of_ship_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("ship_type").contains(kind))


def stopped(df: DataFrame) -> DataFrame:
    return df.where(F.col("speed") == 0.0)


def in_grid(df: DataFrame, grid: Grid = MEDITERRANEAN) -> DataFrame:
    """Rows inside the grid, with ``cell_id``."""
    return df.withColumn("cell_id", grid.cell_id(F.col("lon"), F.col("lat"))).where(F.col("cell_id").isNotNull())


def first_per_cell(df: DataFrame, grid: Grid = PORTS) -> DataFrame:
    """The first report of each vessel in each cell."""
    order = Window.partitionBy("cell_id", "mmsi").orderBy("seconds", "row_id")
    return in_grid(df, grid).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def unique_coordinates(df: DataFrame, by: str = "voyage_id") -> DataFrame:
    """Rows whose coordinates stand once in their group; repeated ones go altogether."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by, "lon", "lat"))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
