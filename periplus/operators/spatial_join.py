"""Point-in-polygon joins: cells of the grid as the join key, exact test as the residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periplus.functions import polygons
from periplus.functions.grid import MEDITERRANEAN, Grid

#: Largest size of an index that is broadcast.
BROADCAST_BYTES = 16 << 20


def _cells(grid: Grid, compat: bool) -> Column:
    """Cells of a shape: those that its ring's box touches.

    The compatibility index has only the cells of the vertices and of the three that neighbour them in a row.
    """
    if not compat:
        return grid.cover(*polygons.bounds(F.col("ring")))
    cells = F.transform(F.col("ring"), lambda p: grid.cell_id(p["lon"], p["lat"], compat=True))
    near = F.flatten(F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.array(c - 1, c, c + 1)))
    return F.array_distinct(near)


def cell_index(shapes: DataFrame, grid: Grid = MEDITERRANEAN, compat: bool = False) -> DataFrame:
    """``shapes`` with a row for each of their cells."""
    return shapes.withColumn("cell_id", F.explode(_cells(grid, compat)))


def index_bytes(shapes: DataFrame, grid: Grid = MEDITERRANEAN, compat: bool = False) -> int:
    """Size of the index, counted over the shapes without building it: 16 bytes a point and 32 a row, in each cell."""
    return shapes.agg(F.sum(F.size(_cells(grid, compat)).cast("bigint") * (F.size("ring") * 16 + 32))).first()[0] or 0


def placed(index: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """The index as a join side: broadcast up to the limit, dealt by cell beyond it."""
    return F.broadcast(index) if size <= (BROADCAST_BYTES if limit is None else limit) else index.hint("merge")


def matches(points: DataFrame, shapes: DataFrame, key: str, grid: Grid = MEDITERRANEAN, compat: bool = False) -> DataFrame:
    """Smallest shape id that holds each point: ``key, shape_id``, only for points inside one."""
    index = cell_index(shapes, grid, compat).select("cell_id", F.col("id").alias("shape_id"), "ring")
    at = points.select(key, "lon", "lat", grid.cell_id(F.col("lon"), F.col("lat"), compat).alias("cell_id"))
    hit = at.join(placed(index, index_bytes(shapes, grid, compat)), "cell_id").where(polygons.contains(F.col("ring"), F.col("lon"), F.col("lat")))
    return hit.groupBy(key).agg(F.min("shape_id").alias("shape_id"))


def lookup(points: DataFrame, shapes: DataFrame, grid: Grid = MEDITERRANEAN, name: str = "port", compat: bool = False) -> DataFrame:
    """``points`` with the smallest id of the shapes around it, or null.

    The cells' shapes are nested first, so the join is one row per cell, keeps every point once, and
    needs neither a key nor a second shuffle.
    """
    index = cell_index(shapes, grid, compat)
    nested = index.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), "ring"))).alias("_shapes"))
    at = points.withColumn("_cell", grid.cell_id(F.col("lon"), F.col("lat"), compat))
    nested = nested.withColumnRenamed("cell_id", "_cell_of")
    out = at.join(placed(nested, index_bytes(shapes, grid, compat)), F.col("_cell") == F.col("_cell_of"), "left")
    inside = F.filter(F.col("_shapes"), lambda s: polygons.contains(s["ring"], F.col("lon"), F.col("lat")))
    return out.withColumn(name, F.get(F.transform(inside, lambda s: s["id"]), F.lit(0))).drop("_cell", "_cell_of", "_shapes")


def inside(points: DataFrame, shapes: DataFrame, grid: Grid = MEDITERRANEAN) -> DataFrame:
    """Semi-join: points in some shape."""
    return lookup(points, shapes, grid, "_in").where(F.col("_in").isNotNull()).drop("_in")


def outside(points: DataFrame, shapes: DataFrame, grid: Grid = MEDITERRANEAN) -> DataFrame:
    """Anti-join: points in no shape."""
    return lookup(points, shapes, grid, "_in").where(F.col("_in").isNull()).drop("_in")
