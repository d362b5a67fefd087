"""The fixed grid: cell numbers are computed, never stored."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICRO = 1_000_000


def _micro(x: float) -> int:
    return int((Decimal(repr(x)) * MICRO).to_integral_value(ROUND_HALF_UP))


@dataclass(frozen=True)
class Grid:
    """A box of cells, numbered row by row from 1, west to east and south to north."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float
    step_lon: float
    step_lat: float

    @property
    def columns(self) -> int:
        return -(-(_micro(self.max_lon) - _micro(self.min_lon)) // _micro(self.step_lon))

    @property
    def rows(self) -> int:
        return -(-(_micro(self.max_lat) - _micro(self.min_lat)) // _micro(self.step_lat))

    @property
    def stride(self) -> int:
        """Numbers in a row: the last column takes one more unless it lies exactly a step below the edge."""
        last = round((_micro(self.min_lon) + (self.columns - 1) * _micro(self.step_lon)) / MICRO, 2)
        return self.columns if last == self.max_lon - self.step_lon else self.columns + 1

    def _index(self, x: Column, low: float, step: float, n: int, compat: bool) -> Column:
        offset = F.floor(x * float(MICRO) + 0.5) - _micro(low)
        size = _micro(step)
        k = F.floor(offset / F.lit(float(size)))
        if compat:
            # Truncation: up to a step west or south of the box falls into its first cells.
            k = F.when((offset < 0) & (offset > -size), 0).otherwise(k)
        return F.when((k >= 0) & (k < n), k)

    def column_of(self, lon: Column, compat: bool = False) -> Column:
        return self._index(lon, self.min_lon, self.step_lon, self.columns, compat)

    def row_of(self, lat: Column, compat: bool = False) -> Column:
        return self._index(lat, self.min_lat, self.step_lat, self.rows, compat)

    def cell_id(self, lon: Column, lat: Column, compat: bool = False) -> Column:
        """Number of the cell that holds a point; null outside."""
        return (self.row_of(lat, compat) * self.stride + self.column_of(lon, compat) + 1).cast("bigint")

    def corner(self, cell: Column) -> Column:
        """Lower-left corner of a cell, ``struct<lon, lat>``."""
        k = cell - 1
        lon = (_micro(self.min_lon) + (k % self.stride) * _micro(self.step_lon)) / float(MICRO)
        lat = (_micro(self.min_lat) + F.floor(k / self.stride) * _micro(self.step_lat)) / float(MICRO)
        return F.struct(F.round(lon, 2).alias("lon"), F.round(lat, 2).alias("lat"))

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells: ``cell_id, lon, lat``."""
        k = F.col("id")
        cell = F.floor(k / self.columns) * self.stride + k % self.columns + 1
        out = spark.range(self.columns * self.rows).select(cell.cast("bigint").alias("cell_id"))
        return out.select("cell_id", self.corner(F.col("cell_id")).alias("c")).select("cell_id", "c.lon", "c.lat")

    def cover(self, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
        """Array of the cells that a box touches, clipped to the grid."""
        def span(low: Column, high: Column, base: float, step: float, n: int) -> Column:
            at = lambda v: F.floor((F.floor(v * float(MICRO) + 0.5) - _micro(base)) / F.lit(float(_micro(step)))).cast("bigint")
            a, b = F.greatest(at(low), F.lit(0)), F.least(at(high), F.lit(n - 1))
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

        columns = span(min_lon, max_lon, self.min_lon, self.step_lon, self.columns)
        rows = span(min_lat, max_lat, self.min_lat, self.step_lat, self.rows)
        return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * self.stride + c + 1)))


#: The default grid and the fine one of port discovery.
MEDITERRANEAN = Grid(-8.0, 29.0, 38.2, 47.2, 0.2, 0.2)
PORTS = Grid(-8.0, 29.0, 38.2, 47.2, 0.01, 0.01)
