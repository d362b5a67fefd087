"""Voyage segmentation: gaps and islands over each vessel's track, in window functions.

A vessel's track is closed at each arrival in a port other than the last one (the arrival belongs
to the voyage), and before each report that follows a silence of a day, unless it is such an arrival.
After a silence the last port is unknown (-1). In the same port, of consecutive reports that each
follow a silence, every other one is an arrival again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 86_400
MIN_POSITIONS = 3


def gaps(df: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Seconds since the vessel's last report, and whether that is a gap."""
    order = Window.partitionBy("mmsi").orderBy("seconds", "row_id")
    since = F.coalesce(F.col("seconds") - F.lag("seconds").over(order), F.lit(0))
    return df.withColumn("since", since.cast("bigint")).withColumn("is_gap", F.col("since") >= gap)


def segments(df: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """``df`` (with ``port``, null at sea) with ``voyage_seq``, ``arrive`` and the last port before each row."""
    track = Window.partitionBy("mmsi").orderBy("seconds", "row_id")
    df = gaps(df, gap)
    df = df.withColumn("_active", F.col("port").isNotNull() | F.col("is_gap"))
    acting = Window.partitionBy("mmsi", "_active").orderBy("seconds", "row_id")
    df = df.withColumn("_last", F.when(F.col("_active"), F.lag(F.coalesce("port", F.lit(-1))).over(acting)))
    df = df.withColumn("_x", F.coalesce(F.col("_active") & F.col("is_gap") & F.col("port").isNotNull() & (F.col("_last") == F.col("port")), F.lit(False)))
    df = df.withColumn("_island", F.sum((~F.col("_x")).cast("int")).over(acting))
    run = Window.partitionBy("mmsi", "_active", "_island").orderBy("seconds", "row_id")
    # The row that starts an island is no repeat itself, so the first repeat is number 1 of the run.
    df = df.withColumn("_place", F.sum(F.col("_x").cast("int")).over(run))
    odd = F.col("_x") & (F.col("_place") % 2 == 1)
    df = df.withColumn("_state", F.when(F.col("_active"), F.when(odd, -1).otherwise(F.coalesce("port", F.lit(-1)))))
    before = track.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("prev_port", F.coalesce(F.last("_state", ignorenulls=True).over(before), F.lit(-1)))
    df = df.withColumn("arrive", F.coalesce(F.col("port") != F.col("prev_port"), F.lit(False)))
    close = ~F.col("arrive") & F.col("is_gap")
    arrived = F.coalesce(F.sum(F.col("arrive").cast("int")).over(before), F.lit(0))
    closed = F.sum(close.cast("int")).over(track.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("voyage_seq", (arrived + closed).cast("int"))
    return df.drop("_active", "_last", "_x", "_island", "_place", "_state")


def voyages(df: DataFrame, gap: int = GAP_SECONDS, min_positions: int = MIN_POSITIONS) -> DataFrame:
    """Positions at sea of all closed voyages between known ports, with ``voyage_id`` and ``itinerary``.

    ``df`` has ``port`` (from the port lookup). Voyages with an unknown end, and those with fewer than
    ``min_positions`` positions outside ports, are left out.
    """
    s = segments(df, gap)
    whole = Window.partitionBy("mmsi", "voyage_seq")
    # A segment is closed by one arrival at most; its ports name the itinerary.
    s = s.withColumn("_from", F.max(F.when(F.col("arrive"), F.col("prev_port"))).over(whole)).withColumn("_to", F.max(F.when(F.col("arrive"), F.col("port"))).over(whole))
    s = s.withColumn("_n", F.sum(F.col("port").isNull().cast("int")).over(whole))
    s = s.where(F.col("port").isNull() & (F.col("_from") >= 0) & F.col("_to").isNotNull() & (F.col("_n") >= min_positions))
    s = s.withColumn("voyage_id", F.concat_ws("-", F.col("mmsi").cast("string"), F.col("voyage_seq").cast("string")))
    s = s.withColumn("itinerary", F.concat(F.col("_from").cast("string"), F.lit("_to_"), F.col("_to").cast("string")))
    return s.drop("_from", "_to", "_n", "since", "is_gap", "prev_port", "arrive", "port")
