"""Balanced partitioning of keys of known counts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(counts: list[tuple], n: int) -> list[tuple]:
    """(key, partition): the largest key first, each to the partition with the least load."""
    heap = [(0, p) for p in range(n)]
    out = []
    for key, size in sorted(counts, key=lambda x: (-x[1], str(x[0]))):
        load, p = heapq.heappop(heap)
        out.append((key, p))
        heapq.heappush(heap, (load + size, p))
    return out


def balanced(df: DataFrame, key: str, n: int = 8, heavy: int = 10_000) -> DataFrame:
    """Repartition so that all rows of a key share a partition and loads are near equal.

    Only the ``heavy`` largest keys are placed by load (a bounded table, in the driver); the many small ones
    are spread by hash, which balances them by number.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = [(r[0], r[1]) for r in counts.orderBy(F.desc("_n"), key).limit(heavy).collect()]
    kind = df.schema[key].dataType.simpleString()
    places = df.sparkSession.createDataFrame(assign(top, n), f"`{key}` {kind}, _p int")
    out = df.join(F.broadcast(places), key, "left")
    out = out.withColumn("_p", F.coalesce("_p", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")))
    return out.repartitionById(n, F.col("_p")).drop("_p")
