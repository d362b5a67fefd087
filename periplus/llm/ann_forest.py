"""Nearest neighbours by a forest of random-projection trees.

*Fit.* At most ``SAMPLE`` rows, chosen by a hash of ``vec_id``, are brought to the driver (the documented
bound of the index); each tree splits them at the median of their projection on the difference of
two random rows until a leaf has at most ``leaf`` of them. Where the whole table would put more than
``CELL_ROWS`` rows in a leaf, the tree goes on below it with random planes, one per level, through the median
of the leaf's sample rows. So a *cell* holds about ``CELL_ROWS`` rows at any size of the table, while the
forest stays small.

*Index.* Every row falls to one cell of each tree. Cells of more than ``CHUNK`` rows are cut into
chunks by a hash of ``vec_id``, and their queries into chunks of ``QUERIES``, so that neither a common vector
nor a crowded cell makes one large task.

*Search.* A query walks all trees through one shared priority queue: the node with the smallest sum of
squared margins to the planes that it lies beyond is next, whichever tree it is in, until the cells
visited hold ``candidates`` entries (by the share of the sample in them): a constant, whatever the table's
size. Visits are matched with the cells' chunks, whose candidates are ranked exactly: dot products find those
near the k-th best, and scores are then computed again from the original vectors in double precision, row
by row, so that equal vectors get equal scores and ties go to the smaller ``vec_id``. Each chunk returns k
candidates for a query, and the best k of all remain.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do those of another length than most of the sample's; a null ``vec_id`` takes no part. A query's candidates
are all rows but its own: a row with the query's id and another vector is one, and of m rows that equal the
query's m - 1 are; repeated rows are ranked as often as they stand, and repeated queries are answered
each. With fewer candidates than k all that are found are returned; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE = 8192
TREES = 3
LEAF = 64
#: Rows of a cell that the tree aims at, and levels below a leaf at most.
CELL_ROWS = 1024
DEEP = 24
#: Entries of cells that a query visits; a row may be met in several trees.
CANDIDATES = 40_000
#: Rows of a cell, and queries that visit it, in one task.
CHUNK = 20_000
QUERIES = 4096
K = 5


class Tree:
    """Planes and children of one tree; a negative child is a leaf."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator, rows: int, cell_rows: int):
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.plane_matrix = np.array(self.planes) if self.planes else np.zeros((0, x.shape[1]))
        self.offset_array = np.array(self.offsets)
        #: Rows of the table that a leaf holds, by its share of the sample, and the levels below it.
        self.rows = np.array([len(m) * rows / len(x) for m in self.members])
        self.levels = np.clip(np.ceil(np.log2(np.maximum(self.rows / cell_rows, 1.0))), 0, DEEP).astype(np.int64)
        deep = rng.normal(size=(int(self.levels.max()), x.shape[1]))
        self.deep = deep / np.linalg.norm(deep, axis=1, keepdims=True)
        self.deep_offsets = np.array([np.median(x[m] @ self.deep.T, axis=0) for m in self.members])

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(8):
                a, b = rng.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                size = np.linalg.norm(plane)
                if size < 1e-9:
                    continue
                plane /= size
                at = x[rows] @ plane
                cut = float(np.median(at))
                right = at > cut
                if 0 < right.sum() < len(rows):
                    node = len(self.planes)
                    self.planes.append(plane)
                    self.offsets.append(cut)
                    self.children.append([0, 0])
                    self.children[node][0] = self._grow(x, rows[~right], leaf, rng)
                    self.children[node][1] = self._grow(x, rows[right], leaf, rng)
                    return node
        self.members.append(rows)
        return -len(self.members)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distance of each row to each plane."""
        return x @ self.plane_matrix.T - self.offset_array

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row: the leaf's number (from 0) and a bit for each level below it."""
        m = self.margins(x)
        kids = np.array(self.children or [[0, 0]])
        at = np.full(len(x), self.root)
        rows = np.arange(len(x))
        while (inner := at >= 0).any():
            r = rows[inner]
            at[r] = kids[at[r], (m[r, at[r]] > 0).astype(int)]
        leaf = -at - 1
        bits = x @ self.deep.T > self.deep_offsets[leaf]
        code = np.zeros(len(x), np.int64)
        for level in range(bits.shape[1]):
            code = np.where(level < self.levels[leaf], code * 2 + bits[:, level], code)
        return (leaf.astype(np.int64) << DEEP) | code


def walk(trees: list[Tree], x: np.ndarray, margins: list[np.ndarray], row: int, most: float) -> list[tuple[int, int]]:
    """(tree, cell) visits of one query through the shared queue, until the cells hold ``most`` entries."""
    # A node: sum of squared margins, tree, inner node or leaf, level below the leaf, bits of these levels.
    heap = [(0.0, t, tree.root, 0, 0) for t, tree in enumerate(trees)]
    heapq.heapify(heap)
    out, held = [], 0.0
    while heap and held < most:
        p, t, node, level, code = heapq.heappop(heap)
        tree = trees[t]
        if node >= 0:
            d = float(margins[t][row, node])
            left, right = ((child, 0, 0) for child in tree.children[node])
        else:
            leaf = -node - 1
            if level == tree.levels[leaf]:
                out.append((t, (leaf << DEEP) | code))
                held += tree.rows[leaf] / 2.0**level
                continue
            d = float(x[row] @ tree.deep[level] - tree.deep_offsets[leaf, level])
            left, right = ((node, level + 1, 2 * code + bit) for bit in (0, 1))
        heapq.heappush(heap, (p + max(d, 0.0) ** 2, t, *left))
        heapq.heappush(heap, (p + min(d, 0.0) ** 2, t, *right))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, same`` of the rows that take part; ``same`` is a hash of the vector."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    v = F.col("v")
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)).where(
        F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    )
    return rows.withColumn("same", F.xxhash64("v"))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, one by one, in double precision."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def best_of(ids: np.ndarray, same: np.ndarray, y: np.ndarray, q_ids: np.ndarray, q_same: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each query its k best rows of a chunk: query's place, row's place, copy number and score."""
    dots = unit(q) @ unit(y).T
    # Of the rows that equal the query's, one is its own; more than k rows are looked at for that.
    n = min(k + 1, dots.shape[1])
    least = -np.partition(-dots, n - 1, axis=1)[:, n - 1 : n]
    qi, xi = np.nonzero(dots >= least - 1e-9)
    s = exact(q[qi], y[xi])
    by = np.lexsort((same[xi], ids[xi], -s, qi))
    qi, xi, s = qi[by], xi[by], s[by]
    new = np.ones(len(qi), bool)
    new[1:] = (qi[1:] != qi[:-1]) | (ids[xi][1:] != ids[xi][:-1]) | (same[xi][1:] != same[xi][:-1])
    begin = np.flatnonzero(new)
    copy = np.arange(len(qi)) - np.repeat(begin, np.diff(np.append(begin, len(qi))))
    own = (ids[xi] == q_ids[qi]) & (same[xi] == q_same[qi]) & (copy == 0)
    qi, xi, s, copy = qi[~own], xi[~own], s[~own], copy[~own]
    begin = np.searchsorted(qi, np.arange(len(q)))
    good = np.arange(len(qi)) - begin[qi] < k
    return qi[good], xi[good], copy[good], s[good]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, candidates: int = CANDIDATES, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, chunk: int = CHUNK, query_chunk: int = QUERIES, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """For each row of ``queries``: ``query_id, rank, vec_id, score``, nearest first."""
    rows, asked = clean(vectors, id_col, vec_col), clean(queries, id_col, vec_col)
    spark = vectors.sparkSession
    C.importable(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    if not fit.num_rows:
        return empty
    sizes, times = np.unique([len(v) for v in fit.column("v").to_pylist()], return_counts=True)
    dim = int(sizes[np.argmax(times)])
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    x = unit(np.array([v for v in fit.column("v").to_pylist() if len(v) == dim]))
    rng, total = np.random.default_rng(seed), rows.count()
    shared = spark.sparkContext.broadcast([Tree(x, leaf, rng, total, cell_rows) for _ in range(trees)])
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = unit(matrix(b.column("v"), dim))
                for t, tree in enumerate(shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), t, np.int32)), pa.array(tree.cell_of(y)), b.column("vec_id"), b.column("same"), b.column("v")], names=["tree", "cell", "vec_id", "same", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                y = unit(matrix(part.column("v"), dim))
                margins = [tree.margins(y) for tree in shared.value]
                out = [walk(shared.value, y, margins, i, candidates) for i in range(len(y))]
                cells = pa.array([[{"tree": t, "cell": c} for t, c in o] for o in out], pa.list_(pa.struct([("tree", pa.int32()), ("cell", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=[*part.schema.names, "visits"])

    placed = rows.mapInArrow(place, f"tree int, cell long, vec_id long, same long, v {kind}")
    asked = asked.withColumn("qid", F.monotonically_increasing_id()).select("qid", F.col("vec_id").alias("query_id"), F.col("same").alias("q_same"), "v")
    visits = C.written(asked.mapInArrow(visit, f"qid long, query_id long, q_same long, v {kind}, visits array<struct<tree: int, cell: long>>"), "ann-visits")
    visits = visits.select("qid", "query_id", "q_same", F.col("v").alias("q"), F.inline("visits"))
    keys = ["tree", "cell"]
    # Crowded cells only: fewer than entries / chunk of them.
    full = placed.groupBy(*keys).count().where(F.col("count") > chunk).select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    busy = visits.groupBy(*keys).count().where(F.col("count") > query_chunk).select(*keys, F.ceil(F.col("count") / query_chunk).cast("int").alias("query_chunks"))
    crowded = C.written(full.join(busy, keys, "full").select(*keys, F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce("query_chunks", F.lit(1)).alias("query_chunks")), "ann-crowded")
    of = lambda column, n: F.pmod(F.xxhash64(column), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    held = placed.join(crowded, keys, "left").withColumn("chunk", of("vec_id", F.col("chunks"))).withColumn("part", every(F.col("query_chunks"))).drop("chunks", "query_chunks")
    sent = visits.join(crowded, keys, "left").withColumn("part", of("qid", F.col("query_chunks"))).withColumn("chunk", every(F.col("chunks"))).drop("chunks", "query_chunks")
    keys = [*keys, "chunk", "part"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, same, y = left.column("vec_id").to_numpy(), left.column("same").to_numpy(), matrix(left.column("v"), dim)
            for low in range(0, right.num_rows, 256):
                part = right.slice(low, 256)
                qid, q_ids = part.column("qid").to_numpy(), part.column("query_id").to_numpy()
                qi, xi, copy, s = best_of(ids, same, y, q_ids, part.column("q_same").to_numpy(), matrix(part.column("q"), dim), k)
                out.append((qid[qi], q_ids[qi], ids[xi], same[xi], copy, s))
        cat = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64 if j < 5 else np.float64) for j in range(6)]
        return pa.table(dict(zip(("qid", "query_id", "vec_id", "same", "copy", "score"), cat)))

    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(rank, "qid long, query_id long, vec_id long, same long, copy long, score double")
    found = found.groupBy("qid", "query_id", "vec_id", "same", "copy").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "same", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: rows of ``embeddings`` whose id is divisible by 50, against all rows."""
    rows = C.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
