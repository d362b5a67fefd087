"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into full pieces, each a sequence of its own, and a rest.
Rests are dealt whole, in batches: each is a partial partition of m windows with one filled; the two
partitions with the largest imbalance are merged again and again, fullest against emptiest, until one is
left whose windows are nearly equal. Only what exceeds a window's capacity is cut off; these tails
are dealt in the same way, against the partition of the windows as they are filled. If capacity is still
exceeded after ``ROUNDS`` such rounds, m rises by one and the batch is dealt anew.

A batch belongs to one input partition, so nothing is shuffled, and memory is bounded by the batch.

Edge cases: null and empty texts are the end id alone; a null ``doc_id`` is carried along; repeated
rows are packed once each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tokens

CAPACITY = 1024
#: Windows in a batch.
BATCH = 128
#: Rounds in which tails are dealt before the window count rises.
ROUNDS = 12
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], m: int, loads: np.ndarray | None = None) -> np.ndarray:
    """Window of each part, by merging partial partitions with opposing imbalances.

    ``loads``: what the windows hold already, as one more partial partition.
    """
    n = len(sizes)
    if m == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    made: dict[int, tuple[int, int, np.ndarray]] = {}
    heap = []
    for k, s in enumerate(sizes):
        sums[k] = np.zeros(m, np.int64)
        sums[k][0] = s
        heap.append((-s, k))
    top, windows_at = n, None
    if loads is not None:
        by = np.argsort(-loads, kind="stable")
        sums[n] = loads[by] - loads.min()
        heap.append((-int(sums[n][0]), n))
        top = n + 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        c = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-c, kind="stable")
        c = c[order]
        c -= c[-1]
        sums[top], made[top] = c, (a, b, order)
        heapq.heappush(heap, (-int(c[0]), top))
        top += 1
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(m))]
    while todo:
        node, slots = todo.pop()  # slots: the window of each of the node's places
        if node in made:
            a, b, order = made[node]
            place = np.empty(m, np.int64)
            place[order] = slots
            todo += [(a, place), (b, place[::-1])]
        elif node < n:
            out[node] = slots[0]
        else:
            windows_at = np.empty(m, np.int64)
            windows_at[slots] = by
    return out if windows_at is None else windows_at[out]


def windows(sizes: list[int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces ``(part, start in it, length, window)`` and the number of windows; none holds more than the capacity."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        loads, out, open_ = np.zeros(m, np.int64), [], [(k, 0, s) for k, s in enumerate(sizes)]
        for turn in range(rounds):
            open_.sort(key=lambda x: (-x[2], x[0]))
            at = differencing([x[2] for x in open_], m, loads if turn else None)
            tails = []
            for (k, start, size), w in zip(open_, at.tolist()):
                fits = min(size, capacity - int(loads[w]))
                if fits:
                    out.append((k, start, fits, w))
                    loads[w] += fits
                if fits < size:
                    tails.append((k, start + fits, size - fits))
            open_ = tails
            if not open_:
                return out, m
        m += 1


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, batch: int = BATCH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset``."""
    path = path or tokens.default_path()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, seq = tokens.encoder(path), TaskContext.get().partitionId() << 32, 0
        rests: list[tuple] = []
        held = 0

        def rows_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def flush() -> pa.RecordBatch:
            nonlocal rests, held, seq
            pieces, m = windows([len(x[2]) // 4 for x in rests], capacity)
            offsets, out = [0] * m, []
            for k, a, length, w in pieces:
                doc, start, ids, total = rests[k]
                out.append((doc, start + a, length, ids[4 * a : 4 * (a + length)], total, base + seq + w, offsets[w]))
                offsets[w] += length
            rests, held, seq = [], 0, seq + m
            return rows_of(out)

        for b in batches:
            for doc_ids, texts in tokens.slices(b):
                ids, bounds = enc.flat_with_end(texts, end_id)
                data, full = ids.astype("<u4", copy=False).tobytes(), []
                for doc, low, high in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = high - low
                    whole = n - n % capacity
                    for s in range(0, whole, capacity):
                        full.append((doc, s, capacity, data[4 * (low + s) : 4 * (low + s + capacity)], n, base + seq, 0))
                        seq += 1
                    if whole < n:
                        rests.append((doc, whole, data[4 * (low + whole) : 4 * high], n))
                        held += n - whole
                    if held >= batch * capacity:
                        yield flush()
                if full:
                    yield rows_of(full)
        if rests:
            yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    C.importable(docs.sparkSession)
    return src.mapInArrow(deal, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of ``documents`` in sequences of at most 1024 ids."""
    out = pack(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
