"""Token-id files with fixed-width bit packing.

Documents are range-partitioned and sorted by ``doc_id``; each partition writes one file, so that
the files in order hold all ids in ascending ``doc_id`` order. A file is

    payload blocks | doc ids (int64) | null flags (u8) | ends (u64: ids up to the end of each document)
    | block offsets (u64) | header (40 bytes: counts, ids per block, width, magic)

Ids take ``width`` bits, the fewest that the vocabulary's largest id needs. 64 ids fill ``width`` whole 64-bit
words, so packing and unpacking are a fixed number of shifts over numpy columns, and a block can be
read alone through its offset. Files are written under the attempt's own name, and a written
manifest names those that count; a lost task writes again without harm.

Edge cases: null and empty texts are the end id alone; null doc ids sort first; rows with the same
``doc_id`` are ordered by text; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens

END_ID = 2
#: Ids in a block (a multiple of 64).
BLOCK_IDS = 1 << 16
#: Ids that are read at once (one longer document goes alone).
READ_IDS = 1 << 20
MAGIC = b"IDBITS01"
HEADER = 40


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, padded with zeros to a multiple of 64 ids."""
    n = -(-len(ids) // 64) * 64
    x = np.zeros(n, np.uint64)
    x[: len(ids)] = ids
    x = x.reshape(-1, 64).T
    out = np.zeros((width, x.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= x[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= x[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed data, as unsigned 32-bit numbers."""
    x = np.frombuffer(data, "<u8").reshape(-1, width).T
    out = np.empty((64, x.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = x[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (x[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:count]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark, path: str) -> str:
    """The path with its scheme, for code outside Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Writer:
    """Streams one file; holds a block of ids and the document table."""

    def __init__(self, out, width: int, block_ids: int):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.offsets, self.held, self.size, self.total = [0], [], 0, 0

    def add(self, docs: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents, with their ids one after another and where each one's end."""
        self.docs += docs
        self.ends += (ends + self.total).tolist()
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block_ids:
            x = np.concatenate(self.held)
            whole = len(x) - len(x) % self.block_ids
            for a in range(0, whole, self.block_ids):
                self._block(x[a : a + self.block_ids])
            self.held, self.size = [x[whole:].copy()], len(x) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        for a in (np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], "u1"), np.array(self.ends, "<u8"), np.array(self.offsets, "<u8")):
            self.out.write(a.tobytes())
        self.out.write(np.array([len(self.docs), self.total, self.block_ids, self.width], "<u8").tobytes() + MAGIC)


class Reader:
    """Random access to one file by block or by document."""

    def __init__(self, file, size: int):
        self.file = file
        head = self._at(size - HEADER, HEADER)
        if head[32:] != MAGIC:
            raise ValueError("not a file of packed ids")
        n, self.total, self.block_ids, self.width = (int(v) for v in np.frombuffer(head[:32], "<u8"))
        blocks = -(-self.total // self.block_ids)
        foot = self._at(size - HEADER - 17 * n - 8 * (blocks + 1), 17 * n + 8 * (blocks + 1))
        self.docs, self.null = np.frombuffer(foot[: 8 * n], "<i8"), np.frombuffer(foot[8 * n : 9 * n], "u1")
        self.ends, self.offsets = np.frombuffer(foot[9 * n : 17 * n], "<u8").astype(np.int64), np.frombuffer(foot[17 * n :], "<u8").astype(np.int64)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        a, b = self.offsets[k], self.offsets[k + 1]
        return unpack_bits(self._at(int(a), int(b - a)), self.width, min(self.block_ids, self.total - k * self.block_ids))

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids at [low, high) of the file."""
        if low >= high:
            return np.zeros(0, np.uint32)
        first = low // self.block_ids
        x = np.concatenate([self._cached(k) for k in range(first, (high - 1) // self.block_ids + 1)])
        return x[low - first * self.block_ids : high - first * self.block_ids]

    _last: tuple[int, np.ndarray] | None = None

    def _cached(self, k: int) -> np.ndarray:
        if self._last is None or self._last[0] != k:
            self._last = (k, self.block(k))
        return self._last[1]


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, out_dir: str | None = None) -> DataFrame:
    """Write the files; returns the manifest ``part, path, n_docs, n_ids``."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    folder = qualified(spark, out_dir or f"{C.work_dir(spark)}/ids-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = tokens.encoder(path), TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        writer = stream = None
        for b in batches:
            for doc_ids, texts in tokens.slices(b):
                if writer is None:
                    stream = system.open_output_stream(f"{base}/{name}")
                    writer = Writer(stream, max(1, max(enc.top, end_id).bit_length()), block_ids)
                ids, bounds = enc.flat_with_end(texts, end_id)
                writer.add(doc_ids, ids, bounds[1:])
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    C.importable(docs.sparkSession)
    return C.written(src.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids (little-endian u32)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, at = _filesystem(uri)
                with system.open_input_file(at) as file:
                    r = Reader(file, file.size())
                    begins = np.concatenate([[0], r.ends[:-1]]).astype(np.int64)
                    low = 0
                    while low < len(r.docs):  # a bounded part of the ids at a time
                        high = max(low + 1, min(low + 1000, int(np.searchsorted(r.ends, begins[low] + READ_IDS, "right"))))
                        span = slice(low, high)
                        data = r.ids(int(begins[low]), int(r.ends[high - 1])).astype("<u4", copy=False)
                        places = pa.py_buffer((4 * np.append(begins[span], r.ends[high - 1]) - 4 * begins[low]).astype("<i4").tobytes())
                        ids = pa.Array.from_buffers(pa.binary(), high - low, [None, places, pa.py_buffer(data.tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[span], pa.int64(), mask=r.null[span].astype(bool)), pa.array(begins[span] + start), pa.array(r.ends[span] - begins[span]), ids], names=["doc_id", "start", "n_tokens", "ids"])
                        low = high

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.cast("long").alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    C.importable(manifest.sparkSession)
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of ``documents``, written, and read back from the files."""
    out = read_ids(write_ids(C.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
