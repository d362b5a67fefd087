"""What the corpus operators share: tables, the shared work folder, packed blocks and messages.

A *block* is one row that holds a few megabytes of whole documents, sorted by ``doc_id`` and
compressed. Operators that must compare all documents work in two passes over a written table of
blocks: each block sends compact messages to buckets of the hash space (every key at most once
per block, so a hot key costs a row per block and never a row per occurrence), buckets answer,
and the answers are cogrouped with the blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periplus.operators.materialize import importable, work_dir

#: Uncompressed bytes of text in a block (one longer document makes a block of its own).
BLOCK_BYTES = 6 << 20
#: Documents in a block, so that a document's place in it fits 16 bits.
BLOCK_DOCS = 60_000

#: Base of the rolling hashes (an odd number).
FACTOR = 0x9E3779B97F4A7C15

BLOCK_SCHEMA = "block long, doc_ids array<long>, sizes array<long>, body binary, carry array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back."""
    spark = df.sparkSession
    importable(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def squeeze(data: bytes, level: int = 1) -> bytes:
    """Length and zstd frame."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True) if n else b""


def squeeze_planes(a: np.ndarray) -> bytes:
    """Compress integers byte plane by byte plane: constant planes cost nothing."""
    a = np.ascontiguousarray(a)
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unsqueeze_planes(data: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(d.itemsize, -1).T).view(d).reshape(-1)


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", name: str = "blocks", carry: bool = False) -> DataFrame:
    """Write ``docs`` as a table of blocks, without a shuffle, and read it back.

    Null ids stay null and sort first; null texts have size -1. The written table fixes the block
    numbers, so later stages agree on them whatever is recomputed. With ``carry``, the other columns
    travel along as JSON.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, seq
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([[x[0] for x in held]], pa.list_(pa.int64())),
                    pa.array([[-1 if x[1] is None else len(x[1]) for x in held]], pa.list_(pa.int64())),
                    pa.array([squeeze(b"".join(x[1] or b"" for x in held))], pa.binary()),
                    pa.array([[x[2] for x in held]], pa.list_(pa.string())),
                ],
                names=["block", "doc_ids", "sizes", "body", "carry"],
            )
            held, size, seq = [], 0, seq + 1
            return row

        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            others = b.column(2).to_pylist()
            for i, t, other in zip(ids, texts, others):
                n = len(t) if t is not None else 0
                if held and (size + n > block_bytes or len(held) >= BLOCK_DOCS):
                    yield flush()
                held.append((i, t, other))
                size += n
        if held:
            yield flush()

    importable(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.to_json(F.struct(*[F.col(f"`{c}`") for c in others(docs, id_col, text_col)])) if carry and others(docs, id_col, text_col) else F.lit(None).cast("string")).alias("carry"))
    return written(src.mapInArrow(pack, BLOCK_SCHEMA), name)


def others(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    return [c for c in docs.columns if c not in (id_col, text_col)]


def struct_of(docs: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([docs.schema[c] for c in names])


class Block:
    """A block's documents: ids (list, None for null), and texts as bytes (None for null)."""

    def __init__(self, block: int, doc_ids: list, sizes: list, body: bytes, carry: list):
        self.block, self.doc_ids, self.carry = block, doc_ids, carry
        raw, at, self.texts = unsqueeze(body), 0, []
        for n in sizes:
            self.texts.append(None if n < 0 else raw[at : at + n])
            at += max(n, 0)
        #: Order of documents: null ids first, as a number.
        self.order = np.array([-(1 << 63) if i is None else i for i in doc_ids], np.int64)


def blocks_of(batch: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    cols = [batch.column(k) for k in ("block", "doc_ids", "sizes", "body", "carry")]
    for k in range(batch.num_rows):
        yield Block(*(c[k].as_py() for c in cols))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash: the n equal ranges of the hash space, in order."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit hashes (the one of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
