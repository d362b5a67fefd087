"""Near-duplicate documents: SimHash candidates, verified by the exact Jaccard similarity of word shingles.

A document is the set of its 5-word shingles' XXH64 values. Equal sets are first reduced to one class.
Candidates are what the binary tries of several SimHash fingerprints link (``simhash_trie.wide``: as many as
link a pair of similarity 0.8 with odds of 0.995, more similar ones with more). Candidates are verified by the
exact similarity of the two sets, but for pairs that are linked through others already.

Only keys and fingerprints travel for all documents. Components of candidates say which texts must meet: small
ones are dealt to tasks together, a large one to salts, and each pair of salts is a task. A task compares
the pairs of a component whose sizes allow the similarity. Components of the verified links follow by
large-star/small-star rounds.

Edge cases: null, empty and blank texts are one class; a text of one to four words is one shingle; a null
``doc_id`` never names a component unless all its members are null; repeated rows fall into one class; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periplus.operators.clustering import components

from . import common as C
from . import simhash_trie

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Classes in a task, on average, and in a component before it is salted; bytes of text in a salt.
TASK_ROWS = 500
SALT_BYTES = 16 << 20


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[:-size].tolist()]
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())], np.uint64))


def key_of(s: np.ndarray) -> int:
    """A signed number that stands for the whole set."""
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0, np.uint64).view(np.int64))


def verified(sets: list[np.ndarray], groups: list[int], salts: list[int], cross: bool, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest over the similar pairs of each group; with ``cross``, of pairs of unlike salts only."""
    n = len(sets)
    sizes, group, salt = np.array([len(s) for s in sets], np.int64), np.array(groups), np.array(salts)
    every, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label, mark, out = np.arange(n), np.zeros(len(every), bool), []
    for i in range(n - 1):
        open_ = (label[i + 1 :] != label[i]) & (group[i + 1 :] == group[i])
        if cross:
            open_ &= salt[i + 1 :] != salt[i]
        open_ &= np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9
        js = np.flatnonzero(open_) + i + 1
        if not len(js):
            continue
        mine = ids[starts[i] : starts[i + 1]]
        mark[mine] = True
        for j in js.tolist():
            if label[j] != label[i]:
                common = int(np.count_nonzero(mark[ids[starts[j] : starts[j + 1]]]))
                if common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        mark[mine] = False
    return out


def sketches(docs: DataFrame, tables: int, size: int = SHINGLE) -> DataFrame:
    """Per document ``doc_id``, ``x`` (a hash of the text), ``key`` of its set and the set's ``prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                sets = [shingles(t, size) for t in part.column(2).cast(pa.binary()).to_pylist()]
                prints = pa.array(simhash_trie.wide_prints(sets, tables).view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([key_of(s) for s in sets], pa.int64()), pa.FixedSizeListArray.from_arrays(prints, tables).cast(pa.list_(pa.int64()))], names=["doc_id", "x", "key", "prints"])

    return _rows(docs).select("doc_id", "x", "text").mapInArrow(run, "doc_id long, x long, key long, prints array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("x", F.xxhash64("text"))


def links(docs: DataFrame, classes: DataFrame, shape: simhash_trie.Wide, similarity: float = SIMILARITY, size: int = SHINGLE, task_rows: int = TASK_ROWS, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """Verified links ``a, b`` between classes (``key, rep, prints``), a forest per task."""
    near = components(C.written(simhash_trie.wide_links(classes, shape), "near"))
    near = C.written(classes.join(near, classes["key"] == near["node"]).select("key", "component", F.coalesce("rep.doc_id", F.lit(0)).alias("i"), F.col("rep.x").alias("x")), "candidates")
    texts = _rows(docs).withColumn("i", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    texts = C.written(texts.join(near, ["i", "x"]).select("key", "component", "text"), "candidate-texts")
    n = max(1, math.ceil(near.count() / task_rows))
    per = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size"))
    # Salts grow with the root of the rows, as do the rows of a salt.
    salts = F.greatest(F.ceil(F.sqrt(2 * F.col("n") / task_rows)), F.ceil(F.col("size") / salt_bytes)).cast("int")
    per = per.select("component", F.when((F.col("n") > task_rows) | (F.col("size") > salt_bytes), salts).otherwise(1).alias("salts"))
    dealt = texts.join(per, "component").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    group = F.when(F.col("salts") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(n)))
    dealt = dealt.select((F.col("salts") > 1).alias("salted"), group.alias("group"), F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "salt", "component", "key", "text")

    def run(group: pa.Table) -> pa.Table:
        found: dict[int, tuple[np.ndarray, int, int]] = {}
        for key, salt, component, text in zip(*(group.column(c).to_pylist() for c in ("key", "salt", "component")), group.column("text").cast(pa.binary()).to_pylist()):
            if key not in found and key_of(s := shingles(text, size)) == key:
                found[key] = (s, component, salt)
        keys = sorted(found)
        cross = group.column("s1")[0].as_py() != group.column("s2")[0].as_py()
        out = verified(*([found[k][j] for k in keys] for j in range(3)), cross, similarity)
        return pa.table({"a": pa.array([keys[i] for i, _ in out], pa.int64()), "b": pa.array([keys[j] for _, j in out], pa.int64())})

    return dealt.groupBy("salted", "group", "s1", "s2").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, task_rows: int = TASK_ROWS, recall: float = simhash_trie.RECALL) -> DataFrame:
    """Per document: ``doc_id, x, key`` and ``component_id``, the smallest ``doc_id`` of its component.

    ``survivor`` is a hash of the text that stays: the one of the smallest id, of repeated ids the smallest hash.
    """
    C.importable(docs.sparkSession)
    shape = simhash_trie.wide(docs.count(), similarity, recall)
    prints = C.written(sketches(docs, shape.tables, size), "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("rep")
    classes = C.written(prints.groupBy("key").agg(rep, F.max("prints").alias("prints")), "classes")
    found = components(C.written(links(docs, classes, shape, similarity, size, task_rows), "links"))
    named = classes.join(found, classes["key"] == found["node"], "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    named = C.written(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("key", F.col("least.doc_id").alias("component_id"), F.col("least.x").alias("survivor"))
    return prints.select("doc_id", "x", "key").join(named, "key")
