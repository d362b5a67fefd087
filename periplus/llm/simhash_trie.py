"""Near-duplicate documents by SimHash and a self-join of binary tries.

A document's fingerprint has a bit set where over half of its 4-word shingles' XXH64 values have it.
Equal fingerprints are first reduced to one row each. Two fingerprints that differ in at most
``budget`` bits agree wholly in one of ``budget + 1`` bit blocks, so each distinct fingerprint goes to
``budget + 1`` tables, rotated so that the table's block leads; tables are cut by a prefix of that
block. A task holds one trie (a sorted array; a node is a range), descends in pairs of nodes at once,
adds up differing bits, and drops a pair whose bits exceed the budget. Pairs whose rows are all
linked already are dropped too, and links come out as a spanning forest, so a cluster of copies costs
no more links than it has members. Components over all tables follow by large-star/small-star rounds.

A prefix with too many fingerprints is dealt to salts, and each pair of salts is a task.

*Similar sets of shingles* (``wide``) differ in too many bits for one fingerprint and a small budget: at a Jaccard
similarity of 0.8 about 10 of 64. So several independent fingerprints are taken of each document, a
*table* each; a table's tries are cut by ``lead`` leading bits, which must agree, and joined within the largest
budget at which a pair of unlike documents is linked with odds of at most ``FALSE``. As many tables are taken as the
wanted recall needs; ``jaccard_groups`` verifies what they link.

Edge cases: null, empty and blank texts have fingerprint zero; a text of one to three words is one
shingle; repeated rows fall into one class; a null ``doc_id`` never names a component unless all its
members are null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periplus.operators.clustering import components

from . import common as C

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Distinct fingerprints in a task, on average, and the most before a prefix is salted.
TASK_ROWS = 8192
SALT_ROWS = 1 << 20
#: Node pairs are expanded to row pairs below this many rows on either side.
LEAF = 8
#: Node pairs that descend at once (at most ``LEAF ** 2`` row pairs each).
FRONT = 5_000
#: Of several fingerprints: leading bits at least, rows that share them on average, odds of an unlike pair in a
#: table, and share of the pairs of the wanted similarity that some table links.
LEAD = 8
PREFIX_ROWS = 2048
FALSE = 1e-9
RECALL = 0.995
#: Hashes that are counted together, and numbers in a working array.
SPAN = 1024
CELLS = 1 << 18
SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, 4096, dtype=np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: -size].tolist()]
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[low : low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document ``doc_id`` and ``fp``, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) if t else 0 for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    C.importable(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Labels of rows, kept flat: each row names the smallest row of its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of row pairs."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            new = la != lb
            a, b, la, lb = a[new], b[new], la[new], lb[new]
            if not len(a):
                return
            root = np.arange(len(self.label))
            np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            self.label = root[self.label]


def trie_links(fps: np.ndarray, lead: int, budget: int) -> np.ndarray:
    """Labels of sorted distinct fingerprints whose first ``lead`` bits must agree.

    The trie's nodes are ranges of the sorted array. Rows that differ in one bit are linked first, so that
    ranges of copies are linked throughout and leave the traversal within the whole budget.
    """
    n = len(fps)
    forest = Forest(n)
    if n < 2:
        return forest.label
    heads = fps >> np.uint64(64 - lead) if lead else np.zeros(n, np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(heads)) + 1, [n]])
    roots = np.stack([cuts[:-1], cuts[1:], cuts[:-1], cuts[1:], np.full(len(cuts) - 1, lead), np.zeros(len(cuts) - 1, np.int64)], 1).astype(np.int64)
    roots = roots[roots[:, 1] - roots[:, 0] > 1]
    for most in sorted({min(1, budget), budget}):
        stack = [roots[k : k + FRONT] for k in range(0, len(roots), FRONT)]
        while stack:
            f = stack.pop()
            # Ranges in which all rows have one label: nothing left to link between two of the same.
            changes = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
            lo1, hi1, lo2, hi2 = f[:, 0], f[:, 1], f[:, 2], f[:, 3]
            done = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (forest.label[lo1] == forest.label[lo2])
            f = f[~done & (f[:, 5] <= most)]
            small = ((f[:, 1] - f[:, 0] <= LEAF) & (f[:, 3] - f[:, 2] <= LEAF)) | (f[:, 4] >= 64)
            leaf, f = f[small], f[~small]
            if len(leaf):
                a_size, b_size = leaf[:, 1] - leaf[:, 0], leaf[:, 3] - leaf[:, 2]
                each = a_size * b_size
                of = np.repeat(np.arange(len(leaf)), each)
                k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                a, b = leaf[of, 0] + k // b_size[of], leaf[of, 2] + k % b_size[of]
                near = (a != b) & (popcount(fps[a] ^ fps[b]) <= most)
                forest.link(a[near], b[near])
            if not len(f):
                continue
            children = split(fps, f)
            for k in range(0, len(children), FRONT):
                stack.append(children[k : k + FRONT])
    return forest.label


def split(fps: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The child pairs of node pairs: each node parts at its next bit; unlike sides cost a bit."""
    bit = np.uint64(63) - f[:, 4].astype(np.uint64)

    def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            one = (fps[np.minimum(mid, len(fps) - 1)] >> bit) & np.uint64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)

    lo1, hi1, lo2, hi2, depth, err = f.T
    m1 = middle(lo1, hi1)
    same = (lo1 == lo2) & (hi1 == hi2)
    m2 = np.where(same, m1, middle(lo2, hi2))
    parts = [
        np.stack([lo1, m1, lo2, m2, depth + 1, err], 1),
        np.stack([m1, hi1, m2, hi2, depth + 1, err], 1),
        np.stack([lo1, m1, m2, hi2, depth + 1, err + 1], 1),
        np.stack([m1, hi1, lo2, m2, depth + 1, err + 1], 1)[~same],
    ]
    out = np.concatenate(parts)
    return out[(out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3])]


def blocks_for(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each of the ``budget + 1`` bit blocks."""
    widths = [64 // (budget + 1) + (k < 64 % (budget + 1)) for k in range(budget + 1)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def join_tries(rows: DataFrame, leads: list[int], budget: int, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Links ``a, b`` between the nodes of ``block, prefix, turned, node``: a forest per block, prefix and pair of salts.

    Linked are fingerprints ``turned`` of a block that agree in its first ``leads[block]`` bits and differ in at most
    ``budget``. Equal ones are linked to one of them first.
    """
    counts = rows.groupBy("block", "prefix").count().withColumn("salts", F.ceil(F.col("count") / salt_rows).cast("int")).drop("count")
    rows = rows.join(counts, ["block", "prefix"])
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    rows = rows.withColumn("salt", salt).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = rows.select("block", "prefix", F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "turned", "node")

    def run(group: pa.Table) -> pa.Table:
        fps, own = group.column("turned").to_numpy().view(np.uint64), group.column("node").to_numpy()
        by = np.lexsort((own, fps))
        own = own[by]
        fps, first, of = np.unique(fps[by], return_index=True, return_inverse=True)
        hub = own[first][trie_links(fps, leads[group.column("block")[0].as_py()], budget)][of]
        linked = hub != own
        return pa.table({"a": own[linked], "b": hub[linked]})

    return rows.groupBy("block", "prefix", "s1", "s2").applyInArrow(run, "a long, b long")


def links(classes: DataFrame, budget: int = BUDGET, task_rows: int = TASK_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Links between distinct fingerprints (``fp``) within the budget: ``a, b``, a forest per task."""
    n = classes.count()
    cut = max(0, math.ceil(math.log2(max(n, 1) / task_rows)))
    blocks = blocks_for(budget)
    cut = min(cut, min(w for _, w in blocks))
    u = F.col("fp")
    turned = [F.struct(F.lit(k).alias("block"), (F.shiftleft(u, at).bitwiseOR(F.shiftrightunsigned(u, 64 - at)) if at else u).alias("turned")) for k, (at, _) in enumerate(blocks)]
    rows = classes.select("fp", F.explode(F.array(*turned)).alias("t")).select(F.col("fp").alias("node"), "t.block", "t.turned")
    rows = rows.withColumn("prefix", F.shiftrightunsigned(F.col("turned"), 64 - cut) if cut else F.lit(0).cast("long"))
    return join_tries(rows, [w for _, w in blocks], budget, salt_rows)


# -- several fingerprints of a set of shingles -----------------------------------------------------


@dataclass(frozen=True)
class Wide:
    """How many fingerprints are taken, how many leading bits must agree and how many others may differ."""

    tables: int
    lead: int
    budget: int


def wide(rows: int, similarity: float, recall: float = RECALL) -> Wide:
    """What ``rows`` documents need for the recall of pairs of a Jaccard similarity.

    A bit of two sets differs with odds of the angle between them, whose cosine is 2 s / (1 + s) for sets of one size.
    """
    lead = max(LEAD, math.ceil(math.log2(max(rows, 1) / PREFIX_ROWS)))
    rest, p = 64 - lead, math.acos(2 * similarity / (1 + similarity)) / math.pi
    budget, unlike, near = -1, 0.0, 0.0
    while (unlike := unlike + math.comb(rest, budget + 1) / 2.0**64) <= FALSE:
        budget += 1
        near += math.comb(rest, budget) * p**budget * (1 - p) ** (rest - budget)
    near *= (1 - p) ** lead
    return Wide(max(1, math.ceil(math.log(1 - recall) / math.log(1 - near))), lead, budget)


def wide_prints(sets: list[np.ndarray], tables: int) -> np.ndarray:
    """Fingerprints of sets of 64-bit hashes, ``tables`` each: a bit is 1 if set in over half of the table's hashes.

    Bits are counted in vertical counters: 64 at once, by adding pairs of numbers whose digits are bit planes.
    """
    out = np.zeros((len(sets), tables), np.uint64)
    for low in range(0, len(sets), 256):
        part = sets[low : low + 256]
        sizes = np.array([len(s) for s in part])
        counts = np.zeros((len(part), tables, 64), np.int32)
        spans = [(k, a, min(a + SPAN, n)) for k, n in enumerate(sizes.tolist()) for a in range(0, n, SPAN)]
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for k, a, e in spans:
            by_width.setdefault(1 << (e - a - 1).bit_length(), []).append((k, a, e))
        for width, some in by_width.items():
            step = max(1, CELLS // (width * tables))
            for at in range(0, len(some), step):
                chunk = some[at : at + step]
                h, filled = np.zeros((len(chunk), width, 1), np.uint64), np.zeros((len(chunk), width, 1), np.uint64)
                for j, (k, a, e) in enumerate(chunk):
                    h[j, : e - a, 0] = part[k][a:e]
                    filled[j, : e - a] = ~np.uint64(0)
                planes = [C.mix64(h ^ SALTS[:tables]) & filled]
                while (half := planes[0].shape[1] // 2) > 0:
                    carry, summed = None, []
                    for x in planes:
                        a, b = x[:, :half], x[:, half:]
                        s, c = a ^ b, a & b
                        if carry is not None:
                            c |= s & carry
                            s ^= carry
                        summed.append(s)
                        carry = c
                    planes = [*summed, carry]
                total = np.zeros((len(chunk), tables, 64), np.int32)
                for j, x in enumerate(planes):
                    bits = np.unpackbits(np.ascontiguousarray(x[:, 0]).astype("<u8").view(np.uint8).reshape(len(chunk), tables, 8), axis=2, bitorder="little")
                    total += bits.astype(np.int32) << j
                np.add.at(counts, np.array([k for k, _, _ in chunk]), total)
        ones = counts * 2 > sizes[:, None, None]
        out[low : low + 256] = np.packbits(ones, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out


def wide_links(classes: DataFrame, shape: Wide, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Links ``a, b`` between classes (``key``, ``prints`` a fingerprint per table): a forest per task."""
    rows = classes.select(F.col("key").alias("node"), F.posexplode("prints").alias("block", "turned"))
    rows = rows.withColumn("prefix", F.shiftrightunsigned(F.col("turned"), 64 - shape.lead))
    return join_tries(rows, [shape.lead] * shape.tables, shape.budget, salt_rows)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE) -> DataFrame:
    """Per document: ``doc_id, fp`` (signed) and ``component_id``, the smallest ``doc_id`` of its component."""
    prints = C.written(fingerprints(docs, size), "fingerprints")
    classes = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes, budget))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = C.written(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every whole text of ``documents``."""
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
