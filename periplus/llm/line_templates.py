"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: first the number of tokens, then the ``depth`` leading tokens.
Tokens that hold a digit are variable fields from the start. In a leaf, lines join the template with
which they share the largest part of their tokens, if that is at least ``similarity`` of all and one constant token is
among them; positions where they differ become variable fields of the template. A line of variable fields alone
(numbers, dates) is content: it is its own template, with its tokens as they stand. A template that stands in at least
``min_docs`` documents is recurring: its lines are dropped, except in the document that has it first
(smallest ``doc_id``), so that copied text keeps one place.

Documents are packed into blocks; a block sends each distinct line (after masking) once to the bucket of
its leaf, with the ``min_docs`` smallest documents that have it (enough to decide whether ``min_docs`` have
the template, and which is first). A bucket therefore gets a row per line and block, however common
the line. Lines of a leaf are taken in the order of their first document and text, which makes the
templates independent of the partitioning. A leaf's templates are found through the pieces (of the tokens after
the leading ones) of which a line must share one to be similar enough, so a crowded leaf isn't searched as a whole,
and those that share a piece are compared at once. A leaf is one task's work.

Edge cases: null texts stay null and empty ones empty; lines without a token (blank ones) are no templates
and always stay; a null ``doc_id`` sorts first; rows that share a ``doc_id`` count as one document; an empty
table gives an empty result; all other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 2
SIMILARITY = 0.8
MIN_DOCS = 3
#: The corpus jobs (op7 and the pipeline) take a template that stands in two documents as recurring.
CORPUS_MIN_DOCS = 2

FIELD = b"<*>"
_DIGIT = re.compile(rb"\d")

MESSAGE = "bucket long, block long, lines binary"
REPLY = "block long, drops binary"


def masked(line: bytes) -> bytes:
    """A line's tokens, joined by spaces, with variable fields masked unless all are; empty for a blank line."""
    tokens = line.split()
    if _DIGIT.search(line):
        fields = [_DIGIT.search(t) is not None for t in tokens]
        if not all(fields):
            tokens = [FIELD if f else t for f, t in zip(fields, tokens)]
    return b" ".join(tokens)


def leaf_key(line: bytes, depth: int) -> bytes:
    """The leaf of a masked line: token count and leading tokens; the whole line if all tokens are variable fields."""
    head = line.split(b" ", depth)[:depth]
    if _DIGIT.search(line):  # what holds a digit after masking has no constant token
        return b"=" + line
    return b"\x00".join((b"%d" % (line.count(b" ") + 1), *head))


def block_lines(block: C.Block, depth: int, min_docs: int) -> dict[bytes, list[int]]:
    """Distinct masked lines of a block, each with its smallest documents."""
    seen: dict[bytes, list[int]] = {}
    for order, text in zip(block.order.tolist(), block.texts):  # ascending
        if text:
            for line in set(map(masked, text.split(b"\n"))):
                if line:
                    docs = seen.setdefault(line, [])
                    if len(docs) < min_docs and (not docs or docs[-1] != order):
                        docs.append(order)
    return seen


def encode_lines(rows: list[tuple[bytes, list[int]]]) -> bytes:
    return C.squeeze(b"\n".join(line + b"\x00" + b" ".join(b"%d" % d for d in docs) for line, docs in rows))


def decode_lines(data: bytes) -> list[tuple[bytes, list[int]]]:
    out = []
    for row in C.unsqueeze(data).split(b"\n"):
        line, _, docs = row.rpartition(b"\x00")
        out.append((line, [int(d) for d in docs.split(b" ")]))
    return out


class Numbers:
    """A growing array."""

    def __init__(self):
        self.data, self.n = np.empty(4, np.int64), 0

    def append(self, number: int) -> None:
        if self.n == len(self.data):
            self.data = np.concatenate([self.data, self.data])
        self.data[self.n] = number
        self.n += 1

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Leaf:
    """Templates of one leaf of the tree, as rows of token numbers; 0 is a variable field."""

    def __init__(self, similarity: float, depth: int):
        self.similarity, self.depth = similarity, depth
        self.known: dict[bytes, int] = {FIELD: 0}
        self.rows: np.ndarray | None = None
        self.n = 0
        self.by_piece: dict[tuple, Numbers] = defaultdict(Numbers)

    def _pieces(self, tokens: list[int]) -> Iterator[tuple]:
        # Of one part more than the tokens that may differ, one is shared wholly; the leading tokens are, always.
        rest = max(len(tokens) - self.depth, 0)
        parts = min(rest, int(len(tokens) * (1 - self.similarity) + 1e-9) + 1)
        for k in range(parts):
            a, b = self.depth + k * rest // parts, self.depth + (k + 1) * rest // parts
            yield (a, *tokens[a:b])

    def add(self, line: bytes) -> int:
        """Number of the template that the line joins or founds."""
        tokens = [self.known.setdefault(t, len(self.known)) for t in line.split(b" ")]
        if self.rows is None:
            self.rows = np.zeros((4, len(tokens)), np.int64)
        mine, pieces = np.array(tokens), list(self._pieces(tokens))
        found = [self.by_piece[p].all() for p in pieces if p in self.by_piece]
        near = np.concatenate(found) if found else np.arange(self.n if not pieces else 0)
        if len(near):
            equal = self.rows[near] == mine
            same = np.where((equal & (mine != 0)).any(axis=1), equal.sum(axis=1), -1)
            most = same.max()
            if most > self.similarity * len(tokens) - 1e-9:
                best = int(near[same == most].min())
                kept = np.where(self.rows[best] == mine, mine, 0)
                if (kept != self.rows[best]).any():
                    old = set(self._pieces(self.rows[best].tolist()))
                    self.rows[best] = kept
                    for p in set(self._pieces(kept.tolist())) - old:
                        self.by_piece[p].append(best)
                return best
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, self.rows])
        self.rows[self.n] = mine
        for p in pieces:
            self.by_piece[p].append(self.n)
        self.n += 1
        return self.n - 1


def resolve_lines(lines: dict[bytes, list[int]], depth: int, similarity: float, min_docs: int) -> dict[bytes, int]:
    """The first document of each line whose template recurs."""
    leaves: dict[bytes, list[bytes]] = defaultdict(list)
    for line in lines:
        leaves[leaf_key(line, depth)].append(line)
    out: dict[bytes, int] = {}
    for members in leaves.values():
        if len(members) == 1 and len(lines[members[0]]) < min_docs:
            continue
        members.sort(key=lambda x: (lines[x][0], x))
        leaf, groups = Leaf(similarity, depth), defaultdict(list)
        for line in members:
            groups[leaf.add(line)].append(line)
        for group in groups.values():
            docs = {d for line in group for d in lines[line]}
            if len(docs) >= min_docs:
                first = min(docs)
                out.update((line, first) for line in group)
    return out


def drop_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and ``_n_lines`` and ``_n_dropped``."""
    blocks = C.pack_blocks(docs, block_bytes, name="line-blocks", carry=True)
    n_buckets = max(1, blocks.count())

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in C.blocks_of(batch):
                to: dict[int, list] = defaultdict(list)
                for line, first in block_lines(block, depth, min_docs).items():
                    to[xxhash.xxh64_intdigest(leaf_key(line, depth)) % n_buckets].append((line, first))
                if to:
                    yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), pa.array([block.block] * len(to), pa.int64()), pa.array([encode_lines(v) for v in to.values()], pa.binary())], names=["bucket", "block", "lines"])

    def resolve(group: pa.Table) -> pa.Table:
        got = [decode_lines(x) for x in group.column("lines").to_pylist()]
        lines: dict[bytes, set[int]] = defaultdict(set)
        for rows in got:
            for line, first in rows:
                lines[line].update(first)
        drops = resolve_lines({k: sorted(v)[:min_docs] for k, v in lines.items()}, depth, similarity, min_docs)
        out = []
        for block, rows in zip(group.column("block").to_pylist(), got):
            mine = [(line, [drops[line]]) for line, _ in rows if line in drops]
            if mine:
                out.append((block, encode_lines(mine)))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "drops": pa.array([o[1] for o in out], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        first = {line: d[0] for x in (right.column("drops").to_pylist() if right.num_rows else []) for line, d in decode_lines(x)}
        rows = []
        for block in C.blocks_of(left):
            for doc, order, text, carry in zip(block.doc_ids, block.order.tolist(), block.texts, block.carry):
                if text is None:
                    rows.append((doc, None, carry, 0, 0))
                    continue
                lines = text.split(b"\n")
                kept = [x for x in lines if first.get(masked(x), order) == order]
                rows.append((doc, b"\n".join(kept).decode(), carry, len(lines), len(lines) - len(kept)))
        kinds = (("doc_id", pa.int64()), ("text", pa.string()), ("carry", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    messages = blocks.mapInArrow(announce, MESSAGE)
    replies = messages.groupBy("bucket").applyInArrow(resolve, REPLY)
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, "doc_id long, text string, carry string, n_lines long, n_dropped long")
    return _with_counts(out, docs)


def _with_counts(out: DataFrame, docs: DataFrame) -> DataFrame:
    names = C.others(docs)
    if names:
        out = out.withColumn("carry", F.from_json("carry", C.struct_of(docs, names)))
    cols = [F.col(c) if c in ("doc_id", "text") else F.col("carry").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols, F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    out = drop_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=CORPUS_MIN_DOCS)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
