"""Substring deduplication with repeated-phrase automata.

1. *Nominate.* Documents are packed into blocks. A block hashes every window of ``window``
   consecutive words (64 bits, rolled over exact words) and sends each distinct hash once, with the
   document that holds it first, to the bucket of the hash. A bucket finds the hashes that several
   blocks sent; the block with the first occurrence (smallest ``doc_id``) is the owner. It tells the
   owner who else sent the hash, and the others that somebody else is earlier.
2. *Confirm.* An owner cuts the words at its first occurrences into passages, maximal runs of windows
   that one other block sent, and lends each such block the words of its passages.
3. *Compile and stream.* A block compiles the passages lent to it, and those of its own first
   occurrences that recur inside it, into Aho-Corasick automata, in shards of at most ``SHARD_CHARS``
   characters, and streams all its documents through every shard. Only hits of the automata remove
   words: any hit of a lent passage, and hits of its own passages but for the first occurrences.
   A passage may stand here in parts only; windows that were nominated and not hit are looked for
   again, as single windows of the same passages.

Hashes only choose who meets; words decide. (If windows of different words had one hash, the block
with the first of them would own both: nothing is removed wrongly, a repeat may be left, with
odds of 2^-64 per pair of windows.)

A key costs one row per block at most, and passages travel once per owner and block, so a passage
that a third of all documents share is no hot spot. Memory is bounded by the block, the bucket, the
automaton shard and what an owner lends, which is at most the distinct text that the others repeat.

Edge cases: null and empty texts have no words and keep none; a null ``doc_id`` sorts first; rows
that share a ``doc_id`` count as different documents, in the order of the blocks; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
#: Characters of passages in one automaton (about 60 bytes of memory each).
SHARD_CHARS = 1_500_000

MESSAGE = "bucket long, block long, n long, doc_ids binary, hashes binary, docs binary"
#: To a block: codes of the hashes it sent, and for those it owns, which (place in the message) are wanted by whom.
REPLY = "block long, bucket long, codes binary, wanted binary, wanters binary"
#: From an owner: its own codes, or passages (lines) for another block.
LOAN = "block long, own boolean, data binary"
#: Codes of a block's distinct hashes: seen elsewhere later (owner), seen elsewhere earlier.
OWNER, LATER = 1, 2


class Words:
    """A block's documents as exact word numbers, with the rolling hash of every window."""

    def __init__(self, block: C.Block, window: int):
        known: dict[bytes, int] = {}
        ids: list[int] = []
        self.streamed: tuple[str, np.ndarray] | None = None
        self.words = [t.split() if t else [] for t in block.texts]
        for ws in self.words:
            ids += [known.setdefault(w, len(known)) for w in ws]
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        n = len(self.ids)
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        self.doc = np.repeat(np.arange(len(self.words)), self.sizes)
        #: Where a window starts: those that end in the same document.
        at = np.arange(n - window + 1) if n >= window else np.zeros(0, np.int64)
        self.at = at[self.doc[at] == self.doc[at + window - 1]] if len(at) else at
        self.hash = C.mix64(self.roll(hashed[self.ids] if n else np.zeros(0, np.uint64), window)[self.at]) if len(self.at) else np.zeros(0, np.uint64)

    @staticmethod
    def roll(x: np.ndarray, window: int) -> np.ndarray:
        """Polynomial hash of each window, by doubling."""
        mult = C.FACTOR
        out, done, power = None, 0, 1
        part, size, part_power = x, 1, mult
        while window:
            if window & 1:
                if out is None:
                    out = part
                else:
                    m = min(len(out), len(part) - done)
                    out = out[:m] + part[done : done + m] * np.uint64(power)
                done += size
                power = power * part_power % (1 << 64)
            window >>= 1
            if window:
                part = part[: len(part) - size] + part[size:] * np.uint64(part_power)
                part_power = part_power * part_power % (1 << 64)
                size *= 2
        return out

    def stream(self) -> tuple[str, np.ndarray]:
        """All documents as one string (a space around each word, a line end between documents), and where the space after each word is."""
        if self.streamed is None:
            text = b"\n".join(b" %b " % b" ".join(ws) for ws in self.words).decode("latin-1")
            # A document takes a leading space, its words with a space each, and a line end.
            lengths = np.fromiter((len(x) + 1 for ws in self.words for x in ws), np.int64, len(self.ids))
            ends = np.cumsum(lengths)
            chars = np.concatenate([[0], ends])[self.starts]
            heads = np.concatenate([[0], np.cumsum(np.where(self.sizes > 0, np.diff(chars) + 2, 3))])
            self.streamed = text, ends - chars[self.doc] + heads[self.doc]
        return self.streamed

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes, the first window of each and how many it has."""
        values, first, counts = np.unique(self.hash, return_index=True, return_counts=True)
        return values, first, counts


def announce(batches: Iterator[pa.RecordBatch], n_buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Messages of each block, one per bucket with hashes in it."""
    for batch in batches:
        for block in C.blocks_of(batch):
            w = Words(block, window)
            values, first, _ = w.distinct()
            docs = w.doc[w.at[first]].astype(np.uint16)
            bucket = C.bucket_of(values, n_buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            bounds = np.concatenate([[0], cuts, [len(values)]]) if len(values) else np.zeros(1, np.int64)
            rows: list[tuple] = []
            ids = C.squeeze(np.diff(block.order, prepend=np.int64(0)).tobytes())
            for a, b in zip(bounds[:-1], bounds[1:]):
                rows.append((int(bucket[a]), block.block, int(b - a), ids, C.squeeze_planes(np.diff(values[a:b], prepend=np.uint64(0))), C.squeeze_planes(docs[a:b])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "n", "doc_ids", "hashes", "docs"])


def resolve(group: pa.Table) -> pa.Table:
    """One bucket: which hashes came from several blocks, and who has the first occurrence."""
    blocks, sizes = group.column("block").to_pylist(), group.column("n").to_pylist()
    bucket = group.column("bucket")[0].as_py()
    h, keys = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64)
    at = 0
    for k, n in enumerate(sizes):
        h[at : at + n] = np.cumsum(C.unsqueeze_planes(group.column("hashes")[k].as_py(), np.uint64), dtype=np.uint64)
        order = np.cumsum(np.frombuffer(C.unsqueeze(group.column("doc_ids")[k].as_py()), np.int64))
        keys[at : at + n] = order[C.unsqueeze_planes(group.column("docs")[k].as_py(), np.uint16)]
        at += n
    by = np.argsort(h, kind="stable")
    s = h[by]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    codes = np.zeros(len(h), np.uint8)
    rows = by[many]
    sender = np.repeat(np.arange(len(blocks)), sizes)
    names, ends = np.array(blocks, np.int64), np.cumsum(sizes)
    rows = rows[np.lexsort((names[sender[rows]], keys[rows], h[rows]))]
    lead = np.ones(len(rows), bool)
    lead[1:] = h[rows][1:] != h[rows][:-1]
    codes[rows] = np.where(lead, OWNER, LATER)
    owned = rows[np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))][~lead]
    wanters = names[sender[rows[~lead]]]
    by = np.argsort(owned, kind="stable")
    owned, wanters = owned[by], wanters[by]
    out: list[tuple] = []
    for k, (block, n, e) in enumerate(zip(blocks, sizes, ends.tolist())):
        if codes[e - n : e].any():
            low, high = np.searchsorted(owned, [e - n, e])
            out.append((block, bucket, C.squeeze(codes[e - n : e].tobytes()), packed(owned[low:high] - (e - n)), packed(wanters[low:high])))
    kinds = (("block", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary()), ("wanted", pa.binary()), ("wanters", pa.binary()))
    return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(kinds)})


def packed(a: np.ndarray) -> bytes:
    return C.squeeze_planes(np.diff(a.astype(np.int64), prepend=np.int64(0))) if len(a) else b""


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(C.unsqueeze_planes(data, np.int64)) if data else np.zeros(0, np.int64)


def passages_at(w: Words, starts: np.ndarray, window: int) -> list[bytes]:
    """The words of the maximal runs of windows at ``starts`` (sorted), each run once."""
    if not len(starts):
        return []
    breaks = np.flatnonzero((np.diff(starts) > 1) | (np.diff(w.doc[starts]) > 0))
    first, last = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]
    runs: dict[bytes, None] = {}
    for a, b, d in zip(first.tolist(), last.tolist(), w.doc[first].tolist()):
        base = int(w.starts[d])
        runs.setdefault(b" ".join(w.words[d][a - base : b - base + window]))
    return list(runs)


def lend(w: Words, block: int, replies: list[tuple[int, bytes, bytes, bytes]], n_buckets: int, window: int) -> Iterator[tuple]:
    """Rows of ``LOAN``: the block's codes for itself, and for every other block the passages it wants."""
    values, first, _ = w.distinct()
    codes = np.zeros(len(values), np.uint8)
    bucket = C.bucket_of(values, n_buckets)
    wanted, wanters = [], []
    for b, data, places, names in replies:
        a = int(np.searchsorted(bucket, np.uint64(b)))
        got = np.frombuffer(C.unsqueeze(data), np.uint8)
        codes[a : a + len(got)] = got
        wanted.append(unpacked(places) + a)
        wanters.append(unpacked(names))
    yield block, True, C.squeeze(codes.tobytes())
    place, to = w.at[first[np.concatenate(wanted)]], np.concatenate(wanters)
    by = np.lexsort((place, to))
    place, to = place[by], to[by]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
    for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e > a:
            yield int(to[a]), False, C.squeeze(b"\n".join(passages_at(w, place[a:e], window)))


def occurrences(w: Words, passages: list[bytes], window: int) -> np.ndarray:
    """Mask of the window starts at which windows of a passage stand, found by automata.

    Every document of the block is streamed through the automata of all passages.
    """
    found = np.zeros(len(w.ids) + 1, np.int32)
    if not passages:
        return found[:-1] > 0
    stream, after = w.stream()

    def stream_through(part: list[bytes]) -> None:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text in part:
            automaton.add_word(f" {text.decode('latin-1')} ", text.count(b" ") + 1)
        automaton.make_automaton()
        hits = np.fromiter((x for hit in automaton.iter(stream) for x in hit), np.int64).reshape(-1, 2)
        word = np.searchsorted(after, hits[:, 0])
        np.add.at(found, word - hits[:, 1] + 1, 1)
        np.add.at(found, word - window + 2, -1)

    part, size = [], 0
    for text in passages:
        if part and size + len(text) > SHARD_CHARS:
            stream_through(part)
            part, size = [], 0
        part.append(text)
        size += len(text)
    stream_through(part)
    return np.cumsum(found)[:-1] > 0


def located(w: Words, passages: list[bytes], nominated: np.ndarray, window: int) -> np.ndarray:
    """Mask of the window starts that hold windows of the passages, whole passages or parts of them.

    ``nominated`` are the starts where hashes say so; those that no whole passage covers are looked for by single windows.
    """
    found = occurrences(w, passages, window)
    missed = nominated[~found[nominated]]
    if len(missed) and passages:
        texts = set()
        for p, d in zip(missed.tolist(), w.doc[missed].tolist()):
            base = int(w.starts[d])
            texts.add(b" ".join(w.words[d][p - base : p - base + window]))
        single: dict[bytes, None] = {}
        for text in passages:
            ws = text.split()
            for k in range(len(ws) - window + 1):
                one = b" ".join(ws[k : k + window])
                if one in texts:
                    single.setdefault(one)
        found |= occurrences(w, list(single), window)
    return found


def removed_words(w: Words, codes: np.ndarray | None, lent: list[bytes], window: int) -> np.ndarray:
    """Mask of the block's words that a later occurrence covers."""
    values, first, rank, counts = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    codes = np.zeros(len(values), np.uint8) if codes is None else codes
    places = located(w, lent, w.at[(codes == LATER)[rank]], window)
    own = (counts > 1) & (codes != LATER)
    starts = np.sort(w.at[first[own]])
    again = located(w, passages_at(w, starts, window), w.at[own[rank]], window)
    again[w.at[first]] = False  # the first occurrence of all stays
    gone = np.zeros(len(w.ids) + 1, np.int32)
    at = np.flatnonzero(places | again)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    return np.cumsum(gone)[:-1] > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept`` (the words left, joined by a space)."""
    blocks = C.pack_blocks(docs, block_bytes, name="substring-blocks")
    n_buckets = max(1, blocks.count())
    messages = blocks.mapInArrow(lambda it: announce(it, n_buckets, window), MESSAGE)
    replies = messages.groupBy("bucket").applyInArrow(resolve, REPLY)

    def loans_of(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if right.num_rows:
            got = list(zip(*(right.column(c).to_pylist() for c in ("bucket", "codes", "wanted", "wanters"))))
            for block in C.blocks_of(left):
                rows += lend(Words(block, window), block.block, got, n_buckets, window)
        kinds = (("block", pa.int64()), ("own", pa.bool_()), ("data", pa.binary()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    loans = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(loans_of, LOAN)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        got = list(zip(right.column("own").to_pylist(), right.column("data").to_pylist())) if right.num_rows else []
        codes = next((np.frombuffer(C.unsqueeze(data), np.uint8) for own, data in got if own), None)
        lent = list(dict.fromkeys(text for own, data in got if not own for text in C.unsqueeze(data).split(b"\n")))
        for block in C.blocks_of(left):
            w = Words(block, window)
            gone = removed_words(w, codes, lent, window)
            for k, ws in enumerate(w.words):
                mask = gone[w.starts[k] : w.starts[k + 1]]
                kept = [x for x, m in zip(ws, mask.tolist()) if not m] if mask.any() else ws
                rows.append((block.doc_ids[k], len(ws), int(mask.sum()), b" ".join(kept).decode()))
        kinds = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    return blocks.groupBy("block").cogroup(loans.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every whole text of ``documents``, windows of 20 words."""
    out = dedup_substrings(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
