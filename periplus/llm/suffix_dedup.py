"""Byte-level deduplication with suffix arrays from difference covers.

Every pair of equal ``length``-byte strings must meet in a suffix array. Which texts can meet is found
by content: the anchor of a string is the ``gram``-byte substring with the smallest hash in it, so equal
strings have equal anchors at equal offsets. An anchor has at least half of the other bytes on one side:
the anchor with that half (66 bytes of 100) is the string's *key*, of one of two sides by the anchor's offset. The
strings around one anchor occurrence with the same side form a *context*, a stretch of text. Three passes over
packed blocks:

1. Each block sends its distinct key hashes; buckets answer which of them other blocks have too.
2. Contexts whose key recurs (in its block or elsewhere) go to the bucket of the key, each
   distinct one once per block with its first place. A bucket sorts the suffixes of its contexts by the
   difference-cover algorithm: the suffixes at places not divisible by 3 are sorted by their triples,
   which are named; if names repeat, the algorithm recurses on the text of names; the other suffixes
   are sorted by first letter and following rank, and merged in. Adjacent suffixes with a common prefix of
   ``length`` bytes are equal strings; all but the first in ``(doc_id, start)`` are later occurrences.
3. The answers, a flag per string, are cogrouped with the blocks, which cut the bytes that are covered.

A pass sends a key once per block, so copies in any number cost a row per block. A bucket's contexts
are sorted in batches of ``BATCH_BYTES`` or little more that never part a key: an anchor that is common in many
surroundings is cut by them, and a key that has more than a batch of contexts is cut again by longer keys
(``later_by_longer_keys``). Comparison is exact: hashes only choose who meets.

Edge cases: a null text is empty; texts shorter than ``length`` are kept whole; a null ``doc_id`` sorts first;
rows that share a ``doc_id`` count as different documents, in the order of the blocks; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .substring_dedup import Words

LENGTH = 100
GRAM = 32
BATCH_BYTES = 1_500_000
#: Window starts that are hashed at once: their arrays (8 bytes each) stay in the processor's cache.
SEGMENT = 1 << 17

ANCHORS = "bucket long, block long, n long, hashes binary"
CONTEXTS = "bucket long, block long, runs binary, hashes binary, docs binary, starts binary, sizes binary, body binary"
REPLY = "block long, bucket long, data binary"


def difference_cover(s: np.ndarray) -> np.ndarray:
    """Suffix array of a text of letters >= 1, by sorting sampled triples and merging the rest."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = np.int64(t.max() + 1)
    # A text whose length is 1 modulo 3 takes a last empty triple, so that the two halves stay apart.
    m1 = np.arange(1, n + (n % 3 == 1), 3)
    m2 = np.arange(2, n, 3)
    sample = np.concatenate([m1, m2])
    pair = t[:-1] * top + t[1:]
    if top > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    values, names = np.unique(pair[sample] * top + t[sample + 2], return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(values) == len(sample):
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    else:
        order = difference_cover(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    m0 = np.arange(0, n, 3)
    width = np.int64(len(sample) + 2)
    m0 = m0[np.argsort(t[m0] * width + rank[m0 + 1])]
    # Merge: against places of residue 1 by (letter, rank), against residue 2 by (two letters, rank).
    residue = sorted_sample % 3
    ones, twos = sorted_sample[residue == 1], sorted_sample[residue == 2]
    if top <= 1 << 20 and (int(top) ** 2) * int(width) >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    below1 = np.searchsorted(t[ones] * width + rank[ones + 1], t[m0] * width + rank[m0 + 1])
    below2 = np.searchsorted(pair[twos] * width + rank[twos + 2], pair[m0] * width + rank[m0 + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(m0)) + below1 + below2
    out[at] = m0
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sorted_sample
    return out


class Contexts:
    """The contexts of a block: runs of string starts that share their anchor occurrence and side."""

    def __init__(self, block: C.Block, length: int, gram: int):
        texts = [t or b"" for t in block.texts]
        self.raw = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        a = np.frombuffer(self.raw, np.uint8)
        n = len(a)
        low, high, hashes = [], [], []
        ends = np.repeat(self.starts[1:], self.sizes)
        span = length - gram + 1
        half = span // 2
        for s in range(0, max(n - length + 1, 0), SEGMENT):
            e = min(s + SEGMENT, n - length + 1)
            letters = a[s : e + length - 1].astype(np.uint64) + np.uint64(1)
            rolled = Words.roll(letters, gram)
            key = (C.mix64(rolled) >> np.uint64(26) << np.uint64(26)) | np.arange(len(rolled), dtype=np.uint64)
            size = 1
            while size * 2 <= span:
                key = np.minimum(key[:-size], key[size:])
                size *= 2
            if size < span:
                key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
            at = (key & np.uint64((1 << 26) - 1)).astype(np.int64)
            inside = np.arange(s, e) + length <= ends[s:e]
            at = at[: e - s]
            first = inside.copy()
            first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
            goes_on = np.concatenate([inside[1:] & (at[1:] == at[:-1]), [False]])
            begin, end, anchor = np.flatnonzero(first), np.flatnonzero(inside & ~goes_on), at[first]
            # Strings with more than half of the other bytes before the anchor, and the others.
            left, right = begin < anchor - half, end >= anchor - half
            low += [begin[left] + s, np.maximum(begin, anchor - half)[right] + s]
            high += [np.minimum(end, anchor - half - 1)[left] + s, end[right] + s]
            hashes += [self.key(letters, rolled, anchor[left] - half, gram, half, 1), self.key(letters, rolled, anchor[right], gram, half, 2)]
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        by = np.argsort(cat(low, np.int64), kind="stable")
        #: First and last string start of each run, and the hash of its key.
        self.low, self.high, self.hash = cat(low, np.int64)[by], cat(high, np.int64)[by], cat(hashes, np.uint64)[by]
        self.length = length
        self.doc = np.searchsorted(self.starts, self.low, "right") - 1

    @staticmethod
    def key(letters: np.ndarray, rolled: np.ndarray, at: np.ndarray, gram: int, half: int, side: int) -> np.ndarray:
        """Hash of the ``gram + half`` letters at each place, from the rolled hashes of grams and single letters."""
        out, power, done = np.zeros(len(at), np.uint64), 1, 0
        step = pow(C.FACTOR, gram, 1 << 64)
        while done + gram <= gram + half:
            out += rolled[at + done] * np.uint64(power)
            power, done = power * step % (1 << 64), done + gram
        while done < gram + half:
            out += letters[at + done] * np.uint64(power)
            power, done = power * C.FACTOR % (1 << 64), done + 1
        return C.mix64(out + np.uint64(side))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.hash, return_inverse=True, return_counts=True)

    def text(self, run: int) -> bytes:
        return self.raw[self.low[run] : self.high[run] + self.length]

    def first_runs(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these runs, the first of each distinct text, and the others."""
        seen: dict[bytes, int] = {}
        first = np.zeros(len(runs), bool)
        lows, highs = self.low[runs].tolist(), (self.high[runs] + self.length).tolist()
        raw = self.raw
        for k, (a, b) in enumerate(zip(lows, highs)):
            text = raw[a:b]
            if text not in seen:
                seen[text] = k
                first[k] = True
        return runs[first], runs[~first]


def batch_of(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def bounds_of(bucket: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def resolve_anchors(group: pa.Table) -> pa.Table:
    """Which anchors of a bucket several blocks have."""
    bucket, blocks, sizes = group.column("bucket")[0].as_py(), group.column("block").to_pylist(), group.column("n").to_pylist()
    h = np.concatenate([np.cumsum(C.unsqueeze_planes(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("hashes")])
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    many = np.zeros(len(h), bool)
    many[by[1:][same]] = True
    many[by[:-1][same]] = True
    out = [(b, bucket, C.squeeze(np.packbits(many[e - n : e]).tobytes())) for b, n, e in zip(blocks, sizes, np.cumsum(sizes)) if many[e - n : e].any()]
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "bucket": pa.array([o[1] for o in out], pa.int64()), "data": pa.array([o[2] for o in out], pa.binary())})


def later_strings(texts: list[bytes], docs: np.ndarray, places: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For distinct contexts, the flags of the strings of each that stand in another one earlier.

    ``docs, places, starts``: the first place of each context as document, block and byte.
    """
    body = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    s = body.astype(np.int64) + 2
    s[at + sizes] = 1
    order = difference_cover(s)
    counts = sizes - length + 1
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(texts)), counts)
    string_at = np.full(len(s), -1, np.int64)
    string_at[at[of] + inner] = np.arange(len(of))
    number = string_at[order]
    number = number[number >= 0]
    begin = at[of] + inner
    # Compare adjacent prefixes, eight bytes at a time.
    equal = np.arange(len(number) - 1)
    words = np.lib.stride_tricks.sliding_window_view(body, 8)
    for o in [*range(0, length - 7, 8), length - 8]:
        a = words[begin[number[equal]] + o].copy().view(np.uint64).reshape(-1)
        b = words[begin[number[equal + 1]] + o].copy().view(np.uint64).reshape(-1)
        equal = equal[a == b]
    joined = np.zeros(len(number), bool)
    joined[equal + 1] = True
    group = np.cumsum(~joined)
    flags = np.zeros(len(of), bool)
    multi = np.zeros(len(number), bool)
    multi[equal] = True
    multi[equal + 1] = True
    rows, g = number[multi], group[multi]
    if len(rows):
        by = np.lexsort((starts[of[rows]] + inner[rows], places[of[rows]], docs[of[rows]], g))
        rows, g = rows[by], g[by]
        later = np.zeros(len(rows), bool)
        later[1:] = g[1:] == g[:-1]
        flags[rows[later]] = True
    return np.split(flags, np.cumsum(counts)[:-1])


def anchors_in(texts: list[bytes], length: int, gram: int) -> np.ndarray:
    """Where the anchor of each context stands: the first gram of smallest hash in what its strings share."""
    letters = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    h, at, out = C.mix64(Words.roll(letters, gram)) >> np.uint64(26), 0, np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        shared = len(t) - length
        out[k] = shared + h[at + shared : at + length - gram + 1].argmin()
        at += len(t)
    return out


def later_by_longer_keys(texts: list[bytes], docs: np.ndarray, places: np.ndarray, starts: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """As ``later_strings``, for contexts too large for one suffix array, in batches of at most ``BATCH_BYTES``.

    A key that lies in every string of its contexts is the anchor with some bytes on both sides. Of the bytes that
    a string has beside it, half lie on one side: with that half the key is longer, and cuts a context in two
    pieces. Equal strings have equal longer keys, and equal pieces count once. Keys grow until their pieces
    fit a batch; a key of ``length`` bytes has one distinct piece.
    """
    flags = [np.zeros(len(t) - length + 1, bool) for t in texts]
    low = 0
    anchors = np.empty(len(texts), np.int64)
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and size < BATCH_BYTES:
            size += len(texts[high])
            high += 1
        anchors[low:high] = anchors_in(texts[low:high], length, gram)
        low = high
    anchor, order = anchors.tolist(), list(zip(docs.tolist(), places.tolist(), starts.tolist()))

    def sort(batch: list[tuple[int, int, int]]) -> None:
        own, first = np.array([k for k, _, _ in batch]), np.array([a for _, a, _ in batch])
        found = later_strings([texts[k][a : b + length] for k, a, b in batch], docs[own], places[own], starts[own] + first, length)
        for (k, a, b), later in zip(batch, found):
            flags[k][a : b + 1] |= later

    # Bytes of the key before and after the anchor; pieces that have it: context, first and last string.
    todo: list[tuple[int, int, list[tuple[int, int, int]]]] = [(0, 0, [(k, 0, len(f) - 1) for k, f in enumerate(flags)])]
    batch: list[tuple[int, int, int]] = []
    filled = 0
    while todo:
        before, after, pieces = todo.pop()
        beside = length - gram - before - after
        left = (beside + 1) // 2
        right = beside - left + 1
        groups: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for k, a, b in pieces:
            t, begin, end = texts[k], anchor[k] - before, anchor[k] + gram + after
            cut = begin - left
            if a <= cut:
                groups.setdefault((0, t[cut:end]), []).append((k, a, min(b, cut)))
            if b > cut:
                groups.setdefault((1, t[begin : end + right]), []).append((k, max(a, cut + 1), b))
        for (side, _), group in groups.items():
            first: dict[bytes, tuple[int, int, int]] = {}
            for piece in sorted(group, key=lambda x: (*order[x[0]][:2], order[x[0]][2] + x[1])):
                k, a, b = piece
                if first.setdefault(texts[k][a : b + length], piece) is not piece:
                    flags[k][a : b + 1] = True
            size = sum(map(len, first))
            if len(first) == 1:
                continue
            if size > BATCH_BYTES:
                todo.append((before, after + right, list(first.values())) if side else (before + left, after, list(first.values())))
                continue
            if filled + size > BATCH_BYTES:
                sort(batch)
                batch, filled = [], 0
            batch += first.values()
            filled += size
    if batch:
        sort(batch)
    return flags


def resolve_contexts(group: pa.Table, length: int, gram: int = GRAM) -> pa.Table:
    """A bucket of contexts: flags of later strings, for each block's runs."""
    bucket = group.column("bucket")[0].as_py()
    entries: dict[bytes, list[tuple]] = {}
    hash_of: dict[bytes, int] = {}
    for k in range(group.num_rows):
        row = {c: group.column(c)[k].as_py() for c in ("block", "runs", "hashes", "docs", "starts", "sizes", "body")}
        runs = np.frombuffer(C.unsqueeze(row["runs"]), np.int64).tolist()
        hashes = C.unsqueeze_planes(row["hashes"], np.uint64).tolist()
        docs, starts, sizes = (C.unsqueeze_planes(row[c], np.int64).tolist() for c in ("docs", "starts", "sizes"))
        body, at = C.unsqueeze(row["body"]), 0
        for run, h, d, st, n in zip(runs, hashes, docs, starts, sizes):
            text = body[at : at + n]
            at += n
            entries.setdefault(text, []).append((d, row["block"], st, run))
            hash_of[text] = h
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    texts = sorted(entries, key=hash_of.__getitem__)
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (size < BATCH_BYTES or hash_of[texts[high]] == hash_of[texts[high - 1]]):
            size += len(texts[high])
            high += 1
        part = texts[low:high]
        first = [min(entries[t]) for t in part]
        keys = [np.array([f[j] for f in first], np.int64) for j in range(3)]
        later = later_strings(part, *keys, length) if size <= 2 * BATCH_BYTES else later_by_longer_keys(part, *keys, length, gram)
        for t, f, flags in zip(part, first, later):
            for e in entries[t]:
                mine = flags if e == f else np.ones(len(flags), bool)
                if mine.any():
                    out.setdefault(e[1], []).append((e[3], mine))
        low = high
    rows = []
    for block, found in out.items():
        found.sort(key=lambda x: x[0])
        head = C.squeeze(np.diff(np.array([r for r, _ in found], np.int64), prepend=0).tobytes())
        flags = C.squeeze(np.packbits(np.concatenate([f for _, f in found])).tobytes())
        rows.append((block, bucket, len(head).to_bytes(8, "little") + head + flags))
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})


def covered(c: Contexts, replies: list[bytes]) -> np.ndarray:
    """Mask of the block's bytes that a later string covers."""
    length, gone = c.length, np.zeros(len(c.raw) + 1, np.int32)

    def cut(starts: np.ndarray) -> None:
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + length, -1)

    values, inverse, counts = c.distinct()
    _, again = c.first_runs(np.flatnonzero(counts[inverse] > 1))
    gone_runs = np.zeros(len(c.low), bool)
    gone_runs[again] = True
    np.add.at(gone, c.low[gone_runs], 1)
    np.add.at(gone, c.high[gone_runs] + length, -1)
    for data in replies:
        n = int.from_bytes(data[:8], "little")
        runs = np.cumsum(np.frombuffer(C.unsqueeze(data[8 : 8 + n]), np.int64))
        counts = c.high[runs] - c.low[runs] + 1
        flags = np.unpackbits(np.frombuffer(C.unsqueeze(data[8 + n :]), np.uint8))[: counts.sum()].astype(bool)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        cut((np.repeat(c.low[runs], counts) + inner)[flags])
    return np.cumsum(gone)[:-1] > 0


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left)."""
    blocks = C.pack_blocks(docs, block_bytes, name="suffix-blocks")
    n = max(1, blocks.count())

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in C.blocks_of(batch):
                values = np.unique(Contexts(block, length, gram).hash)
                rows = [(int(b), block.block, e - a, C.squeeze_planes(np.diff(values[a:e], prepend=np.uint64(0)))) for (a, e), b in ((x, C.bucket_of(values[x[0] : x[0] + 1], n)[0]) for x in bounds_of(C.bucket_of(values, n)) if x[1] > x[0])]
                if rows:
                    yield batch_of(rows, ["bucket", "block", "n", "hashes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        got = list(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist())) if right.num_rows else []
        for block in C.blocks_of(left):
            c = Contexts(block, length, gram)
            values, inverse, counts = c.distinct()
            recurs = counts > 1
            bucket = C.bucket_of(values, n)
            for b, data in got:
                a, e = np.searchsorted(bucket, np.uint64(b)), np.searchsorted(bucket, np.uint64(b), "right")
                recurs[a:e] |= np.unpackbits(np.frombuffer(C.unsqueeze(data), np.uint8))[: e - a].astype(bool)
            runs, _ = c.first_runs(np.flatnonzero(recurs[inverse]))
            to = C.bucket_of(c.hash[runs], n)
            by = np.lexsort((c.hash[runs], to))
            runs, to = runs[by], to[by]
            for a, e in bounds_of(to):
                part = runs[a:e]
                if len(part):
                    body = b"".join([c.text(r) for r in part.tolist()])
                    rows.append((int(to[a]), block.block, C.squeeze(part.tobytes()), C.squeeze_planes(c.hash[part]), C.squeeze_planes(block.order[c.doc[part]]), C.squeeze_planes(c.low[part]), C.squeeze_planes(c.high[part] - c.low[part] + length), C.squeeze(body, 3)))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in ("runs", "hashes", "docs", "starts", "sizes", "body"))))})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for block in C.blocks_of(left):
            c = Contexts(block, length, gram)
            gone = covered(c, right.column("data").to_pylist() if right.num_rows else [])
            for k, (doc, size) in enumerate(zip(block.doc_ids, c.sizes.tolist())):
                mask = gone[c.starts[k] : c.starts[k + 1]]
                text = np.frombuffer(c.raw, np.uint8)[c.starts[k] : c.starts[k + 1]]
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                rows.append((doc, size, int(mask.sum()), spans, text[~mask].tobytes()))
        kinds = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    anchors = blocks.mapInArrow(announce, ANCHORS).groupBy("bucket").applyInArrow(resolve_anchors, REPLY)
    contexts = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send, CONTEXTS)
    replies = contexts.groupBy("bucket").applyInArrow(lambda g: resolve_contexts(g, length, gram), REPLY)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole text of ``documents`` as UTF-8 bytes, strings of 100 bytes."""
    out = dedup_bytes(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
