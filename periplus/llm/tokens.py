"""Token ids of whole texts, by the tokenizers library with a cache of text units.

A byte-level BPE never merges across its pre-tokens, and a single space or line end between two other
characters always begins one. Texts are cut there, each distinct unit is encoded once, and the ids
of a text are joined from its units by numpy; the ids are those of encoding the whole text. The file
of the vocabulary is checked for this when it is loaded: with any other pre-tokenizer, a normaliser,
a prefix space, dropout or added tokens that could reach over a space, whole texts are encoded.

A new unit of Latin letters is one pre-token: the model gets it as it is, without the library's pre-tokenizer. Marks
after such letters are pre-tokens of their own, so their ids are joined to those of the letters.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units, and bytes of them and their ids, that a worker keeps at most; past either only units that came again stay
#: (none, where these alone are more than half).
CACHE_UNITS = 300_000
CACHE_BYTES = 48 << 20
#: Texts, and bytes of them, that are encoded at once (one longer text goes alone); few enough for the processor's cache.
SLICE_ROWS = 400
SLICE_BYTES = 1 << 20

#: White space that is not ASCII's common four, by Unicode (fixed values).
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Beside these, a line end may not be the only white space where it stands.
_LINES = ("\n\n", "\r", "\t")
#: What is no letter of Latin script: letters that every version of Unicode knows as such.
_NOT_LATIN = re.compile("[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
#: Marks of ASCII, but for the apostrophe, which contractions begin with.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Units that are encoded as one text, and such texts in a call.
_TOGETHER = 200
_CALLS = 10


def _plain(text: str) -> bool:
    """Whether every space stands between two characters that are no white space, or at an end."""
    return not any(x in text for x in _PAIRS) and (text.isascii() and text.isprintable() or not any(c in text for c in _RARE))


def _latin(units: list[str]) -> tuple[list[str], list[str]]:
    """Those that are made of Latin letters, and the others."""
    if not _NOT_LATIN.search("".join(units)):
        return units, []
    flags = [not _NOT_LATIN.search(u) for u in units]
    return list(compress(units, flags)), [u for u, good in zip(units, flags) if not good]


def _byte_letters() -> str:
    """The letter that a byte-level vocabulary writes for each byte; but 0 for a space's, and a space for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    letters = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
    letters[0], letters[32] = letters[32], " "
    return "".join(letters)


_LETTERS = _byte_letters()


def _strings(column: pa.Array) -> list[str]:
    """A column without nulls as strings: all at once, where none holds a zero."""
    ended = pc.binary_join_element_wise(column, *(pa.scalar(x, pa.large_string()) for x in ("", "\0")))
    size = np.frombuffer(ended.buffers()[1], np.int64)[len(column)]
    out = str(memoryview(ended.buffers()[2] or b"")[:size], "utf-8").split("\0")[:-1]
    return out if len(out) == len(column) else column.to_pylist()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def by_units(path: str) -> bool:
    """Whether a vocabulary file lets texts be cut at single spaces."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    added = spec.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None and spec.get("truncation") is None
        and model.get("type") == "BPE" and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    )


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a batch of ``doc_id, text``, a bounded part at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, min(low + rows, int(np.searchsorted(ends, before + size, "right"))))
        part = batch.slice(low, high - low)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        low = high


class UnitEncoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        #: The largest id: a vocabulary may have holes.
        self.top = max(vocab.values(), default=0)
        self.whole = not by_units(path)
        if not self.whole:
            self.tok.model._resize_cache(0)  # units come once; the library's own cache would only be filled
            #: The model alone, for pre-tokens in the vocabulary's letters, with spaces between them.
            self.model = Tokenizer(self.tok.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        #: Whether letters may be taken from the marks after them, or to the model: no added token begins with one.
        self.parted = not self.whole and not any(t.content[:1].isalpha() for t in self.tok.get_added_tokens_decoder().values())
        #: The id of a line end.
        self.line = vocab.get("Ċ", -1)
        #: Whether a token begins with a space (written as this letter in the vocabulary).
        self.spaced = np.zeros(self.top + 1, bool)
        for token, number in vocab.items():
            self.spaced[number] = token.startswith("Ġ")
        self._empty()

    def _empty(self) -> None:
        """Forget all units. ``data`` holds their ids one after another; unit k's are at ``begin[k]``, ``size[k]`` of them."""
        self.units: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.data, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        #: Whether a unit came again in later texts.
        self.again = np.zeros(1 << 14, bool)
        self.n, self.used, self.chars = 0, 0, 0

    def _shrink(self) -> None:
        """Keep the units that came again, as new ones; forget the others."""
        kept = np.flatnonzero(self.again[: self.n])
        number = np.full(self.n, -1, np.int64)
        number[kept] = np.arange(len(kept))
        places = number.tolist()
        units, heads = ({u: at for u, k in known.items() if (at := places[k]) >= 0} for known in (self.units, self.heads))
        size = self.size[kept]
        ends = np.cumsum(size)
        used, chars = int(size.sum()), sum(map(len, units)) + sum(map(len, heads))
        if len(kept) > CACHE_UNITS // 2 or 4 * used + chars > CACHE_BYTES // 2:
            return self._empty()
        data = self.data[np.repeat(self.begin[kept] - ends + size, size) + np.arange(used)]
        self._empty()
        self._store(data, size)
        self.units, self.heads, self.chars = units, heads, chars

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(ids)
        if n > len(self.size):
            self.begin, self.size, self.again = (np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)]) for a in (self.begin, self.size, self.again))
        if used > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(used - len(self.data), len(self.data)), np.uint32)])
        self.data[self.used : used] = ids
        self.size[self.n : n] = sizes
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def _keep(self, known: dict[str, int], units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known.update(zip(units, range(self.n, self.n + len(units))))
        self._store(ids, sizes)
        self.chars += len("".join(units))

    def _modelled(self, known: dict[str, int], units: list[str], lines: bool = False) -> list[str]:
        """Encode units of Latin letters, which a space stands before, or all a line end that they hold; returns those it can't."""
        left = []
        for low in range(0, len(units), _TOGETHER * _CALLS):
            part = units[low : low + _TOGETHER * _CALLS]
            groups = [part[k : k + _TOGETHER] for k in range(0, len(part), _TOGETHER)]
            texts = ["".join(g).replace("\n", " \n ") if lines else "\0" + " \0".join(g) for g in groups]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([codecs.charmap_decode(t.encode(), "strict", _LETTERS)[0] for t in texts], add_special_tokens=False)])
            begins = np.flatnonzero(ids == self.line if lines else self.spaced[ids])
            if len(begins) == len(part) and begins[0] == 0:
                self._keep(known, part, ids, np.diff(np.append(begins, len(ids))))
            else:
                left += part
        return left

    def _learn(self, known: dict[str, int], units: list[str], lead: str) -> None:
        """Encode heads of texts, or with a space as ``lead`` the units behind it and those that begin with a line end."""
        if not lead:
            return self._read(known, units, lead)
        rest, lines, marked, cores = [], [], [], []
        if not self.parted:
            rest = units
        else:
            flags = list(map(str.isalpha, units))
            letters = list(compress(units, flags))
            for u in compress(units, map(not_, flags)):
                core = u.rstrip(_MARKS)
                if not core.removeprefix("\n").isalpha():
                    rest.append(u)
                elif len(core) < len(u):
                    marked.append(u)
                    cores.append(core)
                else:
                    lines.append(u)
            if _NOT_LATIN.search("".join(cores).replace("\n", "")):
                good = [not _NOT_LATIN.search(c.lstrip("\n")) for c in cores]
                rest += [u for u, x in zip(marked, good) if not x]
                marked, cores = list(compress(marked, good)), list(compress(cores, good))
            more = {c for c in cores if c not in known}.difference(letters, lines)
            letters, others = _latin(letters + [c for c in more if c[0] != "\n"])
            after, strange = _latin([u[1:] for u in lines] + [c[1:] for c in more if c[0] == "\n"])
            rest += others + ["\n" + u for u in strange]
            rest += self._modelled(known, letters) + self._modelled(known, ["\n" + u for u in after], lines=True)
        spaced, whole = [u for u in rest if u[:1] != "\n"], [u for u in rest if u[:1] == "\n"]
        self._read(known, spaced, " ")
        self._read(known, whole, "")
        if marked:
            tails = [u[len(c) :] for u, c in zip(marked, cores)]
            self._read(self.heads, list({t for t in tails if t not in self.heads}), "")
            both = np.empty((len(marked), 2), np.int64)
            both[:, 0], both[:, 1] = list(map(known.__getitem__, cores)), list(map(self.heads.__getitem__, tails))
            self._keep(known, marked, self._joined(both.ravel()), self.size[both].sum(1))

    def _read(self, known: dict[str, int], units: list[str], lead: str) -> None:
        """Encode units by the library, with the space before each if ``lead`` is one.

        Units without white space at their ends or spaces inside are encoded many to a text; there, the tokens
        that begin with a space are the first ones of units.
        """
        rest = units
        if lead:
            whole = [u for u in units if u and u.strip() is u and " " not in u]
            rest = list(set(units).difference(whole)) if len(whole) < len(units) else []
            for low in range(0, len(whole), _TOGETHER * _CALLS):
                groups = [whole[k : k + _TOGETHER] for k in range(low, min(low + _TOGETHER * _CALLS, len(whole)), _TOGETHER)]
                found = self._raw([lead + " ".join(g) for g in groups])
                ids = np.concatenate(found)
                first = self.spaced[ids]
                each = np.add.reduceat(first, np.cumsum([0, *map(len, found[:-1])]), dtype=np.int64)
                if each.tolist() == list(map(len, groups)):
                    self._keep(known, whole[low : low + _TOGETHER * _CALLS], ids, np.diff(np.append(np.flatnonzero(first), len(ids))))
                else:
                    rest += whole[low : low + _TOGETHER * _CALLS]
        for k in range(0, len(rest), _TOGETHER * _CALLS):
            part = rest[k : k + _TOGETHER * _CALLS]
            ids = self._raw([lead + u for u in part])
            self._keep(known, part, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _joined(self, unit: np.ndarray) -> np.ndarray:
        """The ids of units one after another."""
        sizes = self.size[unit]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.begin[unit] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (with the end as the last)."""
        if self.whole or not texts:
            ids = self._raw(texts)
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)], dtype=np.int64)
        if self.n > CACHE_UNITS or 4 * self.used + self.chars > CACHE_BYTES:
            self._shrink()
        heads, bounds, place, words = self._units(texts)
        before = self.n
        known = np.fromiter(map(self.units.get, words, repeat(-1)), np.int64, len(words))
        if len(open_ := np.flatnonzero(known < 0)):
            new = [words[k] for k in open_.tolist()]
            self._learn(self.units, new, " ")
            known[open_] = list(map(self.units.__getitem__, new))
        if new := list({h for h in heads if h not in self.heads}):
            self._learn(self.heads, new, "")
        # The ids of the distinct units, and after them those of heads, side by side: then those of all units from there.
        unit = np.concatenate([known, np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))])
        self.again[unit[unit < before]] = True
        place[bounds[:-1]] = len(words) + np.arange(len(heads))
        near, sizes = self._joined(unit), self.size[unit]
        begin, size = (np.cumsum(sizes) - sizes)[place], sizes[place]
        ends = np.cumsum(size)
        return near[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])[bounds]

    def _units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """Each text's first unit (its head), where its units begin, each unit's place among the distinct ones, and these (without heads)."""
        column = pa.array(texts, pa.large_string())
        ends, parted, uncut = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1], {}, set()
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: ends[-1]]
        white = (raw == 32) | (raw == 10)
        # Control characters, first bytes of rare white space, and white space after white space.
        doubt = (raw < 32) & (raw != 10) | (raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3)
        doubt[1:] |= white[1:] & white[:-1]
        for k in set((np.searchsorted(ends, np.flatnonzero(doubt), "right") - 1).tolist()):
            if not _plain(t := texts[k]):
                parted[k] = _CUT.split(t)
            elif any(x in t for x in _LINES):
                uncut.add(k)
        if parted or uncut:
            column = pa.array(["" if k in parted else t if k in uncut else t.replace("\n", " \n") for k, t in enumerate(texts)], pa.large_string())
        else:
            column = pc.replace_substring(column, "\n", " \n")
        lists = pc.split_pattern(column, " ")
        values, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
        if parted:
            # Texts that are cut elsewhere take the places of the empty ones that stand for them.
            count = np.diff(bounds)
            runs, at = [], 0
            for k in sorted(parted):
                runs += [values.slice(at, bounds[k] - at), pa.array(parted[k], pa.large_string())]
                at, count[k] = bounds[k + 1], len(parted[k])
            values = pa.concat_arrays([*runs, values.slice(at)])
            bounds = np.concatenate([[0], np.cumsum(count)])
        coded = values.dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(place), bool)
        inner[bounds[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[place[inner]] = True
        return values.take(pa.array(bounds[:-1])).to_pylist(), bounds, (np.cumsum(used) - 1)[place], _strings(coded.dictionary.filter(pa.array(used)))

    def flat_with_end(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an end id after each text."""
        ids, bounds = self.flat(texts)
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(bounds))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        ids, bounds = self.flat(texts)
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist())]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
