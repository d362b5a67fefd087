import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_cases import in_order

from periplus.llm import common as C
from periplus.llm import line_templates, simhash_trie, substring_dedup, suffix_dedup


def covered(units, length, seen):
    """Mask of the units that a window seen before covers; adds the windows."""
    mask = [False] * len(units)
    for a in range(len(units) - length + 1):
        key = units[a : a + length]
        if key in seen:
            mask[a : a + length] = [True] * length
        else:
            seen.add(key)
    return mask


@pytest.mark.parametrize("source", ["unique", "many"])
@pytest.mark.parametrize("block_bytes", [3000, 6 << 20])
def test_substring(request, source, block_bytes):
    docs, seen, want = request.getfixturevalue(source), set(), {}
    for r in in_order(docs):
        ws = tuple((r["text"] or "").encode().split())
        mask = covered(ws, 20, seen)
        want[r["doc_id"]] = (len(ws), sum(mask), b" ".join(w for w, m in zip(ws, mask) if not m).decode())
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup_substrings(docs, block_bytes=block_bytes).collect()}
    assert got == want and any(v[1] for v in want.values())


def brute_substring(texts):
    """Words left of each text, in order."""
    seen, out = set(), []
    for text in texts:
        ws = tuple(text.encode().split())
        out.append(b" ".join(w for w, m in zip(ws, covered(ws, 20, seen)) if not m).decode())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substring_parts(spark, seed):
    """Passages that stand in overlapping parts, in the same block and in others, with few and many distinct words."""
    r = random.Random(seed)
    passage = [f"p{r.randrange(3 if seed % 2 else 999)}" for _ in range(160)]
    texts = []
    for k in range(40):
        ws = [f"u{k}x{j}" for j in range(r.randrange(15))]
        for _ in range(r.randrange(3)):
            a = r.randrange(150)
            ws += passage[a : a + r.randrange(10, 90)] + [f"v{k}"] * r.randrange(2)
        texts.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block_bytes in (600, 4000, 6 << 20):
        got = {x["doc_id"]: x["kept"] for x in substring_dedup.dedup_substrings(docs, block_bytes=block_bytes).collect()}
        assert [got[k] for k in range(40)] == brute_substring(texts)


def run_blocks(parts):
    """The passes of op1 over blocks, in this process: what each block keeps of its texts."""
    def block(n, docs):
        return C.Block(n, [i for i, _ in docs], [len(t.encode()) for _, t in docs], C.squeeze("".join(t for _, t in docs).encode()), [])

    def of(n):
        return substring_dedup.Words(block(n, parts[n]), 20)

    rows = [pa.RecordBatch.from_pylist([{"block": n, "doc_ids": [i for i, _ in d], "sizes": [len(t.encode()) for _, t in d], "body": C.squeeze("".join(t for _, t in d).encode()), "carry": [None] * len(d)}]) for n, d in enumerate(parts)]
    replies = substring_dedup.resolve(pa.Table.from_batches(substring_dedup.announce(iter(rows), 1, 20))).to_pylist()
    loans = [x for n in range(len(parts)) if (got := [(x["bucket"], x["codes"], x["wanted"], x["wanters"]) for x in replies if x["block"] == n]) for x in substring_dedup.lend(of(n), n, got, 1, 20)]
    out = []
    for n in range(len(parts)):
        w = of(n)
        codes = next((np.frombuffer(C.unsqueeze(d), np.uint8) for to, own, d in loans if to == n and own), None)
        lent = [t for to, own, d in loans if to == n and not own for t in C.unsqueeze(d).split(b"\n")]
        gone = substring_dedup.removed_words(w, codes, lent, 20)
        out.append([b" ".join(x for x, m in zip(ws, gone[a:].tolist()) if not m).decode() for ws, a in zip(w.words, w.starts.tolist())])
    return out


def test_substring_words_decide(monkeypatch):
    """The automata find what is removed, and equal hashes of unlike words remove nothing."""
    words = [f"w{k}" for k in range(90)]
    parts = [[(1, " ".join(words[:60]))], [(2, " ".join(words[10:40])), (3, " ".join(words[30:]))], [(4, "x " + " ".join(words[5:70]) + " y")]]
    want = brute_substring([t for p in parts for _, t in p])
    assert [t for p in run_blocks(parts) for t in p] == want and want[3] == "x y"
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "occurrences", lambda w, passages, window: np.zeros(len(w.ids), bool))
        assert run_blocks(parts) == [[t for _, t in p] for p in parts]
    unlike = [[(i, " ".join(f"a{i}b{k}" for k in range(30)))] for i in range(4)]
    monkeypatch.setattr(C, "mix64", lambda h: h & np.uint64(0))
    assert run_blocks(unlike) == [[t for _, t in p] for p in unlike]


@pytest.mark.parametrize("source", ["unique", "many"])
@pytest.mark.parametrize("block_bytes", [3000, 6 << 20])
def test_suffix(request, source, block_bytes):
    docs, seen, want = request.getfixturevalue(source), set(), {}
    for r in in_order(docs):
        text = (r["text"] or "").encode()
        mask = covered(text, 100, seen)
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        want[r["doc_id"]] = (len(text), sum(mask), spans, bytes(c for c, m in zip(text, mask) if not m))
    got = {r["doc_id"]: (*tuple(r)[1:4], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs, block_bytes=block_bytes).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_difference_cover():
    r = random.Random(5)
    for _ in range(800):
        s = np.array([r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(0, 60))], np.int64)
        assert suffix_dedup.difference_cover(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(fps, budget):
    """Smallest row reachable, by brute force."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("source", ["unique", "many"])
def test_simhash(request, source):
    docs = request.getfixturevalue(source)
    rows = in_order(docs)
    rows = [r for r in rows if r["doc_id"] is not None] + [r for r in rows if r["doc_id"] is None]
    fps = [fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f, rows[k]["doc_id"]) for r, f, k in zip(rows, fps, labels(fps, 4))}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash_trie.near_duplicates(docs).collect()}
    assert got == want


def test_trie_with_clusters_and_salts(spark):
    rng = np.random.default_rng(2)
    one = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, n)).astype(np.uint64), axis=0)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ one(150), base[0] ^ one(250) ^ one(250)]))
    want = labels([int(f) for f in fps], 4)
    assert simhash_trie.trie_links(fps, 0, 4).tolist() == want
    classes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = simhash_trie.components(simhash_trie.links(classes, 4, task_rows=50, salt_rows=40)).collect()
    by = {}
    for r in found:
        by.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
    sets = {}
    for f, k in zip(fps.tolist(), want):
        sets.setdefault(k, set()).add(f)
    assert sorted(map(sorted, by.values())) == sorted(sorted(s) for s in sets.values() if len(s) > 1)


def plain_mask(line):
    tokens = line.split()
    variable = [any(48 <= c <= 57 for c in t) for t in tokens]
    return tuple(t if all(variable) or not v else b"<*>" for t, v in zip(tokens, variable)), bool(tokens) and all(variable)


def brute_lines(rows, depth=2, similarity=0.8, min_docs=3):
    lines, leaves, drop = {}, {}, {}
    for doc, text in rows:
        for line in (text or "").encode().split(b"\n"):
            m, _ = plain_mask(line)
            if m:
                lines.setdefault(m, set()).add(doc)
    for m in sorted(lines, key=lambda x: (min(lines[x]), b" ".join(x))):
        fields = all(any(48 <= c <= 57 for c in t) for t in m)
        leaves.setdefault(m if fields else (len(m), *m[:depth]), []).append(m)
    for members in leaves.values():
        templates = []
        for m in members:
            best, most = None, similarity * len(m) - 1e-9
            for t in templates:
                pairs = list(zip(t[0], m))
                if any(a == b != b"<*>" for a, b in pairs) and (same := sum(a == b for a, b in pairs)) > most:
                    best, most = t, same
            if best is None:
                templates.append([m, [m]])
            else:
                best[0] = tuple(a if a == b else b"<*>" for a, b in zip(best[0], m))
                best[1].append(m)
        for _, group in templates:
            docs = set().union(*(lines[m] for m in group))
            if len(docs) >= min_docs:
                drop.update((m, min(docs)) for m in group)
    return {d: None if t is None else b"\n".join(x for x in t.encode().split(b"\n") if drop.get(plain_mask(x)[0], d) == d).decode() for d, t in rows}


def test_numbers_and_dates_are_content(spark):
    rows = [(k, f"{k} {k * 3}\n2024-01-{k:02d}\n1 2 3 4 {k}\n7 apples 8 9 {k}" if k % 2 else f"7 pears 8 9 {k}\n12 34") for k in range(1, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(df, min_docs=2).collect()}
    assert got == brute_lines(rows, min_docs=2)
    for k in range(1, 13, 2):
        assert got[k].startswith(f"{k} {k * 3}\n2024-01-{k:02d}\n1 2 3 4 {k}") and ("apples" in got[k]) == (k == 1)
    assert ["12 34" in got[k] for k in range(2, 13, 2)] == [True] + [False] * 5 and "pears" in got[2]


def test_random_lines_against_brute_force():
    r = random.Random(3)
    for trial in range(60):
        words = [b"w%s" % (b"abcdefgh"[k : k + 1]) for k in range(r.choice([2, 3, 8]))] + [b"1", b"22"]
        rows = [(k, "\n".join(" ".join(r.choice(words).decode() for _ in range(r.choice([1, 2, 5, 6, 11]))) for _ in range(6))) for k in range(30)]
        lines = {}
        for d, t in rows:
            for x in t.encode().split(b"\n"):
                lines.setdefault(line_templates.masked(x), set()).add(d)
        drops = line_templates.resolve_lines({k: sorted(v)[:2] for k, v in lines.items()}, 2, 0.8, 2)
        got = {d: "\n".join(x for x in t.split("\n") if drops.get(line_templates.masked(x.encode()), d) == d) for d, t in rows}
        assert got == brute_lines(rows, min_docs=2)


def test_a_crowded_leaf_takes_linear_time():
    import time

    r = random.Random(4)
    took = []
    for n in (5_000, 20_000):
        lines = {b"a b " + b" ".join(b"x%s" % "".join(r.choices("abcdefghij", k=5)).encode() for _ in range(3)): [k] for k in range(n)}
        began = time.process_time()
        line_templates.resolve_lines(lines, 2, 0.8, 2)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("block_bytes", [3000, 6 << 20])
def test_lines(spark, many, docs, nothing, block_bytes):
    want = brute_lines(sorted((r["doc_id"], r["text"]) for r in many.select("doc_id", "text").collect()))
    got = line_templates.drop_lines(many, block_bytes=block_bytes)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    logs = spark.createDataFrame([(k, f"user {k} logged in from host {k * 7} at noon\nown line {'abc'[k % 3]}" if k else None) for k in range(6)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(logs).collect()}
    assert out[0] is None and out[1].startswith("user 1") and all("logged" not in out[k] for k in range(2, 6))
    again = line_templates.drop_lines(docs)
    assert again.columns == [*docs.columns, "_n_lines", "_n_dropped"] and again.drop("_n_lines", "_n_dropped", "text").exceptAll(docs.drop("text")).count() == 0
    assert line_templates.drop_lines(nothing).count() == 0


def test_repeated_rows_and_empty_tables(docs, nothing):
    assert substring_dedup.dedup_substrings(docs).count() == 17 and suffix_dedup.dedup_bytes(docs).count() == 17
    assert simhash_trie.near_duplicates(docs).count() == 17
    for f in (substring_dedup.dedup_substrings, suffix_dedup.dedup_bytes, simhash_trie.near_duplicates):
        assert f(nothing).count() == 0


def test_contexts_in_segments_that_fit_the_cache(monkeypatch):
    """Any segments give the same strings the same keys; those in use take a megabyte an array at most."""
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(97, 100, int(n), np.uint8)) for n in r.integers(0, 3000, 40)]
    texts += [texts[3][500:900] + texts[5], texts[5]]
    block = C.Block(0, list(range(len(texts))), [len(t) for t in texts], C.squeeze(b"".join(texts)), [])

    def keys():
        c = suffix_dedup.Contexts(block, 100, 32)
        return {k: h for a, b, h in zip(c.low.tolist(), c.high.tolist(), c.hash.tolist()) for k in range(a, b + 1)}

    assert 8 * suffix_dedup.SEGMENT <= 1 << 20
    whole = keys()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 333)
    assert keys() == whole and len(whole) > 10_000


@pytest.mark.parametrize("length, gram", [(100, 32), (40, 8)])
def test_contexts_of_a_common_key_in_bounded_suffix_arrays(monkeypatch, length, gram):
    """A key in many surroundings, some equal for a few bytes and more: no array exceeds its bound, and no string is lost."""
    r, sizes, real = random.Random(8), [], suffix_dedup.later_strings
    letters = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    passage = letters(length * 7 // 10)
    near = [letters(r.randint(1, length // 3)) for _ in range(8)]
    texts = [letters(r.randint(0, 60)) + r.choice(near) + passage + r.choice(near) + letters(r.randint(0, 60)) for _ in range(400)]
    texts += [texts[3], b"x" + texts[5] + texts[5], b"", passage, b"a" * 700]
    r.shuffle(texts)
    seen = set()
    want = [covered(t, length, seen) for t in texts]
    blocks = [C.Block(k, list(range(k, len(texts), 2)), [len(t) for t in texts[k::2]], C.squeeze(b"".join(texts[k::2])), []) for k in range(2)]
    contexts, rows = [suffix_dedup.Contexts(b, length, gram) for b in blocks], []
    for b, c in zip(blocks, contexts):
        runs, _ = c.first_runs(np.arange(len(c.low)))
        rows.append({"bucket": 0, "block": b.block, "runs": C.squeeze(runs.tobytes()), "hashes": C.squeeze_planes(c.hash[runs]), "docs": C.squeeze_planes(b.order[c.doc[runs]]), "starts": C.squeeze_planes(c.low[runs]), "sizes": C.squeeze_planes(c.high[runs] - c.low[runs] + length), "body": C.squeeze(b"".join(c.text(k) for k in runs))})
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "later_strings", lambda texts, *a: sizes.append(sum(map(len, texts))) or real(texts, *a))
    replies = suffix_dedup.resolve_contexts(pa.Table.from_pylist(rows), length, gram).to_pylist()
    for b, c in zip(blocks, contexts):
        gone = suffix_dedup.covered(c, [x["data"] for x in replies if x["block"] == b.block])
        assert [gone[a:e].tolist() for a, e in zip(c.starts[:-1], c.starts[1:])] == want[b.block :: 2]
    assert max(sizes) <= 2 * suffix_dedup.BATCH_BYTES and any(map(any, want))
