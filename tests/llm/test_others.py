import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import in_order

import corpus_pipeline
from periplus.llm import bitpack_ids, license_scan, license_texts, mixing_pareto, packing_kk, quality_rules, tokens


def plain_ids(texts):
    tok = tokens.encoder(tokens.default_path()).tok
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_units_give_the_ids_of_whole_texts():
    texts = ["", "  a  b \n c", "x <|endoftext|> y<|endoftext|>  z", " lead", "trail ", "a\n\n b  \t c d 　e\x1c f  g", "  ", "\n", " \n", "it's 12 don't", "été über \U0001f600 ok", "a  b \x85 c"]
    got = tokens.UnitEncoder(tokens.default_path()).encode(texts * 2)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids(texts) * 2


def test_units_of_letters_and_marks():
    draw = np.random.default_rng(6)
    parts = ["a", "be", "The", "é", "ñandú", "ß", "ǆ", "中", "я", "ª", "ʰ", "7", "½", ".", ",", "'", "'s", "'ll", "$$", "<|endoftext|>", "|>", "_", "×", "\n", "\n", "\n\n", " ", " ", " ", " ", "  ", "\t", "\r\n", "\x00", "\x0b", "\x85", "　", "\U0001f600"]
    texts = ["".join(draw.choice(parts, n)) for n in draw.integers(0, 60, 4000)]
    # Many texts with neither rare white space nor pairs of it, together and beside others.
    texts += ["".join(draw.choice(parts[:30], n)).replace("\n\n", "\n") for n in draw.integers(0, 60, 2000)] + [" ".join(draw.choice(parts[:22], n)) for n in draw.integers(0, 60, 1000)]
    enc, want = tokens.UnitEncoder(tokens.default_path()), plain_ids(texts)
    for k in (1, 7, 1000):
        got = [g for low in range(0, len(texts), k) for g in enc.encode(texts[low : low + k])]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert enc.flat([])[0].tolist() == [] and enc.flat([])[1].tolist() == [0]


def test_new_words_go_to_the_model_without_their_marks(monkeypatch):
    letters = [a + b + c for a in "abcdefghij" for b in ("éta", "ino", "sul") for c in "klmnopqrst"]
    text = " ".join(letters) + "." + "".join(f"\n{w.title()} {w}, {w}. {w}$$$" for w in letters)
    enc, read = tokens.UnitEncoder(tokens.default_path()), []
    monkeypatch.setattr(enc, "_raw", lambda texts, raw=enc._raw: read.extend(texts) or raw(texts))
    got = [np.frombuffer(g, "<u4").tolist() for g in enc.encode([text])]
    assert got == plain_ids([text])
    assert len("".join(read)) < 50  # of 10,000: the head, and each run of marks


def test_packing(docs, nothing, many):
    for df in (docs, many):
        rows = df.select("doc_id", "text").collect()
        want = defaultdict(list)
        for r, ids in zip(rows, plain_ids([r["text"] for r in rows])):
            want[r["doc_id"]].append(np.array([*ids, 0], "<u4").tobytes())
        out = packing_kk.pack(df, capacity=256, batch=8).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for p in out:
            sequences[p["sequence_id"]].append(p)
            pieces[p["doc_id"]].append(p)
            assert len(p["ids"]) == 4 * p["length"] and 0 < p["length"] <= 256
        for s in sequences.values():
            s.sort(key=lambda p: p["offset"])
            assert [p["offset"] for p in s] == [0, *np.cumsum([p["length"] for p in s])[:-1].tolist()] and sum(p["length"] for p in s) <= 256
        for doc, ps in pieces.items():
            copies = len(want[doc])
            by_start = defaultdict(list)
            for p in ps:
                by_start[p["start"]].append(bytes(p["ids"]))
            assert all(len(v) == copies for v in by_start.values()) and b"".join(by_start[k][0] for k in sorted(by_start)) == want[doc][0]
        assert len(pieces) == len(want)
    used = sum(p["length"] for p in out)
    assert used / (256 * len(sequences)) > 0.95
    assert packing_kk.pack(nothing).count() == 0


def check_windows(sizes, capacity):
    pieces, m = packing_kk.windows(sizes, capacity)
    loads = np.bincount([w for *_, w in pieces], [n for _, _, n, _ in pieces], m)
    assert loads.max() <= capacity and all(n > 0 for _, _, n, _ in pieces)
    for k, size in enumerate(sizes):
        spans = sorted((a, a + n) for j, a, n, _ in pieces if j == k)
        assert spans[0][0] == 0 and spans[-1][1] == size and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    return pieces, m


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 200, 300).tolist()
    sums = np.bincount(packing_kk.differencing(sizes, 30), sizes, 30)
    assert sums.max() - sums.min() < 20
    loads = rng.integers(0, 900, 30)
    sums = loads + np.bincount(packing_kk.differencing(sizes, 30, loads), sizes, 30)
    assert sums.max() - sums.min() < 20
    assert check_windows([1024, 1024, 1], 1024)[1] == 3
    assert check_windows([600, 600, 600], 1024) == ([(0, 0, 600, 0), (1, 0, 600, 1), (2, 0, 424, 0), (2, 424, 176, 1)], 2) or check_windows([600, 600, 600], 1024)[1] == 2


def test_packing_at_its_own_size():
    """Batches of 128 windows of 1024: little padding, and most rests in one piece."""
    rng = np.random.default_rng(2)
    for low, high in ((1, 1024), (400, 1024), (1, 60)):
        sizes = []
        while sum(sizes) < 128 * 1024:
            sizes.append(int(rng.integers(low, high)))
        pieces, m = check_windows(sizes, 1024)
        assert sum(sizes) / (1024 * m) > 0.97 and len(pieces) < 1.8 * len(sizes)


def test_bits():
    rng = np.random.default_rng(3)
    for width in (1, 3, 7, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << width, 1000).astype(np.uint32)
        data = bitpack_ids.pack_bits(ids, width)
        assert len(data) == 16 * 8 * width and (bitpack_ids.unpack_bits(data, width, 1000) == ids).all()


def test_token_files(spark, docs, nothing):
    rows = in_order(docs)
    manifest = bitpack_ids.write_ids(docs, block_ids=128)
    got = sorted(bitpack_ids.read_ids(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for r, g, ids in zip(rows, got, plain_ids([r["text"] for r in rows])):
        ids = [*ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r["doc_id"], start, len(ids)) and bytes(g["ids"]) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    assert len(got) == len(rows)
    path = manifest.orderBy("part").first()["path"]
    system, at = bitpack_ids._filesystem(path)
    with system.open_input_file(at) as f:
        reader = bitpack_ids.Reader(f, f.size())
        assert reader.width == 16 and (reader.ids(5, 300) == reader.ids(0, 400)[5:300]).all()
    assert bitpack_ids.read_ids(bitpack_ids.write_ids(nothing)).count() == 0


def duck_rows(df, sql):
    c = duckdb.connect()
    table = df.toArrow()
    c.register("documents", table)
    return rows_of(c.sql(sql).to_arrow_table())


def rows_of(table):
    names = sorted(table.column_names)
    show = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(show(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in names)))


QUALITY = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_sql_twins(docs, nothing, many):
    for df in (docs, nothing, many):
        got = quality_rules.judge(df).select(*QUALITY)
        assert rows_of(got.toArrow()) == duck_rows(df, quality_rules.ORACLE)
        assert rows_of(license_scan.scan(df).drop("spans").toArrow()) == duck_rows(df, license_scan.oracle())
        sizes = df.select("doc_id", "source", mixing_pareto.word_count(df["text"]).alias("size"))
        mix = mixing_pareto.allocate(sizes).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")
        assert rows_of(mix.toArrow()) == duck_rows(df, mixing_pareto.ORACLE)


def test_quality_host_verdict(spark):
    bad = [(k, "too short", "bad") for k in range(300)] + [(300, " ".join(f"w{k}" for k in range(80)), "bad")]
    good = [(1000 + 100 * h + k, " ".join(f"w{i}" for i in range(60 + k)), f"good{h}") for h in range(5) for k in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(bad + good, "doc_id long, text string, source string")).collect()}
    assert not got[300] and all(got[d] for d, _, _ in good)
    lone = spark.createDataFrame([*good, (1, "too short", "small"), (2, bad[-1][1], "small")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(lone).collect()}[2]


def test_license_texts(spark):
    notice = license_texts.MIT
    changed = notice.replace("free of charge", "free of any charge").replace("liable", "held liable")
    bsd = "x " * 70 + license_texts.BSD_3.replace("holders and contributors", "owners") + " y" * 300
    rows = [(1, notice), (2, "x " * 50 + changed.upper()), (3, "permission is hereby granted"), (4, "All rights reserved."), (5, "mit license mit license"), (6, bsd), (7, notice + " z" * 40 + " " + license_texts.ZLIB)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(1, 8)] == ["mit", "mit", "", "", "mit", "bsd", "mit,zlib"]
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"], got[5]["score"]) == (2, 0, 2, 1.0)
    assert 0 < got[3]["score"] < 0.75 and [(s["low"], s["high"]) for s in got[2]["spans"]] == [(50, 50 + len(changed.split()))]
    assert {s["low"] for s in got[6]["spans"]} == {70} and all(200 < s["high"] - s["low"] < 230 or s["high"] - s["low"] > 150 for s in got[6]["spans"])
    n = len(notice.split())
    assert [(s["low"], s["label"]) for s in got[7]["spans"]] == [(0, "mit"), (n + 40, "zlib")]


def test_mix_comes_near_its_targets(many):
    sizes = many.select("doc_id", "source", mixing_pareto.word_count(many["text"]).alias("size"))
    rows = mixing_pareto.allocate(sizes).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3
    for s in by.values():
        assert abs(sum(r["copies"] * r["size"] for r in s) - s[0]["target"]) <= max(r["size"] for r in s)
    assert sum(s[0]["target"] for s in by.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_inclusion_frequencies(spark):
    """Sources of the same sizes stand for seeds: a document's frequency is its inclusion probability."""
    rng = np.random.default_rng(6)
    size = rng.integers(1, 400, 40)
    rows = [(1000 * s + k, f"s{s:04d}", int(n)) for s in range(800) for k, n in enumerate(size)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    taken = np.zeros((800, 40))
    for r in mixing_pareto.allocate(df, weights=(2, 1)).collect():
        taken[int(r["source"][1:]), r["doc_id"] % 1000] = r["copies"]
    n = size.sum()
    f = 1000 * size // (size + n // 40)
    mean = (f * size).sum() / n
    for part, p in ((taken[::2] - 1, 1 / 3), (taken[1::2], 2 / 3)):
        pi = p + p * (1 - p) * (f - mean) / 1000
        assert set(np.unique(part)) == {0, 1} and np.ptp(pi) > 0.1
        off = (part.mean(axis=0) - pi) / np.sqrt(pi * (1 - pi) / len(part))
        assert abs(off).max() < 5 and np.corrcoef(part.mean(axis=0), pi)[0, 1] > 0.8
        assert abs(part @ size - p * n).max() <= 400 / 2 + 1


def test_mix_over_many_sources(spark):
    """Targets of as many sources as hosts, against the rule itself."""
    rng = np.random.default_rng(8)
    own = {f"h{k:05d}": int(x) for k, x in enumerate(rng.pareto(0.7, 3000) * 10 + 1)}
    df = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(own.items())] + [(-1, None, 50)], "doc_id long, source string, size long").repartition(8)
    names, size = [*sorted(own), None], np.array([*(own[s] for s in sorted(own)), 50], float)
    w = np.array([(5, 2, 1)[k % 3] for k in range(len(size))], float)
    low, high = 0.0, 3 * size.max()
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if np.minimum(3 * size, w * level).sum() < size.sum() else (low, level)
    got = {r["source"]: r["target"] for r in mixing_pareto.targets(df).collect()}
    assert got == {s: pytest.approx(x, rel=1e-9) for s, x in zip(names, np.minimum(3 * size, w * low))}


def test_pipeline_stages(spark, docs, nothing, many, small):
    for df in (many, docs, nothing):
        rows = df
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, small)
            if k < 4:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if df is many:
                n = out.count()
                assert n > 0 and (k == 4 or n <= 3 * rows.count())
            else:
                out.count()
            rows = out
    assert re.match(r"op\d+_", sorted(__import__("periplus.llm.queries", fromlist=["q"]).queries())[0])


def test_pipeline_decisions(spark, small):
    long = " ".join(f"word{k}" for k in range(120))
    other = " ".join(f"term{k}" for k in range(120))
    rows = [(1, long, "en", "a", 0), (2, long, "en", "a", 0), (3, other, "en", "b", 0), (4, "short", "en", "a", 0), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, df, small)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    one = corpus_pipeline.near_duplicates(spark, kept, small)
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 3]


def test_units_that_come_again_outlast_the_cache(monkeypatch):
    """A full cache forgets the units that came once; the ids stay those of whole texts."""
    monkeypatch.setattr(tokens, "CACHE_UNITS", 200)
    enc, learned = tokens.UnitEncoder(tokens.default_path()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda known, units, lead: (learned.extend(units), learn(known, units, lead)))
    for k in range(20):
        text = "The ship and the sea, " + " ".join(f"w{k}x{j}" for j in range(60))
        ids, bounds = enc.flat([text, text[4:]])
        assert ids[: bounds[1]].tolist() == enc.tok.encode(text, add_special_tokens=False).ids
        assert ids[bounds[1] :].tolist() == enc.tok.encode(text[4:], add_special_tokens=False).ids
    assert learned.count("ship") == 2  # behind a space, and as the head of a text
    assert "w0x1" not in enc.units and enc.n < 500


def test_first_pass_of_quality_writes_hosts_alone(monkeypatch, many):
    """Each written file costs executors processes of the file system; a table by document was read for its sums alone."""
    tables, written = {}, quality_rules.C.written
    monkeypatch.setattr(quality_rules.C, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    kept = quality_rules.keep(many).count()
    assert max(t.count() for t in tables.values()) <= many.select("source").distinct().count()
    assert kept == quality_rules.judge(many).where("kept").count()
