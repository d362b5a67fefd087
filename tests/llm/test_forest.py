from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from periplus.llm import ann_forest


def nearest(ids, x, q, k=5):
    """(score, id) of the k nearest rows, of all but row q, ties to the smaller id."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit[q], 12)
    rows = np.delete(np.arange(len(ids)), q)
    return [(s[r], ids[r]) for r in rows[np.lexsort((ids[rows], -s[rows]))[:k]]]


def answers(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append(r)
    for found in got.values():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys)
    return got


def recall(got, ids, x):
    hits = total = 0
    for q, found in got.items():
        want = nearest(ids, x, int(np.flatnonzero(ids == q)[0]))
        hits += sum((Counter(i for _, i in want) & Counter(r["vec_id"] for r in found)).values())
        total += len(want)
        assert len(found) == len(want)
    return hits / total


def test_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[1000:2000] = x[0] + 0.05 * rng.normal(size=(1000, 16))
    x[2000:2300] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15 + [None]), (5004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (5005, [1.0, 2.0]), (5006, [])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(4)
    clash = df.withColumns({c: F.lit(c) for c in ("tree", "cell", "chunk", "part", "same", "v", "qid", "query_id", "score", "count")})
    asked = clash.where("vec_id % 50 = 0")
    for options in ({"candidates": 4000}, {"candidates": 6000, "cell_rows": 40, "chunk": 15, "query_chunk": 3, "sample": 500}):
        got = answers(ann_forest.search(clash, asked, **options))
        assert set(got) == set(range(0, 3000, 50)) and recall(got, np.arange(3000), x) >= 0.9
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(unit[q] @ unit[r["vec_id"]] - r["score"]) < 1e-9 for q, found in got.items() for r in found)
    assert ann_forest.search(df.where("false"), asked).count() == 0
    assert ann_forest.search(df, asked.where("false")).count() == 0
    few = ann_forest.search(df.where("vec_id < 3"), df.where("vec_id < 1")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_repeated_rows_and_ids(spark):
    """Candidates are all rows but the query's own, however ids and rows repeat."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_forest.search(df, df.where("vec_id = 50")).collect()
    half = round(0.5**0.5, 6)
    first = [(1, 50, 1.0), (2, 7, half), (3, 7, half), (4, 8, half), (5, 50, 0.0)]
    other = [(1, 7, half), (2, 7, half), (3, 8, half), (4, 50, 0.0), (5, 50, 0.0)]
    assert sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in got) == sorted(2 * first + other)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    """The registered query over the given table."""
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    got = answers(ann_forest.query(spark, f"/root/testdata/{sf}"))
    assert set(got) == {int(i) for i in ids if i % 50 == 0} and recall(got, ids, x) >= 0.9


def test_recall_of_a_bounded_search():
    """In a table that the candidates don't cover, by the walk itself: structured vectors need a few of the rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 64))
    x = ann_forest.unit(np.repeat(centres, 50, axis=0) + 0.3 * rng.normal(size=(20_000, 64)))
    fit = x[rng.choice(len(x), 4000, replace=False)]
    trees = [ann_forest.Tree(fit, ann_forest.LEAF, rng, len(x), 100) for _ in range(ann_forest.TREES)]
    cells = [t.cell_of(x) for t in trees]
    asked = np.arange(0, len(x), 400)
    margins = [t.margins(x[asked]) for t in trees]
    hits = seen = 0
    for k, q in enumerate(asked):
        met = np.zeros(len(x), bool)
        for t, c in ann_forest.walk(trees, x[asked], margins, k, 3000):
            met |= cells[t] == c
        s = x @ x[q]
        s[q] = -9
        hits += met[np.argsort(-s)[:5]].sum()
        seen += met.sum()
    assert hits >= 0.9 * 5 * len(asked) and seen < 0.2 * len(x) * len(asked)
