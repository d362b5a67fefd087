import random

import corpus_pipeline
from periplus.llm import jaccard_groups


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows, similarity=0.8):
    """Smallest id reachable over pairs that are similar enough."""
    sets, up = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= similarity:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


def edited(words, places):
    return [f"new{k}" if k in places else w for k, w in enumerate(words)]


def families():
    """Texts with copies on either side of 0.8, and a family of many copies of one text."""
    r, rows = random.Random(7), []
    for f in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows += [words, edited(words, {10 * f % 200}), edited(words, set(r.sample(range(200), 3))), edited(words, set(r.sample(range(200), 8)))]
    many = [f"m{r.randrange(5000)}" for _ in range(150)]
    rows += [edited(many, {r.randrange(150), r.randrange(150)}) for _ in range(80)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_groups_against_brute_force(spark, many):
    for rows, task_rows in ((families(), 500), (families(), 20), ([tuple(r) for r in many.select("doc_id", "text").collect()], 500)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_groups.near_duplicates(df, task_rows=task_rows).collect()}
        assert got == brute(rows) and len(set(got.values())) < len(got)


def test_stage_drops_pairs_of_0_8(spark, small):
    words = [f"word{k * k % 997}x{k}" for k in range(200)]
    near, far = edited(words, {50, 150}), edited(words, {20, 60, 100, 140, 180})
    texts = [" ".join(w) for w in (words, near, far)]
    assert 0.8 <= jaccard(*map(shingle_set, texts[:2])) < 0.95 and jaccard(shingle_set(texts[0]), shingle_set(texts[2])) < 0.8
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + [(None, texts[0], "en", "a", 1), (2, texts[2], "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, small).collect()) == [0, 2]
