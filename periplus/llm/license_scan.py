"""License scan by diagonal voting, in DataFrame operations only.

Every rolling ``GRAM``-word hash of every text is joined with the positions of the same grams in the
license templates (the fixed texts of ``license_texts``, so the broadcast table has a proven size). A match of
text word i with template word j votes for the diagonal i - j; votes are summed per (document,
template, diagonal) before the shuffle. Diagonals of a template that lie at most ``DRIFT`` apart and
near each other in the text are merged to spans, so that a word more or less does not break a
span. A span is verified by exact words: a vote counts only if the words agree, and the template words
that the span covers must be at least ``COVER`` of the template and of the span's own length.

A row for the document itself travels through the same join (a sentinel gram), so that each
document, with or without votes, comes out of one aggregation and no second pass is needed.

``score`` is 1 where a base phrase stands, else the largest share of a template that a span covers.

Edge cases: null and empty texts have no words and no labels; texts shorter than a gram only have
base phrases; a null ``doc_id`` is carried along; repeated rows are reported once each; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .license_texts import TEMPLATES

GRAM = 3
DRIFT = 2
COVER = 0.75
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

def template_grams() -> list[tuple]:
    """(template, label, grams in it, position, words of the gram); template -1 is the sentinel."""
    rows: list[tuple] = [(-1, "", 0, -1, "", "", "")]
    for t, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(t, label, len(w) - GRAM + 1, k, *w[k : k + GRAM]) for k in range(len(w) - GRAM + 1)]
    return rows


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    want = phrase.split()
    hit = lambda i: _all(*[F.get(words, i + k) == w for k, w in enumerate(want)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - len(want)), hit)


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``spans``."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(), "template int, label string, size int, pos int, w0 string, w1 string, w2 string")
    grams = grams.withColumn("gram", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("w0", "w1", "w2")))

    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered.alias("lowered")).withColumn("rid", F.monotonically_increasing_id())
    # Exploding an array of one keeps the optimiser from copying the tokenizer into every use of the words.
    rows = rows.select("rid", "doc_id", F.explode(F.array(F.regexp_extract_all("lowered", F.lit(WORD), F.lit(0)))).alias("words"))
    none = F.array().cast("array<int>")
    hits = [F.when(F.array_contains("words", p.split()[-1]) & (F.size("words") >= len(p.split())), places(F.col("words"), p)).otherwise(none) for p, _ in PHRASES]
    rows = rows.withColumn("hits", F.array(*hits))
    # A gram goes out with its own words only, and the document's row with the sentinel: never the whole text per gram.
    head = F.struct("doc_id", F.size("words").alias("n_words"), "hits")
    nobody = F.when(F.lit(False), head)
    gram = lambda i: [F.get(F.col("words"), i + k) for k in range(GRAM)]
    row = lambda i, h, ws, who: F.struct(i.alias("i"), h.alias("gram"), *[w.alias(f"v{k}") for k, w in enumerate(ws)], who.alias("head"))
    sentinel = row(F.size("words"), F.lit(0).cast("long"), [F.lit("")] * GRAM, head)
    rolled = F.when(F.size("words") >= GRAM, F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: row(i, F.xxhash64(*gram(i)), gram(i), nobody)))
    at = rows.select("rid", F.inline(F.concat(F.coalesce(rolled, F.array().cast(f"array<struct<i:int,gram:bigint,{','.join(f'v{k}:string' for k in range(GRAM))},head:struct<doc_id:bigint,n_words:int,hits:array<array<int>>>>>")), F.array(sentinel))))
    # The words must agree: a document's own gram of hash 0 doesn't meet the sentinel's empty words.
    votes = at.join(F.broadcast(grams), "gram").where(_all(*[F.col(f"v{k}") == F.col(f"w{k}") for k in range(GRAM)]))
    votes = votes.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("i") - F.col("pos")).otherwise(0))
    lines = votes.groupBy("rid", "template", "label", "size", "diagonal").agg(
        F.max("head").alias("head"), F.min("i").alias("low"), F.max("i").alias("high"), F.min("pos").alias("t_low"), F.max("pos").alias("t_high"), F.count(F.lit(1)).alias("votes")
    )
    # Neighbouring diagonals that go on where the last ended, or overlap it, are one span.
    order = Window.partitionBy("rid", "template").orderBy("diagonal", "low")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (F.col("low") > F.lag("high").over(order) + GRAM + DRIFT) | (F.col("high") < F.lag("low").over(order) - GRAM - DRIFT)
    lines = lines.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    spans = lines.groupBy("rid", "template", "label", "size", "span").agg(
        F.max("head").alias("head"), F.min("low").alias("low"), (F.max("high") + GRAM).alias("high"), F.least(F.sum("votes"), F.first("size")).alias("votes")
    )
    share = F.col("votes") / F.col("size")
    dense = F.col("votes") / (F.col("high") - F.col("low") - GRAM + 1)
    good = (F.col("template") >= 0) & (share >= COVER) & (dense >= COVER)
    out = spans.groupBy("rid").agg(
        F.max("head").alias("head"),
        F.max(F.when(F.col("template") >= 0, share)).alias("best"),
        F.sort_array(F.collect_set(F.when(good, F.col("label")))).alias("found"),
        F.sort_array(F.collect_list(F.when(good, F.struct("low", "high", "label")))).alias("spans"),
    )
    hit = F.col("head.hits")
    starts = F.flatten(hit)
    base = F.array_compact(F.array(*[F.when(F.size(hit[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    base = F.sort_array(F.array_distinct(base))
    return out.select(
        F.col("head.doc_id").alias("doc_id"),
        F.col("head.n_words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, "found"))), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``."""
    return scan(C.table(spark, sf_dir, "documents")).drop("spans")


def oracle() -> str:
    """The same result in DuckDB, with the grams compared as words."""
    texts = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH texts(template, label, ws) AS (SELECT a, b, string_split(c, ' ') FROM (VALUES {texts}) AS x(a, b, c)), p(phrase, label, size) AS (VALUES {phrases}),
t AS (SELECT template, label, len(ws) - {GRAM - 1} AS size, k - 1 AS pos, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS gram
      FROM (SELECT *, unnest(generate_series(1, len(ws) - {GRAM - 1})) AS k FROM texts)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS k FROM d WHERE len(ws) > 0),
g AS (SELECT rid, k - 1 AS i, ws[k] || ' ' || ws[k + 1] AS g2, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS g3 FROM w),
base AS (SELECT rid, i, p.label FROM g JOIN p ON (p.size = 2 AND p.phrase = g2) OR (p.size = 3 AND p.phrase = g3)),
lines AS (SELECT rid, template, label, size, i - pos AS diagonal, min(i) AS low, max(i) AS high, count(*) AS votes FROM g JOIN t ON g3 = gram GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {DRIFT} AND low <= lag(high) OVER o + {GRAM + DRIFT} AND high >= lag(low) OVER o - {GRAM + DRIFT} THEN 0 ELSE 1 END AS new
           FROM lines WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal, low)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal, low ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM marked),
spans AS (SELECT rid, label, least(sum(votes), size) / size AS share, least(sum(votes), size) / (max(high) - min(low) + 1) AS dense
          FROM numbered GROUP BY rid, template, label, size, span),
best AS (SELECT rid, max(share) AS best FROM spans GROUP BY rid),
found AS (SELECT rid, label FROM spans WHERE share >= {COVER} AND dense >= {COVER} UNION SELECT rid, label FROM base),
b AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM base GROUP BY rid),
f AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(f.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid) LEFT JOIN best USING (rid)
"""
