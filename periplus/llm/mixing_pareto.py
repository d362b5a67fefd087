"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of all words, at most ``most`` times its own,
the excess shared again by weight. With rho = target / size of the source, every document gets
floor(rho) certain copies, and may get one more. The rest of the target is sampled with unequal probabilities:
with p = rho - floor(rho), a document of s words in a source whose documents have m words on average is included with

    pi = p + p (1 - p) (f - F),   f = s / (s + m),   F = the mean of f over the source's words

so that longer documents are likelier, each pi lies strictly between 0 and 1 (in [p^2, 1 - (1 - p)^2]), and the expected
words are the rest exactly. Documents are ranked by u/(1-u) divided by pi/(1-pi), where u is a hash of ``doc_id`` and
the seed, and a prefix of the ranking is taken whose words come nearest to the rest. So the sample has a
fixed size, reruns agree, and the error of a source is at most half a document.

The running sums of the ranking are computed over ``bins`` ranges of the ranking value: sums per range first,
then inside each range; a source with a third of all rows spreads over all its ranges. Sources may be as many as
hosts: they are numbered by a range partitioning, and the level at which the excess is shared is found by sums over
them, a row at a time on the driver.

Edge cases: a null text has size 0; a null source is one source, ordered last; documents of size 0
and sources without words take 0 words; repeated rows are documents of their own; other columns
are not read (but for those named in ``carry``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BINS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Words that white space of ASCII separates; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id, seed: str) -> F.Column:
    """A number in (0, 1) from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def numbered(per: DataFrame) -> DataFrame:
    """``per`` with ``number``, the place of the source from 0 by code point, null last, without one task for all."""
    at = [F.col("source").isNull(), F.col("source")]
    ranged = C.written(per.repartitionByRange(*at).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not sources
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*at))
    return ranged.join(parts, "_part").withColumn("number", F.col("_before") + inside - 1).drop("_part", "_n", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``source, source_size, mean_size, tilt, target`` (``tilt``: the sum of f over words, in thousandths)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    per = numbered(per.withColumn("mean_size", F.greatest(F.expr("source_size div greatest(n, 1)"), F.lit(1).cast("long"))).drop("n"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    tilt = sizes.join(per.select(F.col("source").alias("_s"), "mean_size"), F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(F.sum(tilted() * F.col("size")).alias("tilt"))
    tilt = tilt.withColumnRenamed("source", "_t")
    per = C.written(per.join(tilt, F.col("source").eqNullSafe(F.col("_t"))).withColumn("cap", F.col("source_size") * most).select("source", "source_size", "mean_size", "tilt", "w", "cap"), "weighed")
    # The level rises until the sources below it are full; each turn fills one more at least, and few turns are needed.
    first = per.agg(F.sum("source_size"), F.sum("w")).first()
    total = words = first[0] or 0
    weight, full = first[1] or 1, None
    while True:
        filled = F.col("cap") * F.lit(weight) < F.col("w") * F.lit(words)
        row = per.agg(F.count(F.when(filled, 1)), F.sum(F.when(filled, F.col("cap"))), F.sum(F.when(~filled, F.col("w")))).first()
        if row[0] == full or not row[2]:
            break
        full, words, weight = row[0], total - (row[1] or 0), row[2]
    level = (F.col("w") * F.lit(words)).cast("double") / F.lit(weight).cast("double")
    return per.select("source", "source_size", "mean_size", "tilt", F.when(filled, F.col("cap").cast("double")).otherwise(level).alias("target"))


def tilted() -> F.Column:
    """f of a document, in thousandths."""
    return F.when(F.col("size") > 0, F.expr("(1000 * size) div (size + mean_size)")).otherwise(F.lit(0).cast("long"))


def inclusion() -> F.Column:
    """pi of a document, from p, its size and its source's sums."""
    mean = F.when(F.col("source_size") > 0, F.col("tilt") / F.col("source_size")).otherwise(0.0)
    return F.col("p") + F.col("p") * (1 - F.col("p")) * ((tilted() - mean) / 1000.0)


def allocate(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED, bins: int = BINS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``doc_id, source, size`` (and ``carry``): also ``source_size, target, copies``."""
    goal = targets(sizes, weights, most).withColumn("rho", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("certain", F.floor("rho")).withColumn("p", F.col("rho") - F.col("certain")).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    goal = C.written(goal.withColumnRenamed("source", "_source"), "goal")
    rows = sizes.withColumn("u", uniform(F.col("doc_id"), seed)).join(goal, F.col("source").eqNullSafe(F.col("_source")))
    # Pareto's ranking value, and the same in (0, 1) to cut it into ranges. Without inclusion odds nothing is ranked.
    pi = inclusion()
    rows = rows.withColumn("pareto", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))))
    rows = rows.withColumn("bin", F.coalesce(F.floor(F.col("pareto") / (1 + F.col("pareto")) * bins), F.lit(0)))
    sums = rows.groupBy(F.col("source").alias("b_source"), F.col("bin").alias("b_bin")).agg(F.sum("size").alias("bin_size"))
    by_bin = Window.partitionBy("b_source").orderBy("b_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0))).drop("bin_size")
    inside = Window.partitionBy("source", "bin").orderBy("pareto", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = rows.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    chosen = F.col("pareto").isNotNull() & (F.col("before") + F.col("inside") + F.col("size") / 2.0 <= F.col("rest"))
    copies = F.when(F.col("size") > 0, F.col("certain") + chosen.cast("long")).otherwise(0)
    return out.select("doc_id", "source", "size", *carry, "source_size", "target", copies.cast("long").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all ``documents``; sources weigh 5, 2, 1, repeating."""
    docs = C.table(spark, sf_dir, "documents")
    sizes = C.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "op8-sizes")
    return allocate(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 3 AS cap,
         CAST(greatest(sum(size) // greatest(count(*) FILTER (size > 0), 1), 1) AS BIGINT) AS mean_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per
), filled AS (
  SELECT *, row_number() OVER f AS rank,
         CAST(total - sum(cap) OVER f + cap AS BIGINT) AS left_words, CAST(sum(w) OVER () - sum(w) OVER f + w AS BIGINT) AS left_w
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), level AS (
  SELECT rank AS free_rank, left_words AS lw, left_w AS lv FROM filled WHERE w * left_words <= cap * left_w ORDER BY rank LIMIT 1
), goal AS (
  SELECT source, source_size,
         CASE WHEN free_rank IS NULL OR rank < free_rank THEN CAST(cap AS DOUBLE) ELSE CAST(w * lw AS DOUBLE) / CAST(lv AS DOUBLE) END AS target
  FROM filled LEFT JOIN level ON true
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rho FROM goal
), rows_ AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, floor(g.rho) AS certain, g.rho - floor(g.rho) AS p, g.target - floor(g.rho) * g.source_size AS rest,
         CASE WHEN s.size > 0 THEN (1000 * s.size) // (s.size + m.mean_size) ELSE 0 END AS f,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sizes s JOIN shares g ON s.source IS NOT DISTINCT FROM g.source JOIN per m ON s.source IS NOT DISTINCT FROM m.source
), tilts AS (
  SELECT source, CAST(sum(f * size) AS BIGINT) AS tilt FROM rows_ GROUP BY source
), odds AS (
  SELECT r.*, p + p * (1 - p) * ((f - CASE WHEN source_size > 0 THEN tilt::DOUBLE / source_size::DOUBLE ELSE 0 END) / 1000.0::DOUBLE) AS pi
  FROM rows_ r JOIN tilts t ON r.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (certain + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM ranked
"""
