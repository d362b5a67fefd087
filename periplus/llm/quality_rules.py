"""Quality rules at the level of hosts.

Per document, counts are taken from the whole text and written once. Per host (``source``) the
failures of each rule are summed; each rule's rates over hosts give an empirical beta prior (mean
and variance by moments), and a host's rate is shrunk to (failures + alpha) / (documents + alpha +
beta). A host whose shrunken rate exceeds ``limit`` for any rule is rejected, and its verdict is
joined back to its documents. A document is kept if it passes the base rules and its host is not
rejected.

Rules: short (under 50 words), repeats (over half of the words in recurring 3-word windows), symbols
(over 10 symbols in 100 words), lines (over half of the lines that have a word are copies).

Only one row of sums per rule reaches the driver. The host table is joined by Spark as its size
commands; rejected hosts alone are joined, from the left, so no document is lost.

Edge cases: null and empty texts have no words and fail; a null host is no host, and only the base
rules judge its documents; repeated rows count as documents; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LIMIT = 0.75
RULES = ("short", "repeats", "symbols", "lines")
SYMBOLS = b"#*$%&|<>"
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_KEEP_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
#: UTF-8 continuation bytes and ASCII white space: all that is no code point of a word.
_NOT_CHARS = bytes(range(0x80, 0xC0)) + _WHITE

COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_CHARS))
    symbols = len(text.translate(None, _KEEP_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        seen = Counter(grams)
        if len(seen) < len(grams):
            upto = 0  # words before this one are counted
            for k, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += k + 3 - max(k, upto)
                    upto = k + 3
    return n, chars, symbols, len(lines), dups, repeated


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t) if t else (0,) * 6 for t in b.column(2).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    C.importable(docs.sparkSession)
    return src.mapInArrow(run, COUNTS)


def failures() -> dict[str, F.Column]:
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """alpha and beta of each rule, from one row of sums over hosts."""
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("h")]
    for r in RULES:
        sums += [F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq")]
    row = hosts.agg(*sums).first()
    out = {}
    for r in RULES:
        if not row["n"]:
            out[r] = (1.0, 1.0)
            continue
        n, h = row["n"], row["h"]
        m = row[r] / n
        # Pearson's form of the moments: the spread of the rates beyond that of binomial counts.
        spread = row[f"{r}_sq"] - n * m * m
        scale = n - row["nn"] / n
        between = (spread - (h - 1) * m * (1 - m)) / scale if scale > 0 else 0.0
        strength = m * (1 - m) / between - 1 if between > 0 else 1e6
        strength = min(max(strength, 1.0), 1e6)
        out[r] = (m * strength, (1 - m) * strength)
    return out


def summed(rows: DataFrame) -> DataFrame:
    """Per host: documents and failures of each rule."""
    return rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in failures().items()])


def verdicts(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per host of ``summed``: also shrunken rates and ``rejected``."""
    shape = prior(hosts)
    rates = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in shape.items()}
    out = hosts.select("*", *[c.alias(f"{r}_rate") for r, c in rates.items()])
    return out.withColumn("rejected", F.greatest(*[f"{r}_rate" for r in RULES]) > limit)


def judge(docs: DataFrame, limit: float = LIMIT, host: str = "source") -> DataFrame:
    """Per document: the counts, ``base_failed``, ``host_rejected`` and ``kept``."""
    rows = C.written(measured(docs, host), "quality")
    bad = verdicts(summed(rows), limit).where("rejected").select(F.col("host").alias("bad_host"))
    fail = failures()
    out = rows.join(bad, F.col("host") == F.col("bad_host"), "left").withColumn("host_rejected", F.col("bad_host").isNotNull())
    out = out.withColumn("base_failed", fail["short"] | fail["repeats"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("bad_host")


def keep(docs: DataFrame, limit: float = LIMIT, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, without moving their texts.

    The base rules are applied where a row is read. The first pass writes its sums by host alone, no row per document;
    rejected hosts are written, so that their exact size decides how they are joined.
    """
    hosts = C.written(summed(measured(docs, host)), "hosts")
    bad = C.written(verdicts(hosts, limit).where("rejected").select(F.col("host").alias("_bad_host")), "rejected-hosts")

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            n, _, _, _, _, repeated = counts(t.encode()) if t else (0,) * 6
            out.append(n >= 50 and 100 * repeated <= 50 * n)
        return pd.Series(out, dtype=bool)

    return docs.where(passes(F.col("text"))).join(bad, F.col(host) == F.col("_bad_host"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``."""
    return judge(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), lines AS (
  SELECT rid, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), grams AS (
  SELECT rid, k, ws[k:k+2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS k FROM w WHERE len(ws) > 2)
), many AS (
  SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT rid, CAST(count(DISTINCT p) AS BIGINT) AS n_repeat_words FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM many) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)
), f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) AS f1, CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) AS f2,
         CAST(100 * n_symbols > 10 * n_words AS BIGINT) AS f3, CAST(2 * n_dup_lines > n_lines AS BIGINT) AS f4 FROM m
), hosts AS (
  SELECT host, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([sum(f1), sum(f2), sum(f3), sum(f4)]) AS x FROM f WHERE host IS NOT NULL GROUP BY host
), sums AS (
  SELECT rule, sum(n) AS n, sum(n * n) AS nn, count(*) AS h, sum(x) / sum(n) AS rate, sum(x * x / n) AS sq FROM hosts GROUP BY rule
), spread AS (
  SELECT *, CASE WHEN n - nn / n > 0 THEN ((sq - n * rate * rate) - (h - 1) * rate * (1 - rate)) / (n - nn / n) ELSE 0 END AS between_hosts FROM sums
), prior AS (
  SELECT rule, rate, least(greatest(CASE WHEN between_hosts > 0 THEN rate * (1 - rate) / between_hosts - 1 ELSE 1e6 END, 1.0), 1e6) AS strength FROM spread
), bad AS (
  SELECT DISTINCT host FROM hosts JOIN prior USING (rule) WHERE (x + rate * strength) / (n + strength) > 0.75
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 AS base_failed, f1 + f2 = 0 AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON f.host = bad.host
"""
