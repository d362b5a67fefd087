"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periplus.llm import common as C
from periplus.llm import jaccard_groups, line_templates, mixing_pareto, packing_kk, quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep; the others go.

    Null, empty and blank texts have no words and go; a null source is no host; repeated rows are judged alike.
    """
    return quality_rules.keep(docs.select(*COLUMNS)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents are dropped; ``n_chars`` follows the text.

    Null texts stay null (and ``n_chars`` with them), blank lines stay; rows that share an id are one document.
    """
    out = line_templates.drop_lines(docs.select(*COLUMNS), min_docs=line_templates.CORPUS_MIN_DOCS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, once if its row is repeated.

    Groups are linked by Jaccard similarities of 0.8 or more of five-word shingles. Documents without an
    id stay only where no member of their group has one. Of rows that share the smallest id, the text with the
    smallest hash stays; texts that share an id but not a group are told apart. Texts without words are one group.
    """
    groups = jaccard_groups.near_duplicates(docs)
    key = [F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_none")]
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("x") == F.col("survivor"))).select(*key, F.col("x").alias("_x")).distinct()
    # By columns of their own, so that texts are dealt once for both steps.
    rows = docs.select(*COLUMNS, *key, F.xxhash64("text").alias("_x"))
    return rows.join(first, ["_i", "_none", "_x"], "left_semi").dropDuplicates(["_i", "_none", "_x"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, row by row.

    Null sources are one source, the last; texts without words are taken 0 times; rows that share an id only are
    taken each by itself, and of rows that are equal in all columns, as many as the mix takes of them together.
    """
    row = F.xxhash64(*COLUMNS, F.lit("mix")).alias("_row")
    sizes = C.written(docs.select("doc_id", "source", mixing_pareto.word_count(F.col("text")).alias("size"), row), "mix-sizes")
    copies = mixing_pareto.allocate(sizes, carry=("_row",)).where("copies > 0").groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies"))
    out = docs.select(*COLUMNS, row).join(copies, "_row").dropDuplicates(["_row"])
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids; each row is packed, a null text as its end id alone."""
    out = packing_kk.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Templates, fingerprints and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{C.work_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
