import pytest

#: Nulls, empty, blank and tiny texts, ties, repeated rows, one id twice, odd white space, a long text, clashing names.
LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(6000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with five dozen jugs of liquor near the old stone bridge at noon on a very cold and windy day in march before anyone else wakes up to see it"
TEXTS = [
    (1, "Alpha beta. " + PASSAGE + " omega", "en", "s1"),
    (2, PASSAGE + "\n" + PASSAGE, "en", "s1"),
    (3, None, "en", "s2"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "s2"),
    (6, "one", "fr", "s2"),
    (7, "Exact copy of a text that is here twice, with enough words to have shingles.", "en", "s3"),
    (8, "Exact copy of a text that is here twice, with enough words to have shingles.", "en", "s3"),
    (9, LONG, "en", "s1"),
    (10, "é　ü\x1c ß " + PASSAGE.upper() + " é", "de", "s3"),
    (11, "x\n" * 40 + "# $ % & | < > *", "de", "s1"),
    (12, LONG[:9000] + " changed " + LONG[9000:], "en", "s4"),
    (None, "Released under the MIT License. " + PASSAGE, "en", "s5"),
    (14, "This work is licensed under the GNU General Public License, version 3.", "en", "s5"),
    (15, "a b c a b c a b c a b c", "en", "s5"),
    (16, "a b c a b c a b c a b c", "en", None),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([*TEXTS, TEXTS[6]], COLUMNS)
    from pyspark.sql import functions as F

    clash = {c: F.lit(c) for c in ("block", "carry", "words", "size", "host", "fp", "copies", "bucket", "kept", "n_words")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def unique(docs):
    """Without the repeated row, for results whose rows are told apart by id."""
    return docs.dropDuplicates(["doc_id"])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def many(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
