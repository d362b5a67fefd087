import hashlib

import corpus_pipeline
from periplus.llm import line_templates


def test_a_line_of_two_documents_is_dropped_once(spark, small, tmp_path):
    line = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, f"first own\n{line}"), (2, f"{line}\nsecond own"), (3, "third own")]
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {1: rows[0][1], 2: "second own", 3: "third own"}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, df, small).collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in line_templates.query(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
