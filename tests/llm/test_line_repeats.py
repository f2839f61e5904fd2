import corpus_pipeline

from turnmill.llm import line_dedup as ld

PASSAGE = " ".join(f"word{k} of a passage that two documents share" for k in range(8))


def test_passage_in_two_documents_stays_once(spark):
    docs = [(1, f"only in one\n{PASSAGE}", "en", "s", 0), (2, f"{PASSAGE}!\nonly in two", "en", "s", 0), (3, PASSAGE, "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r["doc_id"], r["line_no"]): r["kept"] for r in ld.line_classes(df).collect()}
    assert kept == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): True, (3, 0): False}
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, df, "").collect()}
    assert out == {1: f"only in one\n{PASSAGE}", 2: "only in two"}
