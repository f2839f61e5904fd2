from turnmill.llm import decontamination as dc

from .test_decontamination import brute, cases


def test_more_words_than_symbols(spark):
    size = 34_000
    bench = [(k, " ".join(f"w{n}" for n in range(k * size, (k + 1) * size))) for k in range(2)] + [(2, " ".join(f"v{n}" for n in range(70_000)))]
    cut = (70_000 - 9) // 2
    docs = [(1, "so " + " ".join(f"w{n}" for n in range(60_000, 60_012)) + " it ends"), (2, "a " + " ".join(f"v{n}" for n in range(cut - 6, cut + 6)) + " b"), (3, "w1 v1 clean"), (4, " ".join(f"w{n}" for n in range(10)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert dict(dc.remove_contamination(d, b).collect()) == {1: "so  it ends", 2: "a  b", 3: "w1 v1 clean", 4: ""}
    assert {r["doc_id"]: r["items"] for r in dc.find_contamination(d, b).collect()} == {1: ["1"], 2: ["2"], 3: [], 4: ["0"]}


def test_small_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_WORDS", 12)
    docs, bench = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    report = dc.contamination_report(d, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in report) == sorted(brute(docs, bench))
