import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.operators import analysis, quality, quantiles, scoring
from turnmill.operators.quantiles import exact_quantiles
from turnmill.sources import datasets, tasks


@pytest.mark.parametrize("small", [0, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", small)
    rnd = random.Random(4)
    groups = {
        "spread": [rnd.uniform(-1e6, 1e6) for _ in range(4000)],
        "ties": [float(rnd.randrange(3)) for _ in range(3000)],
        "skewed": [rnd.random() ** 40 for _ in range(3000)] + [1e12],
        "one": [7.5],
        "two": [1.0, 2.0],
        None: [3.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("nothing", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    asked = {"least": 0.0, "low": 0.013, "half": 0.5, "high": 0.85, "most": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "v", asked, ["g"]).collect()}
    assert set(got) == set(groups)  # a group of nulls has no row
    for g, vs in groups.items():
        for name, q in asked.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-15)
    whole = [v for vs in groups.values() for v in vs]
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(statistics.median(whole))
    assert exact_quantiles(df.limit(0), "v", {"m": 0.5}).count() == 0


def test_quantiles_where_the_sketch_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    monkeypatch.setattr(quantiles, "ACCURACY", 5)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)  # the bounds meet, so the rows next to a quantile lie in other parts
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    vs = list(range(1000))
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(vs)], "g int, v double").repartition(7)
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(df, "v", {"a": 0.3, "b": 0.777}, ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx([np.quantile(vs[g::2], q) for q in (0.3, 0.777)])


def test_reports_of_empty_runs(spark):
    one = "task_id int, conversation array<string>, token_count int, correct_score double, reward double, name_penalty double, final_answer string, answer string"
    empty = spark.createDataFrame([], one)
    assert analysis.run_summary(empty).first()["median_tokens"] is None
    assert analysis.compare_exact(empty).first()["median_tokens"] == 0.0
    rows = spark.createDataFrame([(1, ["a"], n, None, None, None, None, "x") for n in (4, 1, None, 10)], one)
    got = analysis.run_summary(rows).first()
    assert (got["median_tokens"], got["mean_tokens"], got["parsed_answer"]) == (2.5, 3.75, 0)


def test_a_legacy_task_without_a_usable_conversation_is_an_error(spark):
    rows = [(1, ["a", "large"], 60, [0.5], ["y"], True, "y", "exact-match"), (2, ["a"], 60, [0.5], ["y"], True, "y", "exact-match")]
    df = spark.createDataFrame(rows, "task_id int, conversation array<string>, token_count int, losses array<double>, answers array<string>, answer_is_list boolean, final_answer string, score_type string")
    assert scoring.score(df, maths=False).count() == 2
    assert scoring.score(df.where("task_id = 2"), mode="legacy", maths=False).first()["token_score"] == -0.5
    with pytest.raises(Exception, match="all conversations are too large in task 1"):
        scoring.score(df, mode="legacy", maths=False).collect()


def test_losses_and_perplexities(spark):
    df = spark.createDataFrame([([9.0, 9.0, 9.0, 9.0, 0.5, 0.0, 1.5],), ([1.0, 2.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(scoring.mean_loss(F.col("x"), "legacy")).collect()] == [1.0, None, None, None]
    assert df.select(scoring.mean_loss(F.col("x"))).first()[0] == pytest.approx(38 / 6)
    said = spark.createDataFrame([([[None, -1.0, -3.0], [None, -0.5], [None]],), ([[None]],), ([],)], "s array<array<double>>")
    got = [r[0] for r in said.select(scoring.perplexity_score(F.col("s"), 0.6)).collect()]
    assert got[0] == pytest.approx(0.6 / np.exp(2)) and got[1:] == [None, None]


def test_fields_of_lines(spark):
    lines = ['{"task_id":1,"results":[{"reward":1,"rank":null},{"reward":2}]}', "no json {", '{"task_id":2,"results":[]}', '{"task_id":3}', '{"results":[{"rank":0}]}']
    got = {r["check"]: (r["status"], r["value"]) for r in quality.field_checks(spark.createDataFrame([(x,) for x in lines], "value string"), ["reward", "rank", "other"]).collect()}
    assert got == {"field_reward": ("FAIL", 1.0), "field_rank": ("FAIL", 1.0), "field_other": ("FAIL", 3.0)}


def test_listings_and_transcripts(spark):
    rows = [(k, k % 2 == 0, "a\nb" if k % 2 else "x" * 30) for k in range(9)]
    df = spark.createDataFrame(rows, "id int, chosen boolean, text string").repartition(3)
    got = sorted(map(tuple, tasks.sample_listing(df, ["id"], 2, 10, "chosen").collect()))
    assert got == [(0, True, "x" * 10 + " …"), (1, False, "a b"), (2, True, "x" * 10 + " …"), (3, False, "a b")]
    assert [r["id"] for r in tasks.sample_listing(df, ["id"], 3).collect()] == [0, 1, 2]
    turn = "array<struct<speaker:string,content:string,token_count:int,parsed_answer:string,finish_reason:string>>"
    one = spark.createDataFrame([(123456, 7, None, ["a", "large"], [("Bob", "hi", 2, None, "stop")], 1.5)], f"task_id int, trajectory_id int, question string, conversation array<string>, turns {turn}, reward double")
    told = tasks.transcripts(one).first()
    assert told["name"] == "task_123456_traj_07.txt"
    assert told["text"] == "Task 123456, trajectory 7\nReward: 1.5\n\n[1] Bob: hi\n(2 tokens, answer none, finish stop)\n\n(a turn went over the limit)"


def test_reports_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(tasks, "REPORT_ROWS", 3)
    with pytest.raises(ValueError):
        tasks.render_report(spark.range(4), "T")
    assert tasks.render_report(spark.range(3), "T").count("\n") == 7


def test_split_names(spark):
    df = spark.createDataFrame([("mwh_qa", "test"), ("mmlu", "test"), (None, "train"), ("arc", "other")], "d string, p string")
    assert [r[0] for r in df.select(datasets.split_name(F.col("d"), F.col("p"))).collect()] == ["dev", None, None, None]


def test_ordered_histogram(spark):
    df = spark.createDataFrame([(x,) for x in "bbacca"] + [(None,)], "v string")
    assert [r["v"] for r in analysis.histogram(df, "v", ordered=True).collect()] == ["a", "b", "c", None]
    assert {(r["v"], r["n"], r["place"]) for r in analysis.most_common(df, "v").collect()} == {("a", 2, 0), ("b", 2, 1), ("c", 2, 2), (None, 1, 3)}
