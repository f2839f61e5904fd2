"""Golden cases of scores, selection and pairs."""

import pytest
from pyspark.sql import functions as F

from turnmill.operators import analysis, pairs, scoring, selection

ROW = "task_id int, trajectory_id int, conversation array<string>, token_count int, losses array<double>, answers array<string>, answer_is_list boolean, final_answer string, score_type string"


def scored(spark, rows, **options):
    return [r.asDict() for r in scoring.score(spark.createDataFrame(rows, ROW), **options).orderBy("task_id", "trajectory_id").collect()]


def one(spark, conversation=("Alice: a", "Bob: b"), tokens=100, answers=("hello",), is_list=False, final="hello", kind="exact-match", losses=(0.5, 0.5), cap=200, **options):
    row = (0, 0, list(conversation), tokens, list(losses), list(answers), is_list, final, kind)
    return scored(spark, [row], lambda1=-0.6, lambda2=1.0, token_cap=cap, **options)[0]


def test_reward_sum(spark):
    r = one(spark)
    assert (r["correct_score"], round(r["token_score"], 9), r["ppl_score"], round(r["reward"], 9)) == (1.0, -0.3, 2.0, 2.7)


@pytest.mark.parametrize(
    "change,column,value",
    [
        ({"tokens": 40}, "token_score", -1.0),
        ({"conversation": ["Alice: a", "large"]}, "token_score", -1.0),
        ({"tokens": 2001}, "ppl_score", -1.0),
        ({"conversation": ["Alice: same", "Bob: Same "]}, "ppl_score", 0.0),
        ({"conversation": ["Alice: same", "Bob: Same "]}, "correct_score", 1.0),
        ({"conversation": ["Alice: x Bob: y", "Bob: z"]}, "correct_score", 0.0),
        ({"conversation": ["Alice: x Bob: y", "Bob: z"], "tokens": 2001}, "correct_score", 1.0),
        ({"conversation": []}, "ppl_score", -1.0),
        ({"conversation": ["large"]}, "ppl_score", -1.0),
        ({"answers": ["yes", "no"], "is_list": True, "final": "YES "}, "correct_score", 1.0),
        ({"answers": ["hello world", "goodbye"], "is_list": True, "final": "hello", "kind": "f1-score"}, "correct_score", 2 / 3),
        ({"final": "\\hello\\"}, "correct_score", 1.0),
        ({"final": "\\hello\\", "is_list": True}, "correct_score", 0.0),
        ({"final": None}, "correct_score", 0.0),
        ({"cal_ppl": False, "tokens": 3000}, "ppl_score", 0.0),
    ],
)
def test_rules(spark, change, column, value):
    assert one(spark, **change)[column] == pytest.approx(value)


def test_task_maximum_leaves_out_large(spark):
    rows = [(0, 0, ["a", "large"], 900, [1.0], ["x"], False, "x", "exact-match"), (0, 1, ["a"], 100, [1.0], ["x"], False, "x", "exact-match"), (1, 0, ["a", "large"], 50, [1.0], ["x"], False, "x", "exact-match")]
    got = scored(spark, rows, lambda1=-0.5, lambda2=1.0)
    assert [r["token_score"] for r in got] == [-1.0, -0.5, -1.0]


def test_first_offence_wins(spark):
    df = spark.createDataFrame([(["a", "a", "Alice: Bob:"],), (["Alice: Bob:", "a", "a"],), (["Alice: q", "Alice: Bob: x", "q"],), (["Alice: x Alice: y"],), (["a", "b"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(scoring.format_offence(F.col("c"))).collect()] == ["duplicate", "name", "name", "name", None, None]


def selected(spark, rewards, **options):
    df = spark.createDataFrame([(k, 0, float(r), ["ok"]) for k, r in enumerate(rewards)], "task_id int, trajectory_id int, reward double, conversation array<string>")
    return [(r["reward"], r["rank"]) for r in selection.select_trajectories(df, **options).orderBy("rank").collect()]


def test_trim_and_threshold(spark):
    assert selected(spark, range(10, 0, -1)) == [(float(10 - k), k) for k in range(7)]
    assert [r for r, _ in selected(spark, [0.1, 0.2, 0.4, 0.5, 0.6], trim_high=1.0, epsilon=0.5)] == [0.6, 0.5]
    assert len(selected(spark, [5.0] * 90)) == 62  # floor of a double product, not of a decimal one
    assert selected(spark, []) == []


def test_penalty_flips_the_best(spark):
    df = spark.createDataFrame([(0, 0, 5.0, ["Alice: Bob: mixed"]), (0, 1, 1.0, ["Alice: clean"])], "task_id int, trajectory_id int, reward double, conversation array<string>")
    assert [r["trajectory_id"] for r in selection.select_trajectories(df, trim_high=1.0).collect()] == [1]


def test_places_across_buckets(spark):
    df = spark.range(1000).select("id", ((F.col("id") * 37) % 101).cast("double").alias("v"))
    got = [(r["id"], r["place"]) for r in selection.with_place(df, "v", ["id"]).collect()]
    want = sorted(range(1000), key=lambda k: (-((k * 37) % 101), k))
    assert dict(got) == {k: i for i, k in enumerate(want)}


def test_state_pair(spark):
    rows = [(0, 0, "good", 0.8), (0, 1, " good ", 0.6), (0, 2, "bad", 0.1), (0, 3, "Alice: error", -1.0), (0, 4, "error", -9.0), (0, 5, "", -9.0), (1, 0, "a", 0.6), (1, 1, "b", 0.5), (2, 0, "a", 0.9), (3, 0, "a", 0.9), (3, 1, "b", 0.1), (3, 2, "c", 0.1)]
    df = spark.createDataFrame(rows, "task_id int, branch_id int, candidate string, effective_reward double")
    got = {r["task_id"]: r for r in pairs.state_pairs(df, ["task_id"]).collect()}
    assert set(got) == {0, 3}
    assert (got[0]["chosen"], got[0]["rejected"], round(got[0]["chosen_value"], 9), round(got[0]["distance"], 9)) == ("good", "Alice: error", 0.7, 1.7)
    assert got[3]["rejected"] == "c"


def test_tree_keeps_the_better_half(spark):
    edges = [(0, "r", None, 0, 0, "", 0.0)]
    for p, (hi, lo) in enumerate([(0.9, 0.1), (0.8, 0.1), (0.7, 0.1)]):
        edges += [(0, f"p{p}", "r" if p == 0 else "p0", 1, p, f"p{p}", 0.5), (0, f"p{p}a", f"p{p}", 2, 1, "a", hi), (0, f"p{p}b", f"p{p}", 2, 2, "b", lo)]
    df = spark.createDataFrame(edges, "task_id int, node_id string, parent_id string, depth int, seq int, content string, value double")
    got = pairs.tree_pairs(df.where("parent_id is null or depth = 2")).collect()
    assert [(r["state_id"], r["chosen"], r["chosen_value"], r["speaker"]) for r in got] == [("p0", "a", 0.9, "Bob")]


def test_agreement_needs_the_other_speaker(spark):
    turns = [(0, 0, "Alice", "A"), (0, 1, "Bob", "B"), (0, 2, "Alice", "A"), (0, 3, "Bob", "A"), (1, 0, "Alice", "A"), (1, 1, "Bob", None), (1, 2, "Alice", "A"), (2, 0, "Alice", None)]
    df = spark.createDataFrame(turns, "id int, pos int, speaker string, parsed_answer string")
    got = {r["id"]: (r["agreed_pos"], r["final_answer"]) for r in scoring.agreement(df, ["id"]).collect()}
    assert got == {0: (3, "A"), 1: (None, "A"), 2: (None, None)}


def test_result_stats_for_maths_ends_early(spark):
    df = spark.createDataFrame([(0, 0, ["error"], 10, 1.0), (0, 1, ["a"], 10, 1.0), (0, 2, ["a"], 30, 0.0)], "task_id int, pos int, conversation array<string>, token_count int, correct_score double")
    r = analysis.result_stats(df, first_only=True).first()
    assert (r["accuracy"], r["tokens"]) == (0.5, 5.0)
    r = analysis.result_stats(df, sum_tokens=True).first()
    assert (r["accuracy"], r["tokens"]) == (1 / 3, 40.0)


def test_plans(spark):
    best = selection.best_per_task(spark.range(10).selectExpr("id % 3 as task_id", "id as trajectory_id", "id * 1.0D as effective_reward"))
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    row = spark.createDataFrame([(0, 0, ["a"], 1, [1.0], ["x"], False, "x", "exact-match")], ROW)
    plan = scoring.score(row, maths=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("ExistingRDD", "")


def test_places_in_groups(spark):
    df = spark.range(600).select((F.col("id") * 7 % 600).alias("id"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    want, counts = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        want[r["id"]] = counts.get(r["g"], 0)
        counts[r["g"]] = want[r["id"]] + 1
    for frame in (selection.place_in_group(df, "g", "id"), selection.place_in_group(df.withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0")), "g", "id")):
        got = {int(r["id"]): (r["_place"], r["_n"]) for r in frame.collect()}
        assert got == {r["id"]: (want[r["id"]], counts[r["g"]]) for r in df.collect()}
