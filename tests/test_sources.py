import importlib
import json

import pytest
from pyspark.sql import functions as F

from turnmill.operators import scoring
from turnmill.sources import tasks
from turnmill.streaming.scoring import score_stream, stream_tasks


def line(task_id, n=2):
    return json.dumps({"task_id": task_id, "results": [{"task_id": task_id, "trajectory_id": k, "answer": "y" if k else ["y", "z"], "conversation": ["Alice: hi"], "token_count": 50, "final_answer": "y", "score_type": "exact-match", "turns": [{"speaker": "Alice", "content": "hi"}]} for k in range(n)]})


def test_task_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line(0) + "\nbroken {\n" + line(1) + "\n")
    rows = tasks.trajectories(tasks.read_tasks(spark, f"file://{tmp_path}/a.jsonl"))
    assert rows.count() == 4
    answers, is_list = tasks.gold_answers(rows["answer"])
    got = {r["trajectory_id"]: (r["a"], r["l"]) for r in rows.select("trajectory_id", answers.alias("a"), is_list.alias("l")).collect()}
    assert got == {0: (["y", "z"], True), 1: (["y"], False)}
    odd = spark.createDataFrame([("[2,5)",), ("[2]",), (None,)], "answer string")
    assert [r[0] for r in odd.select(tasks.gold_answers(odd["answer"])[1]).collect()] == [False, True, False]
    tasks.write_tasks(rows, f"file://{tmp_path}/out")
    again = tasks.trajectories(tasks.read_tasks(spark, f"file://{tmp_path}/out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert "Alice: hi" in tasks.transcripts(rows).first()["text"]
    flat = f"file://{tmp_path}/flat"
    rows.write.parquet(flat)  # the flattened table prunes to the columns asked for
    plan = spark.read.parquet(flat).where("task_id = 1").select("reward")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<task_id:int,reward:double>" in plan and "EqualTo(task_id,1)" in plan
    assert tasks.render_report(rows.groupBy("task_id").count(), "T").startswith("# T\n\n| task_id | count |")
    tasks.write_splits(rows.limit(0).selectExpr("task_id", "'train' as split"), f"file://{tmp_path}/empty")


def test_stream(spark, tmp_path):
    source, out, at = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    source.mkdir()

    def run():
        def score(df):
            answers, is_list = tasks.gold_answers(df["answer"])
            return scoring.score(df.drop("correct_score", "token_score", "ppl_score", "reward").withColumns({"answers": answers, "answer_is_list": is_list, "losses": F.array(F.lit(1.0))}), token_cap=100.0)

        score_stream(stream_tasks(spark, f"file://{source}"), out, at, score).awaitTermination()
        return spark.read.parquet(out)

    (source / "a.jsonl").write_text(line(0) + "\n" + line(0) + "\n")
    assert run().count() == 2
    (source / "b.jsonl").write_text(line(0) + "\n" + line(1) + "\n")
    got = run()
    assert sorted({r["task_id"] for r in got.collect()}) == [0, 1] and got.count() == 4
    assert got.select("correct_score").distinct().collect()[0][0] == 1.0


def test_a_stream_that_fails_in_a_batch_goes_on(spark, tmp_path):
    source, out, at = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    source.mkdir()

    def run(broken=False):
        def score(df):
            return df.selectExpr("task_id", "trajectory_id", "if(task_id = 7 and trajectory_id = 1, raise_error('lost'), 1) as x" if broken else "1 as x")

        score_stream(stream_tasks(spark, f"file://{source}"), out, at, score).awaitTermination()
        return sorted((r["task_id"], r["trajectory_id"]) for r in spark.read.parquet(out).collect() if r["task_id"] is not None)

    both = lambda *ids: [(i, k) for i in ids for k in (0, 1)]
    (source / "a.jsonl").write_text("\n".join(line(k) for k in (0, 1)) + "\n")
    assert run() == both(0, 1)
    (source / "b.jsonl").write_text("\n".join(line(k) for k in (1, 6, 7)) + "\n")
    with pytest.raises(Exception, match="lost"):
        run(broken=True)
    (source / "c.jsonl").write_text("\n".join(line(k) for k in (7, 0, 8)) + "\n")
    assert run() == both(0, 1, 6, 7, 8)
    nameless = [line(0).replace('{"task_id": 0, "results"', '{"results"'), line(0, 3).replace('{"task_id": 0, "results"', '{"results"')]
    (source / "d.jsonl").write_text("\n".join([*nameless, nameless[0], line(8)]) + "\n")
    assert len(run()) == 10 + 5


def test_published_lines_survive_a_failed_run(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    (tmp_path / "a.jsonl").write_text("\n".join(line(k) for k in (5, 3, 4)) + "\n")
    rows = tasks.trajectories(tasks.read_tasks(spark, f"file://{tmp_path}/a.jsonl"))
    held = lambda: [r["task_id"] for r in tasks.published_tasks(spark, path).collect()]
    assert held() == []
    tasks.publish_tasks(rows.where("task_id <> 4"), path, token="first")
    assert sorted(held()) == [3, 5]
    tasks.publish_tasks(rows.where("task_id = 4"), path, token="first")  # that run is done
    assert sorted(held()) == [3, 5]
    broken = rows.withColumn("answer", F.expr("if(task_id = 4, raise_error('lost'), answer)"))
    for replace in (True, False):
        with pytest.raises(Exception, match="lost"):
            tasks.publish_tasks(broken, path, replace=replace)
        assert sorted(held()) == [3, 5]
    tasks.publish_tasks(rows, path)
    assert sorted(held()) == [3, 4, 5] and tasks.trajectories(tasks.published_tasks(spark, path)).count() == 6
    tasks.publish_tasks(tasks.trajectories(tasks.published_tasks(spark, path)), path, replace=True)
    assert sorted(held()) == [3, 4, 5]
    files = sorted(f for f in (tmp_path / "set" / "sets").iterdir())
    newest = max(files, key=lambda f: f.stat().st_mtime)
    ordered = [json.loads(x)["task_id"] for f in sorted(newest.glob("part-*")) for x in f.read_text().splitlines()]
    assert ordered == [3, 4, 5]


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["select_top_window", "tree_pairs", "sc_curve", "load_hotpot"])
def test_queries_run_on_small_tables(spark, name):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect() is not None
