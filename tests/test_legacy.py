import json

from pyspark.sql import functions as F

from turnmill.operators import pairs, scoring
from turnmill.sources import datasets


def test_agreement(spark):
    turns = spark.createDataFrame([(1, 0, "Alice", "x"), (1, 1, "Bob", None), (1, 2, "Alice", "x"), (1, 3, "Bob", "x"), (2, 0, "Alice", "x"), (2, 1, "Bob", "y")], "c int, pos int, speaker string, parsed_answer string")
    found = lambda mode: sorted(tuple(r) for r in scoring.agreement(turns, ["c"], mode).collect())
    assert found("legacy") == [(1, 2, "x"), (2, None, "y")]
    assert found("current") == [(1, 3, "x"), (2, None, "y")]


def test_format(spark):
    """Names are no offence; stripping sets of characters joins some texts and keeps others apart."""
    rows = [["Alice: hi", "Bob: ho Alice: he"], ["Alice: hi", "Bob: HI"], ["Alice: good", "Bob: GOOD"], ["Alice: yes ", "Bob: yes"], ["lll", "", "x"], []]
    df = spark.createDataFrame([(r,) for r in rows], "c array<string>")
    plain = lambda s: s.strip().strip("Alice:").strip("Bob:").lower()
    expected = ["duplicate" if len({plain(s) for s in r}) < len(r) else None for r in rows]
    assert expected[1] is None and expected[3] == expected[4] == "duplicate"
    assert [r[0] for r in df.select(scoring.format_offence(F.col("c"), mode="legacy")).collect()] == expected
    assert df.select(scoring.format_offence(F.col("c"))).first()[0] == "name"


def plain_extremes(rollouts):
    nodes, out = {}, {}
    for path, reward in rollouts:
        for at in range(len(path) - 1, -1, -1):
            total, n = nodes.get(path[at], (0.0, 0))
            nodes[path[at]] = (total + reward, n + 1)
            if at:
                held = out.setdefault(path[at - 1], [path[at], path[at]])
                mean = lambda k: nodes[k][0] / nodes[k][1]
                if mean(path[at]) > mean(held[0]):
                    held[0] = path[at]
                if mean(path[at]) < mean(held[1]):
                    held[1] = path[at]
    return {k: tuple(v) for k, v in out.items()}


def test_path_extremes(spark):
    rewards = [0.5, 0.9, 0.1, 0.0, 0.7, 0.7, -1.0, 0.3]
    paths = [["", "a", "aa"], ["", "b"], ["", "b"], ["", "b", "ba"], ["", "c"], ["", "a", "ab"], ["", "c"], ["", "a", "aa"]]
    df = spark.createDataFrame([(1, k, r, p) for k, (r, p) in enumerate(zip(rewards, paths, strict=True))], "task_id int, rollout int, reward double, path array<string>")
    got = {r["parent_id"]: (r["chosen"], r["rejected"]) for r in pairs.path_extremes(df).collect()}
    assert got == plain_extremes(list(zip(paths, rewards, strict=True)))
    assert pairs.path_extremes(df.limit(0)).count() == 0


def test_thresholds():
    assert pairs.legacy_thresholds(dpo_episilon=0.4, dpo_min_value=0.2) == {"min_value": 0.4, "min_gap": 0.2}


def test_read_math(spark, tmp_path):
    for kind, name, text in (("algebra", "1.json", json.dumps({"problem": "p", "solution": r"so \boxed{\frac{1}{2}}"}, indent=1)), ("algebra", "2.json", "{broken"), ("geometry", "1.json", json.dumps({"problem": "q", "solution": "none"}))):
        folder = tmp_path / "train" / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    read = datasets.read_math(spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in read.collect()) == [("train/algebra/1.json", "p", r"so \boxed{\frac{1}{2}}"), ("train/geometry/1.json", "q", "none")]
    assert datasets.math(read).count() == 2
