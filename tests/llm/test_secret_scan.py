import re

import numpy as np

from turnmill.llm import secret_scan as ss

SF = "/root/testdata/sf0.01"


def test_candidates_and_places(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [None, "", "no keys here", f"é token = \"{key}\" and\n{key}x {key[:15]}", key, "x" * 40, "-----BEGIN RSA PRIVATE KEY-----\nabc", f"{key}=={key}", ("w " + key + " ") * 200]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(4, key, "c"), (None, key, "c")], "doc_id long, text string, candidate string")
    got = ss.scan_secrets(df).collect()
    want = []
    pattern = re.compile(ss.CANDIDATE.replace("}+=", "}=").replace("{16,}", "{16,}"))
    for k, t in [*enumerate(texts), (4, key), (None, key)]:
        want += [(k, n, m.start() + 1, m[0]) for n, m in enumerate(pattern.finditer(t or ""))]
    assert sorted(((r["doc_id"], r["finding_no"], r["start"], r["candidate"]) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r["score"] <= 1 and r["is_secret"] == (r["score"] >= 0.5) and r["length"] == len(r["candidate"]) for r in got)
    assert [r["is_secret"] for r in got if r["doc_id"] == 3 and r["finding_no"] == 0] == [True]
    assert [r["score"] for r in got if r["doc_id"] == 6] == [1.0]
    assert ss.scan_secrets(df.limit(0)).collect() == []


def test_held_out_findings(spark):
    rows = ss.labelled_findings(spark, 3000)
    again = ss.labelled_findings(spark, 3000)
    assert rows.collect() == again.collect()
    names = list(ss.feature_columns())
    data = rows.select(*[v.alias(k) for k, v in ss.feature_columns().items()], "label").toPandas()
    x, y = data[names].to_numpy(), data["label"].to_numpy()
    rng = np.random.default_rng(0)
    part = rng.random(len(y)) < 0.6
    forest = [ss.Tree.grow(x[part][k], y[part][k], np.random.default_rng(t), 5) for t in range(15) for k in [rng.integers(0, part.sum(), part.sum())]]

    def vote(tree, row):
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    score = np.array([np.mean([vote(t, row) for t in forest]) for row in x[~part]])
    assert np.mean((score >= 0.5) == y[~part]) > 0.97


def test_documents(spark):
    got = ss.scan_secrets(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    keys = [r for r in got if re.fullmatch("[0-9a-f]{40}", r["candidate"])]
    assert keys and all(r["is_secret"] for r in keys)
    assert not any(r["is_secret"] for r in got if re.fullmatch("[0-9]+", r["candidate"]))


def test_native_plan(spark):
    df = ss.scan_secrets(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
