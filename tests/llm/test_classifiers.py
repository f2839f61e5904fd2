import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnmill.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    x = quality.features(pa.array([None, "", "a", "a b a b", "é É", "##! ##! ##!\n##! ##! ##!", "x " * 9000, "\n\n"]))
    assert x.shape == (8, quality.N_FEATURES) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert x[3][5] == 0.5 and x[3][7] == 2 / 3 and x[5][8] == 1 and x[5][9] == 0.5
    alone = [quality.features(pa.array([t]))[0] for t in ("a b a b", "x " * 9000)]
    assert (alone[0] == x[3]).all() and (alone[1] == x[6]).all()


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for k, r in out.items())
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 1), (2, "", 1), (2, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 4 and all(abs(r["score"] - 0.7) < 1e-9 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []
    no_labels = quality.BradleyTerry.fit(np.zeros((0, quality.N_FEATURES)), np.zeros(0))
    assert no_labels.score(np.ones((2, quality.N_FEATURES))).round(6).tolist() == [0.7, 0.7]


def test_windows_cover_texts():
    raw, limits = np.arange(1, 12, dtype=np.uint8), np.array([0, 0, 5, 11])
    x, doc = language.windows(raw, limits, 4)
    assert doc.tolist() == [1, 1, 2, 2]
    assert x.tolist() == [[1, 2, 3, 4], [5, 0, 0, 0], [6, 7, 8, 9], [10, 11, 0, 0]]
    assert bytes(language.fold(np.frombuffer("AZ É×ß 7".encode(), np.uint8))).decode() == "az é×ß 0"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = language.ByteCNN(["a", "b"], size=3, filters=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 20, (5, 12)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        return -np.log(model._softmax(model._pooled(x)[0])[np.arange(5), y]).mean()

    for name, g in model._gradients(x, y).items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in g.shape)
            was = model.p[name][at]
            model.p[name][at] = was + 1e-5
            up = loss()
            model.p[name][at] = was - 1e-5
            down = loss()
            model.p[name][at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4, name


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.93


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "12 !", "en", 1), (3, "", "fr", 1), (None, "the", "en", 1), (5, "abc é", None, 1)], "doc_id long, text string, lang string, score int")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert len(out) == 5 and out[1] == out[2] == out[3] == ("und", 0.0)
    assert language.identify(docs.where("doc_id < 0")).collect() == []
    some = docs.union(spark.createDataFrame([(k, "only english words here", "en", 1) for k in range(100, 120)], docs.schema))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(some).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "lang_pred").collect()}
    assert found[1] == "und" and found[-1] == found[5] == found[110] == "en"
