import hashlib
import random
import re

import numpy as np
import pytest

from turnmill.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window=10):
    wins = []
    for item, text in bench:
        w = words(text)
        n = min(window, len(w))
        wins += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for d, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    if item != "None":
                        items.add(item)
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rnd = random.Random(5)
    vocab = ["a", "b", "c", "É", "z9", "ü", "dd"]
    bench = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 9, 10, 12, 15])))) for k in range(12)]
    bench += [(3, "A b"), (None, "c c c"), (50, None), (51, " .!? "), (10, "x")]
    docs = [(0, None), (1, ""), (2, " ... "), (3, "a" * 5000), (4, "The the the"), (5, "X"), (6, "a B."), (6, "a B.")]
    for k in range(7, 60):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            parts.append(" ".join(rnd.choice(vocab + ["other", "q"]) for _ in range(rnd.randrange(12))))
            parts.append(rnd.choice(bench)[1] or "")
        docs.append((k, rnd.choice([" ", "\n", ". "]).join(parts).replace("a", rnd.choice("aA"))))
    docs.append((60, "a b " * 3000))
    return docs, bench


@pytest.mark.parametrize("block_bytes", [1 << 20, 90])
def test_against_brute_force(spark, block_bytes):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = dc.find_contamination(d, b, block_bytes=block_bytes).collect()
    got = sorted((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found)
    assert got == sorted(brute(docs, bench))
    if block_bytes > 1000:
        report = sorted(tuple(r) for r in dc.contamination_report(d.select("doc_id", "text"), b).collect())
        assert report == sorted(brute(docs, bench))


def test_removal_and_empty_tables(spark):
    docs = [(1, "keep this One two three four five six seven eight nine ten!! and this"), (2, None), (3, "clean é")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = dict(dc.remove_contamination(d, b).collect())
    assert got == {1: "keep this !! and this", 2: None, 3: "clean é"}
    assert dict(dc.remove_contamination(d, b.limit(0)).collect()) == dict(docs)
    assert dc.contamination_report(d.limit(0), b).collect() == []


def test_index_counts_and_locates():
    rnd = np.random.default_rng(1)
    text = rnd.integers(1, 4, 500)
    index = dc.FMIndex(text, 4)
    patterns = rnd.integers(1, 4, (40, 5))
    which, low, high = index.search(patterns)
    for k in range(40):
        want = [i for i in range(496) if (text[i : i + 5] == patterns[k]).all()]
        at = np.flatnonzero(which == k)
        got = sorted(index.locate(np.arange(low[at[0]], high[at[0]]))) if len(at) else []
        assert got == want
