import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from turnmill.llm import lexical_search as ls

from .test_edges import LONG, widened


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(counted), sum(n for _, _, n in counted)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in c for _, c, _ in counted) + 1))) for w in words} if n_docs else {}
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_all
            scores.append((sum(weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(60)] + ["Größe", "naïve", "3d"]
    text = lambda most: " ".join(rnd.choice(vocabulary[: rnd.choice([4, 20, 63])]) for _ in range(rnd.randrange(most)))
    docs = [(k, text(60)) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(25)]  # ties beyond the tenth
    docs += [(None, docs[3][1]), (5, docs[5][1]), (None, None), (7000, ""), (7001, "... !"), (7002, "T1,t1;T2-t3_" + "ÄÖ")]
    items = [(k, text(12)) for k in range(12)] + [(3, "t1 GRÖSSE größe"), (None, "t2 t3"), (50, None), (51, "unheard"), (52, "t1 t1 t1")]
    return docs, items


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_ranks_as_by_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(ls, "SHARD_DOCS", 64)
    docs, items = corpus(n, n + 6)
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = lambda **kw: sorted((tuple(r) for r in ls.ranked_search(d, i, **kw).collect()), key=repr)
    assert got() == brute(docs, items)
    assert got(group_terms=5, top=3) == brute(docs, items, 3)


def test_a_shard_returns_what_a_full_scan_returns():
    rng = np.random.default_rng(2)
    for width in (1, 2, 15, 16, 17, 300, 5000):
        pairs = np.unique(rng.integers(0, width * 30, width * 6))
        doc, term = pairs // 30, pairs % 30
        value = rng.integers(1, 50, len(pairs))  # many ties
        shard = ls.Shard(doc, term, value, 30)
        ids = rng.permutation(width).tolist()
        for _ in range(5):
            asked = np.unique(rng.integers(0, 30, 6))
            weights = rng.integers(1, 9, len(asked))
            scores = np.zeros(width, np.int64)
            for t, w in zip(asked, weights, strict=True):
                scores[doc[term == t]] += w * value[term == t]
            want = sorted((-int(s), False, ids[k]) for k, s in enumerate(scores) if s)[:10]
            assert shard.search(asked, weights, ids, [], 10) == want


def test_bounds_keep_most_of_a_tree_closed():
    width = 1 << 14
    doc = np.arange(width)
    value = np.ones(width, np.int64)
    value[777] = 100
    shard, seen = ls.Shard(doc, np.zeros(width, np.int64), value, 1), []
    shard.opened = lambda level, *rest: seen.append(len(level)) or ls.Shard.opened(shard, level, *rest)
    assert shard.search(np.array([0]), np.array([1]), list(range(width)), [], 1) == [(-100, False, 777)]
    assert sum(seen) < 300


def test_long_texts_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "w5 w5"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", LONG.split()[-1] + " w5")], "item_id string, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    plain = rows(ls.ranked_search(docs, items))
    assert plain == brute([(1, LONG), (2, "w5 w5"), (3, None)], [("a", LONG.split()[-1] + " w5")])
    assert rows(ls.ranked_search(widened(docs), widened(items))) == plain
    assert ls.ranked_search(docs.limit(0), items).count() == ls.ranked_search(docs, items.limit(0)).count() == 0
