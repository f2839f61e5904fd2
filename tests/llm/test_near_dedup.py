import random
import re

import numpy as np
import pytest

from turnmill.llm import components, near_dedup as nd


def word_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [word_set(t, k) for _, t in rows]
    ids = [i for i, _ in rows]
    label = {i: i for i in ids if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            if None not in (ids[p], ids[q]) and sets[p] and sets[q]:
                both = len(sets[p] & sets[q])
                if 100 * both >= percent * len(sets[p] | sets[q]):
                    a, b = sorted((root(ids[p]), root(ids[q])))
                    label[b] = a
    out = []
    for i, s in zip(ids, sets):
        c = root(i) if i is not None else None
        out.append((i, len(s), c, i is None or c == i))
    return sorted(out, key=str)


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéF") for _ in range(rnd.randrange(2, 6)))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one"), (5, " \n"), (None, "one two"), (6, "a b c d"), (7, "a b c d"), (7, "a b c d")]
    n = 10
    for size, copies in [(60, 40), (30, 6), (200, 5), (12, 8), (80, 150)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 15))):
                w[rnd.randrange(size)] = word()
            rows.append((n, rnd.choice([" ", "\n", "\t "]).join(w)))
            n += 1
        rows.append((n, " ".join(base).upper().replace("É", "é")))
        n += 1
    rows.append((n, "long " * 3000))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,pivots", [(4, 8), (5, 2)])
def test_against_brute_force(spark, words, pivots):
    rows = corpus(words)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted((tuple(r) for r in nd.near_duplicates(df, words=words, pivots=pivots).collect()), key=str)
    assert got == brute(rows, words, 80)


def test_dropping(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "a b c d e f"), (4, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4]
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_registers_and_estimate():
    assert nd.compress(np.array([0, 1, 2**31, 2**32 - 1], np.uint32)).tolist() == [32 << 10, 31 << 10, 0, 1023]
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        s = nd.sketches([a, b])
        got = nd.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - share) < 4 * (share * (1 - share) / 128) ** 0.5
    unlike = nd.sketches([np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(60)])
    assert (unlike[:30] == unlike[30:]).mean() < 0.01


def test_components(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, 300), (5, 4)]
    label = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != 300}


def test_ids_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, nd.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute(rows, 4, 80)
    kept = {i for i, _, _, stays in got if stays}
    left = nd.drop_near_duplicates(df, words=4).collect()
    assert {r["doc_id"] for r in left} == kept
