import random

import pytest
from pyspark.sql import functions as F

from turnmill.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, text, n, letters):
    out = list(text)
    for _ in range(n):
        at, what = rnd.randrange(len(out) + 1), rnd.randrange(3)
        if what == 0 or not out:
            out.insert(at, rnd.choice(letters))
        elif what == 1:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rnd.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edits_within(spark, most):
    rnd = random.Random(most)
    pairs = [("", ""), ("", "a"), ("ab", ""), ("a", "b")]
    for _ in range(600):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 20)))
        pairs.append((a, edited(rnd, a, rnd.randrange(6), "abé")))
    df = spark.createDataFrame(pairs, "a string, b string").where(F.abs(F.length("a") - F.length("b")) <= most)
    got = df.select("a", "b", ld.edits_within(F.col("a"), F.col("b"), most).alias("ok")).collect()
    assert [(r["a"], r["b"], r["ok"]) for r in got] == [(r["a"], r["b"], distance(r["a"], r["b"]) <= most) for r in got]


def brute(docs, edits, min_chars, min_copies):
    rows = [(i, t, k, x) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted({x for *_, x in rows if x.strip()})
    label = {x: x for x in lines}
    for p, x in enumerate(lines):
        for y in lines[:p]:
            if min(len(x), len(y)) >= min_chars and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits:
                old, new = label[x], label[y]
                label = {k: new if v == old else v for k, v in label.items()}
    out = []
    for i, t, k, x in rows:
        if not x.strip():
            out.append((i, k, None, None, None, None, True))
            continue
        members = [r for r in rows if r[3].strip() and label[r[3]] == label[x]]
        key = lambda r: (r[0] is None, r[0] or 0)
        least = min(map(key, members))
        firsts = [r for r in members if key(r) == least]
        text = firsts[0][1]
        line = min(r[2] for r in firsts if r[1] == text)
        stays = len(members) < min_copies or (i == firsts[0][0] and t == text and k == line)
        out.append((i, k, firsts[0][0], line, len(members), len({r[3] for r in members}), stays))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    bases = [make(rnd.randrange(10, 40)) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \n\t\n"), (3, "x"), (4, "tiny\ntiny\ntiny\ntinx\ntiny\ntiny\ntiny\ntiny"), (None, bases[0] + "\nnull id"), (5, "y" * 3000 + "\n" + "y" * 3001)]
    for k in range(6, 40):
        docs.append((k, "\n".join(rnd.choice([make(20), edited(rnd, rnd.choice(bases), rnd.randrange(5), "abcé"), rnd.choice(bases)]) for _ in range(rnd.randrange(1, 6)))))
    return docs + [docs[8], docs[8]]


@pytest.mark.parametrize("edits,min_chars", [(2, 16), (1, 8)])
def test_against_brute_force(spark, edits, min_chars):
    docs = corpus(edits)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line_no int").repartition(3)
    got = ld.line_classes(df, edits=edits, min_chars=min_chars).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, edits, min_chars, ld.MIN_COPIES)


def test_texts(spark):
    docs = corpus(7)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int").repartition(2)
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    stays = {(r[0], r[1]): r[6] for r in brute(docs, ld.EDITS, ld.MIN_CHARS, ld.MIN_COPIES)}
    want = sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if stays[i, k])) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    assert ld.line_classes(df.limit(0)).collect() == [] and ld.dedup_lines(df.limit(0)).collect() == []
    plan = ld.line_classes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_of_many_lines_in_blocks_and_by_merge_joins(spark, monkeypatch):
    """One template, lines one to six edits away from it and from each other: large keys, several components."""
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ld, "BLOCK_LINES", 3)
    rnd = random.Random(4)
    base = "the same words stand at the head of every line, number "
    docs = [(k, "\n".join(edited(rnd, base + str(rnd.randrange(30)), rnd.randrange(5), "abé 1") for _ in range(2))) for k in range(45)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _gone string").repartition(3)
    got = ld.line_classes(df).drop("text_key").collect()
    want = brute(docs, ld.EDITS, ld.MIN_CHARS, ld.MIN_COPIES)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({(r[2], r[3]) for r in want}) > 5 and max(r[5] for r in want) > 10
    assert ld.dedup_lines(df).columns == df.columns


def test_key_slots_cover_every_place():
    """Each pair within some edits has a key of the shorter one's own among the keys of the longer one."""
    rnd = random.Random(9)
    for edits in (1, 2, 3):
        slots = ld.key_slots(edits)

        def keys(x, only_own):
            base, r = divmod(len(x), edits + 1)
            return {(k, base + size, x[base * k + at :][: base + size]) for k, at, size, own in slots[r] if (own or not only_own) and 0 <= base * k + at and base * (k + 1) + at + size <= len(x) + base * 1}

        for _ in range(3000):
            a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(8, 30)))
            b = edited(rnd, a, rnd.randrange(edits + 1), "abc")
            short, long = sorted((a, b), key=len)
            if len(long) - len(short) <= edits:
                assert keys(short, True) & keys(long, False)


def test_lines_of_one_template_in_digits(spark, monkeypatch):
    """Numbers within two edits of each other or not, beside lines of other lengths; pieces of few and of many lines."""
    monkeypatch.setattr(ld, "BLOCK_LINES", 4)
    rnd = random.Random(12)
    line = lambda x: f"GET /items/{x} took some time to answer"
    numbers = [f"{rnd.randrange(10**9):09d}" for _ in range(40)] + [f"{k:03d}" for k in range(0, 60, 7)]
    numbers += [edited(rnd, x, 2, "0123456789") for x in numbers[:12]]
    docs = [(k, line(x)) for k, x in enumerate(numbers)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ld.line_classes(df).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, ld.EDITS, ld.MIN_CHARS, ld.MIN_COPIES)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_any_pieces_of_a_line_are_among_the_probes_of_near_ones(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    for k in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(edits + 1, 30)))
        b = edited(rnd, a, rnd.randrange(edits + 1), "abc")
        pairs.append((k, *sorted((a, b), key=len)))
    fits = [p for p in pairs if len(p[1]) > edits and len(p[2]) - len(p[1]) <= edits]  # shorter lines have no pieces
    df = spark.createDataFrame(fits, "node long, short string, long string")
    picks = ld.rarest_pieces(df.select("node", F.col("short").alias("line"), F.length("short").alias("length")), edits)
    probes = ld.piece_probes(df.select("node", F.col("long").alias("line"), F.length("long").alias("length")), edits)
    met = picks.join(probes, (picks["piece"] == probes["piece"]) & (picks["node"] == probes["node2"])).select("node").distinct()
    assert met.count() == df.count()


def test_probes_meet_only_pieces_of_other_components_and_fitting_lengths(spark):
    """Ten lines of one component, and two longer ones of the template, each its own component."""
    base = "the same words stand at the head of every line of this log, "
    lines = [(k, f"{base}{k % 10}", 0) for k in range(10)] + [(k, f"{base}{k:012d}", k) for k in (10, 11)]
    df = spark.createDataFrame(lines, "node long, line string, component long").withColumn("length", F.length("line"))
    picks = ld.rarest_pieces(df, 2).join(df.drop("line"), "node")
    probes = ld.piece_probes(df, 2, ("length", "component"))
    asked = ld.open_probes(probes, ld.piece_facts(picks), 2)
    every = probes.join(picks.select("piece").distinct(), "piece")
    fits = picks.join(probes, "piece").where("component <> component2 and length <= length2 and length2 - length <= 2")
    assert fits.select("node2").distinct().orderBy("node2").collect() == [(10,), (11,)]
    assert fits.select("piece", "node2").distinct().exceptAll(asked.select("piece", "node2")).isEmpty()
    assert asked.where("component2 = 0").isEmpty() and not every.where("component2 = 0").isEmpty()
