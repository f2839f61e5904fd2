import hashlib
import random
import zlib

import pytest

from turnmill.llm import conversation_trie as ct

from .test_edges import LONG, widened

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under)]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def talk(seed, n):
    """Conversations with common beginnings, equal ones, some within others, gaps, nulls and repeated rows."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample([x for x in range(700) if x not in (200, 300)], n):
        for turn in range(rnd.randrange(1, 9)):
            said = rnd.choice(["", None, "hé", "yes", "no 🙂"]) if rnd.random() < 0.7 else f"{rnd.randrange(5)}"
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", None]) if turn else "user", said if turn else "hello"))
    for c in range(800, 830):  # all the same, and as long as any
        rows += [(c, k, "user", "same") for k in range(7)]
    return rows + [(None, 0, "user", "nobody's"), rows[0], rows[0], (900, None, None, None), (901, 3, "user", "x"), (902, 1, "user", "y")]


@pytest.mark.parametrize("local", [ct.LOCAL_TURNS, 40, 1])
def test_nodes_as_by_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(ct, "CHUNK", 16)
    rows = talk(4, 150)
    assert rows_of(ct.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), local)) == brute(rows)


def test_long_conversations_and_texts(spark, monkeypatch):
    monkeypatch.setattr(ct, "BROADCAST_ROWS", 0)
    chain = [(c, k, "user", f"turn {k}") for c in (0, 1, 2) for k in range(400 + c)]
    rows = chain + [(c, 0, "user", LONG) for c in (60, 61)] + [(70, 0, "user", "other")]
    assert rows_of(ct.prefix_trie(spark.createDataFrame(rows, SCHEMA), 100)) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    rows = talk(6, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(ct.prefix_trie(widened(df))) == brute(rows)
    assert ct.prefix_trie(df.limit(0)).count() == 0
    only = spark.createDataFrame([(250, 0, "user", "gone")], SCHEMA)  # its block opens with nothing
    assert rows_of(ct.prefix_trie(only)) == brute([(250, 0, "user", "gone")])
