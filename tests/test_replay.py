import random

from turnmill.operators import replay
from turnmill.plans import fixture, records

SF = "/root/testdata/sf0.001"


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    rnd = random.Random(5)
    make = lambda: "".join(rnd.choice("abé") for _ in range(rnd.choice([0, 1, 3, 30, 90])))
    for _ in range(300):
        a, b = make(), make()
        assert replay.distance(a, b) == plain(a, b)


def test_query_merges_whole_turns(spark):
    said = {(r["task_id"], t["content"]) for r in fixture.trajectories(spark, SF).collect() for t in r["turns"]}
    got = {(r["task_id"], r["content"]) for r in records.replayed(spark, SF).where("depth > 0").collect()}
    assert got <= said and max(len(content) for _, content in got) > 400


def replayed(rows, share):
    """The tree by the rule, with whole distances: (task, node, parent, depth, content, mean, visits)."""
    out = []
    for task in sorted({r[0] for r in rows}):
        nodes = [[None, 0, "", []]]
        for _, _, reward, contents in sorted(r for r in rows if r[0] == task):
            at = 0
            nodes[0][3].append(reward)
            for content in contents:
                near = [k for k, n in enumerate(nodes) if n[0] == at and k and plain(n[2], content) / (len(content) + 1) < share]
                if not near:
                    nodes.append([at, nodes[at][1] + 1, content, []])
                    near = [len(nodes) - 1]
                at = near[0]
                nodes[at][3].append(reward)
        out += [(task, k, n[0], n[1], n[2], round(sum(n[3]) / len(n[3]), 9), len(n[3])) for k, n in enumerate(nodes)]
    return sorted(out, key=repr)


def got_of(df):
    number = lambda x: None if x is None else int(x.split("_")[1])
    return sorted(((r["task_id"], number(r["node_id"]), number(r["parent_id"]), r["depth"], r["content"], round(r["value"], 9), r["visits"]) for r in df.collect()), key=repr)


def test_trees_as_by_the_rule(spark):
    rnd = random.Random(3)

    def said(base):
        out = list(base)
        for _ in range(rnd.randrange(5)):
            out[rnd.randrange(len(out))] = rnd.choice("abcé")
        return "".join(out)

    bases = ["the first thing to say", "another thing entirely", "x", "ab"]
    rows = [(k % 4, k, rnd.random(), [said(rnd.choice(bases)) for _ in range(rnd.randrange(4))] + [""] * rnd.randrange(2)) for k in range(60)]
    df = spark.createDataFrame(rows, "task_id int, rollout int, reward double, contents array<string>").repartition(3)
    for share in (0.1, 0.25):
        assert got_of(replay.replay_tree(df, share)) == replayed(rows, share)


def test_the_query_over_the_fixture(spark):
    rows = [(r["task_id"], r["conv_id"], r["reward"], [t["content"] for t in r["turns"]]) for r in fixture.scored(spark, SF).collect()]
    # Whole distances of long turns are slow here; texts that differ much in length or characters are no closer than that.
    assert got_of(records.replayed(spark, SF)) == replayed_quickly(rows)


def replayed_quickly(rows):
    global plain
    whole = plain
    try:
        plain = lambda a, b: 0 if a == b else len(b) + 1 if abs(len(a) - len(b)) > len(b) // 5 else whole(a, b)
        return replayed(rows, replay.DEFAULTS.merge_share)
    finally:
        plain = whole


def test_within_agrees_with_whole_distances():
    rnd = random.Random(8)
    make = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(9)))
    for _ in range(2000):
        a, b, most = make(), make(), rnd.randrange(-1, 6)
        assert replay.within(a, b, most) == (plain(a, b) <= max(most, 0) if a == b or most >= 0 else False)


def test_trees_with_nulls(spark):
    rows = [(None, 2, None, ["a", None]), (None, None, 4.0, None), (None, 1, 1.0, ["a", ""])]
    df = spark.createDataFrame(rows, "task_id int, rollout int, reward double, contents array<string>")
    got = {r["node_id"]: (r["parent_id"], r["content"], r["value"], r["visits"]) for r in replay.replay_tree(df, 0.1).collect()}
    assert got == {"node_0": (None, "", 2.5, 3), "node_1": ("node_0", "a", 1.0, 2), "node_2": ("node_1", "", 1.0, 2)}
