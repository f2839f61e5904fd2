"""Order-dependent steps over the rollouts of a task, as grouped Arrow and pandas functions.

Groups are the rollouts of one task, bounded by the search budget.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from turnmill.shipping import ship
from turnmill.types import Settings

DEFAULTS = Settings()


def distance(a: str, b: str) -> int:
    """Edit distance of two strings, bit-parallel: a column of the table is held as two integers of len(a) bits."""
    if not a:
        return len(b)
    rows: dict[str, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    vp, vn, out = full, 0, len(a)
    for y in b:
        x = rows.get(y, 0)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        out += bool(hp & last) - bool(hn & last)
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return out


def within(a: str, b: str, most: int) -> bool:
    """Whether two strings are at most so many edits apart; cheap bounds come first."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or most < 1:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    # An edit changes the count of two characters at most.
    counts = Counter(a)
    counts.subtract(b)
    if sum(map(abs, counts.values())) > 2 * most:
        return False
    return distance(a, b) <= most


def replay_tree(rollouts: DataFrame, share: float = DEFAULTS.merge_share) -> DataFrame:
    """Merge recorded rollouts (task_id, rollout, reward, contents) into a tree.

    In order of rollout, each turn joins the first child of the node it is at
    whose content is within an edit share (over the new length plus one), or
    becomes a new child.  Values are means over the rollouts that cross a node,
    of those with a reward; null contents are none, and a null turn is an empty one.
    """

    def mean(rewards: list[float | None]) -> float | None:
        known = [r for r in rewards if r is not None]
        return sum(known) / len(known) if known else None

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["rollout"] is None, r["rollout"]))
        nodes = [{"parent": None, "depth": 0, "content": "", "children": [], "rewards": []}]
        for row in rows:
            at, path = 0, [0]
            for content in (c or "" for c in row["contents"] or []):
                most = math.ceil(share * (len(content) + 1)) - 1
                child = next((c for c in nodes[at]["children"] if within(nodes[c]["content"], content, most)), None)
                if child is None:
                    child = len(nodes)
                    nodes.append({"parent": at, "depth": nodes[at]["depth"] + 1, "content": content, "children": [], "rewards": []})
                    nodes[at]["children"].append(child)
                at = child
                path.append(at)
            for k in path:
                nodes[k]["rewards"].append(row["reward"])
        return pa.table(
            {
                "task_id": pa.array([rows[0]["task_id"]] * len(nodes), group.schema.field("task_id").type),
                "node_id": [f"node_{k}" for k in range(len(nodes))],
                "parent_id": pa.array([None if n["parent"] is None else f"node_{n['parent']}" for n in nodes], pa.string()),
                "depth": pa.array([n["depth"] for n in nodes], pa.int32()),
                "seq": pa.array(range(len(nodes)), pa.int32()),
                "content": [n["content"] for n in nodes],
                "value": pa.array([mean(n["rewards"]) for n in nodes], pa.float64()),
                "visits": [len(n["rewards"]) for n in nodes],
            }
        )

    ship(rollouts.sparkSession)
    kind = rollouts.schema["task_id"].dataType.simpleString()
    return rollouts.groupBy("task_id").applyInArrow(build, f"task_id {kind}, node_id string, parent_id string, depth int, seq int, content string, value double, visits long")


def f1(a: list[str], b: list[str]) -> float:
    both = sum((Counter(a) & Counter(b)).values())
    return 2 * both / (len(a) + len(b)) if both else 0.0


def cluster_by_f1(answers: DataFrame, least: float = DEFAULTS.consensus) -> DataFrame:
    """Greedy clusters of a task's answers (task_id, pos, final_answer): the first cluster with any member alike enough, else a new one.

    Returns the members of the largest cluster, the first of equals.  A missing answer is alike to none.
    """

    def words(text: str | None) -> list[str]:
        return (text or "").lower().strip().strip("m=").strip("m =").split()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        clusters: list[list[tuple]] = []
        for k, text in zip(rows["pos"], rows["final_answer"], strict=True):
            own = words(text)
            home = None if text is None else next((c for c in clusters if any(f1(own, other) >= least for _, other in c)), None)
            if home is None:
                clusters.append([(k, own)])
            else:
                home.append((k, own))
        largest = {k for k, _ in max(clusters, key=len)}
        return rows[rows["pos"].isin(largest)]

    ship(answers.sparkSession)
    return answers.groupBy("task_id").applyInPandas(build, answers.schema)
