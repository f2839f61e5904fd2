"""Preference pairs: from the branches of a state, and from search trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as X
from turnmill.types import Settings

from .edit_join import first_alike

DEFAULTS = Settings()

# What the older settings' names stand for; they are the other way round than they read.
LEGACY_THRESHOLDS = {"dpo_episilon": "min_value", "dpo_min_value": "min_gap"}


def legacy_thresholds(**settings: float) -> dict[str, float]:
    """Arguments of ``extremes`` and the functions on it from settings by their older names."""
    return {LEGACY_THRESHOLDS[name]: value for name, value in settings.items()}


def candidate_values(branches: DataFrame, keys: list[str]) -> DataFrame:
    """The mean effective reward of each different candidate of a state, and its first branch; empty and "error" go."""
    trimmed = branches.withColumn("candidate", X.trimmed(F.col("candidate"))).where("candidate <> '' and candidate <> 'error'")
    return trimmed.groupBy(*keys, "candidate").agg(F.avg("effective_reward").alias("value"), F.min("branch_id").alias("seq"))


def extremes(values: DataFrame, keys: list[str], min_value: float = DEFAULTS.min_value, min_gap: float = DEFAULTS.min_gap) -> DataFrame:
    """Best and worst (candidate, value, seq) of each group of two or more, if both strict thresholds hold.

    The best is the first of the highest, the worst the last of the lowest.
    """
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "seq"))
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy("value", F.desc("seq")))
    ranked = values.withColumns({"_best": best, "_worst": worst}).where("_best = 1 or _worst = 1")

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col(side) == 1, F.col(column)))

    out = ranked.groupBy(*keys).agg(
        of("_best", "candidate").alias("chosen"),
        of("_worst", "candidate").alias("rejected"),
        of("_best", "value").alias("chosen_value"),
        of("_worst", "value").alias("rejected_value"),
        F.count("*").alias("_n"),
    )
    gap = F.col("chosen_value") - F.col("rejected_value")
    return out.where(F.col("_n") > 1).drop("_n").withColumn("distance", gap).where((F.col("chosen_value") > min_value) & (F.col("distance") > min_gap))


def state_pairs(branches: DataFrame, keys: list[str], min_value: float = DEFAULTS.min_value, min_gap: float = DEFAULTS.min_gap) -> DataFrame:
    """A pair for each state whose candidates differ enough."""
    return extremes(candidate_values(branches, keys), keys, min_value, min_gap)


def backpropagate(paths: DataFrame) -> DataFrame:
    """Node values of rollouts (task_id, rollout, reward, path of node ids): the mean over the rollouts that cross a node."""
    each = paths.select("task_id", "rollout", "reward", F.posexplode("path").alias("depth", "node_id"), "path")
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    return each.withColumn("parent_id", parent).groupBy("task_id", "node_id", "parent_id", "depth").agg(F.avg("reward").alias("value"), F.count("*").alias("visits"), F.min("rollout").alias("seq"))


def path_extremes(paths: DataFrame) -> DataFrame:
    """The older best and worst child of each node, which depend on the order of the rollouts (task_id, rollout, reward, path).

    When a rollout changes a child's mean, that child is compared with those
    then held as best and worst; another child that a change leaves behind as
    the best or worst is not looked up.
    """
    each = paths.select("task_id", "rollout", "reward", F.posexplode("path").alias("depth", "node_id"), "path")
    running = F.avg("reward").over(Window.partitionBy("task_id", "node_id").orderBy("rollout"))
    steps = each.withColumn("value", running).where("depth > 0").withColumn("parent_id", F.get("path", F.col("depth") - 1))
    groups = steps.groupBy("task_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("rollout", "node_id", "value"))).alias("steps"))

    def held(state: Column, side: str, x: Column) -> tuple[Column, Column]:
        now = F.when(state[side] == x["node_id"], x["value"]).otherwise(state[f"{side}_value"])
        beyond = x["value"] < now if side == "rejected" else x["value"] > now
        changes = state[side].isNull() | beyond
        return F.when(changes, x["node_id"]).otherwise(state[side]).alias(side), F.when(changes, x["value"]).otherwise(now).alias(f"{side}_value")

    kind, none = paths.schema["path"].dataType.elementType, F.lit(None)
    start = F.struct(*[c for side in ("chosen", "rejected") for c in (none.cast(kind).alias(side), none.cast("double").alias(f"{side}_value"))])
    last = F.aggregate("steps", start, lambda state, x: F.struct(*held(state, "chosen", x), *held(state, "rejected", x)))
    return groups.withColumn("held", last).select("task_id", "parent_id", "held.*")


def tree_pairs(edges: DataFrame, min_value: float = DEFAULTS.min_value, min_gap: float = DEFAULTS.min_gap, keep_share: float = DEFAULTS.pair_keep_share) -> DataFrame:
    """Pairs of the best and worst child of each parent; of a task's two or more pairs the better share stays, one at least.

    edges has task_id, node_id, parent_id, depth, seq, content and value; the
    speaker goes by the parent's depth.
    """
    children = edges.where("parent_id is not null").select("task_id", "parent_id", (F.col("depth") - 1).alias("depth"), F.col("content").alias("candidate"), "value", "seq")
    pairs = extremes(children, ["task_id", "parent_id", "depth"], min_value, min_gap)
    by_task = Window.partitionBy("task_id")
    n = F.count("*").over(by_task)
    keep = F.when(n >= 2, F.greatest(F.lit(1), F.floor(F.lit(float(keep_share)) * n))).otherwise(n)
    place = F.row_number().over(by_task.orderBy(F.desc("chosen_value"), "parent_id"))
    kept = pairs.withColumns({"_place": place, "_keep": keep}).where("_place <= _keep").drop("_place", "_keep")
    return kept.withColumn("speaker", F.when(F.col("depth") % 2 == 0, "Alice").otherwise("Bob")).withColumnRenamed("parent_id", "state_id")


def softmax_draw(nodes: DataFrame, keys: list[str], draw: Column, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """Of each group's top_k by value, the first whose cumulated softmax weight reaches draw (0..1) of the sum."""
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "node_id")
    top = nodes.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top_k)
    group = Window.partitionBy(*keys)
    weighed = top.withColumn("_weight", F.exp(F.col("value") - F.max("value").over(group)))
    summed = weighed.withColumns({"_sum": F.sum("_weight").over(group), "_upto": F.sum("_weight").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(group)})
    reached = summed.where((F.col("_upto") >= draw * F.col("_sum")) | (F.col("_place") == F.col("_n")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))
    return reached.withColumn("_first", first).where("_first = 1").select(*nodes.columns)


def argmax_argmin(df: DataFrame, value: str = "reward", task: str = "task_id", tie: str = "trajectory_id") -> DataFrame:
    """The first best and the first worst row of each task (the older pair rule)."""
    best = F.row_number().over(Window.partitionBy(task).orderBy(F.desc(value), tie))
    worst = F.row_number().over(Window.partitionBy(task).orderBy(value, tie))
    both = df.withColumns({"_best": best, "_worst": worst}).where("_best = 1 or _worst = 1")
    return both.groupBy(task).agg(*[F.max(F.when(F.col(side) == 1, F.col(tie))).alias(name) for side, name in (("_best", "chosen_id"), ("_worst", "rejected_id"))])


def unlike_selected(nodes: DataFrame, selected: DataFrame, keys: list[str], share: float = DEFAULTS.select_share, earlier: str | None = None) -> DataFrame:
    """The nodes whose content is not within an edit share of any selected node of the same group.

    earlier: a column by which selected nodes must come before the node.  Different
    contents meet once, through an index of segments (``edit_join``).  Nodes
    without content or with a null key are like nothing.
    """
    known = F.col("content").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    group = F.struct(*keys).alias("group")
    texts = nodes.where(known).select(group, "content").distinct()
    others = selected.where(known).groupBy(group, "content").agg((F.min(earlier) if earlier else F.first(F.lit(0))).alias("first"))
    found = first_alike(texts, others, share).select(F.col("group").alias("_group"), F.col("content").alias("_content"), F.col("first").alias("_first"))
    met = nodes.join(found, (F.struct(*keys) == F.col("_group")) & (F.col("content") == F.col("_content")), "left")
    gone = F.col("_first") < F.col(earlier) if earlier else F.col("_first").isNotNull()
    return met.where(~F.coalesce(gone, F.lit(False))).select(*nodes.columns)
