"""Ranking, trimming and selecting trajectories; splits by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.staging import stage
from turnmill.types import Settings

from .scoring import effective_reward, name_penalty

DEFAULTS = Settings()


def best_per_task(df: DataFrame, value: str = "effective_reward", task: str = "task_id", tie: str = "trajectory_id") -> DataFrame:
    """The row of the highest value of each task, the first among ties."""
    first = F.row_number().over(Window.partitionBy(task).orderBy(F.desc(value), tie))
    return df.withColumn("_place", first).where("_place = 1").drop("_place")


def numbered(df: DataFrame, order: str, ties: list[str], by: list[str], place: str, total: str, descending: bool = False) -> DataFrame:
    """Number the rows of each group from 0 in an order (nulls last), and count them.

    Rows are dealt to ranges of (group, order, ties), so that neither one large group
    nor one value with many ties goes to one task; without ties, a hash of the row
    parts equal values.  A row's place in its sorted range, less that of its group's first
    row there, and the group's rows in the ranges before make its number.
    """
    kept = [c for c in df.columns if c not in (place, total)]
    parted = [] if ties else [F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])]
    sort = [*[F.asc_nulls_first(c) for c in by], F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), *[F.asc(c) for c in ties], *[x.asc() for x in parted]]
    ranges = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # The lower 33 bits count the rows of a partition.
    dealt = ranges.withColumns({"_nth_part": F.spark_partition_id(), "_nth_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = stage(dealt.select(*df.columns, "_nth_part", "_nth_at"), "ranges")
    own = [f"_nth_g{k}" for k in range(len(by))]
    counts = dealt.groupBy(*[F.col(c).alias(g) for c, g in zip(by, own, strict=True)], F.col("_nth_part").alias("_nth_p")).agg(F.count("*").alias("_nth_k"), F.min("_nth_at").alias("_nth_first"))
    before = Window.partitionBy(*own).orderBy("_nth_p").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(*own, "_nth_p", (F.coalesce(F.sum("_nth_k").over(before), F.lit(0)) - F.col("_nth_first")).alias("_nth_move"), F.sum("_nth_k").over(Window.partitionBy(*own)).alias("_nth_all"))
    same = F.col("_nth_part") == F.col("_nth_p")
    for c, g in zip(by, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return dealt.join(moved, same).select(*kept, (F.col("_nth_at") + F.col("_nth_move")).alias(place), F.col("_nth_all").alias(total))


def with_place(df: DataFrame, value: str, ties: list[str], name: str = "place") -> DataFrame:
    """Number all rows from 0 by descending value, and give their count as ``total``."""
    return numbered(df, value, ties, [], name, "total", True)


def place_in_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """Number the rows of each group from 0 by key (column ``_place``), and count them (``_n``)."""
    return numbered(df, key, [], [group], "_place", "_n")


def select_trajectories(df: DataFrame, trim_low: float = DEFAULTS.trim_low, trim_high: float = DEFAULTS.trim_high, epsilon: float = DEFAULTS.epsilon, penalise_names: bool = True) -> DataFrame:
    """The best trajectory of each task, inside the trim window and at or above epsilon, ranked from 0."""
    scored = df.withColumn("name_penalty", name_penalty(F.col("conversation"), penalise_names)).withColumn("effective_reward", effective_reward(F.col("reward"), F.col("name_penalty")))
    placed = with_place(best_per_task(scored), "effective_reward", ["task_id"])
    low, high = (F.floor(F.lit(float(x)) * F.col("total")) for x in (trim_low, trim_high))
    chosen = placed.where((F.col("place") >= low) & (F.col("place") < high) & (F.col("effective_reward") >= epsilon))
    # In descending order, what the window and the threshold leave is one run of places.
    return chosen.withColumn("rank", F.col("place") - low).drop("place", "total")


def select_by_dataset(df: DataFrame, dataset: str = "dataset_name", epsilon: float = DEFAULTS.epsilon) -> DataFrame:
    """The older selection: the best of each task, then of each data set a window of places, then the threshold.

    Maths and ARC leave out the first tenth and the last fifth, all others the last three tenths.
    """
    best = best_per_task(df, "reward")
    placed = numbered(best, "reward", ["task_id"], [dataset], "_place", "_n", True)
    hard = F.col(dataset).isin("math", "arc")
    low = F.when(hard, F.floor(F.lit(0.1) * F.col("_n"))).otherwise(F.lit(0))
    high = F.floor(F.when(hard, F.lit(0.8)).otherwise(F.lit(0.7)) * F.col("_n"))
    return placed.where((F.coalesce(F.col("_place") >= low, F.lit(False))) & (F.col("_place") < high) & (F.col("reward") >= epsilon)).drop("_place", "_n")


def selection_means(df: DataFrame, epsilon: float = DEFAULTS.epsilon) -> DataFrame:
    """Of the best of each task: how many reach epsilon, and their mean tokens and reward (null if there are none)."""
    passed = F.col("reward") >= epsilon
    best = best_per_task(df, "reward")
    return best.agg(F.count_if(passed).alias("count"), F.avg(F.when(passed, F.col("token_count"))).alias("average_token"), F.avg(F.when(passed, F.col("reward"))).alias("average_reward"))


def first_rows(df: DataFrame, key: str, count: int | None = None, share: float | None = None, by: str | None = None) -> DataFrame:
    """The first rows by a numeric or text key, as many as given or a share of them (rounded down), of all or of each group."""
    placed = numbered(df, key, [], [by] if by else [], "_place", "_n")
    limit = F.lit(count) if count is not None else F.floor(F.lit(float(share)) * F.col("_n"))
    return placed.where(F.col("_place") < limit).drop("_place", "_n")


def shuffle_key(seed: str, key: Column) -> Column:
    """A fixed pseudo-random order: md5 of a seed and a key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def split_rows(df: DataFrame, seed: str, key: str, train_share: float, least_train: int = 0, partition: list[str] | None = None) -> DataFrame:
    """Add split: the first floor(share * n) rows in md5 order are train, the rest test; of all rows, or of each partition.

    """
    by = partition or []
    shuffled = df.withColumn("_order", shuffle_key(seed, F.col(key)))
    return _cut(numbered(shuffled, "_order", [key], by, "_place", "_n"), train_share, least_train).drop("_order")


def split_in_order(df: DataFrame, key: str, ties: list[str], train_share: float, least_train: int = 0, partition: list[str] | None = None) -> DataFrame:
    """Add split by place: the first floor(share * n) rows, ``least_train`` at least, are train."""
    return _cut(numbered(df, key, ties, partition or [], "_place", "_n"), train_share, least_train)


def _cut(placed: DataFrame, train_share: float, least_train: int) -> DataFrame:
    cut = F.greatest(F.floor(F.lit(float(train_share)) * F.col("_n")), F.lit(least_train))
    return placed.withColumn("split", F.when(F.col("_place") < cut, "train").otherwise("test")).drop("_n", "_place")
