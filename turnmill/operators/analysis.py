"""Aggregates and reports over scored trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import latex
from turnmill.functions import text as X
from turnmill.staging import stage

from .quantiles import exact_quantiles
from .selection import numbered


def has_repeats(conversation: Column) -> Column:
    """Whether an utterance repeats another, sentinels aside."""
    said = F.transform(F.filter(conversation, lambda s: ~s.isin("large", "error")), X.strip_speaker)
    return F.size(F.array_distinct(said)) < F.size(said)


def run_summary(df: DataFrame) -> DataFrame:
    """One row of counts, means and medians; missing scores count as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    named = {c: zero(c).alias(c) for c in ("correct_score", "reward", "token_count", "name_penalty")}
    answered = F.coalesce("final_answer", F.lit("")) != ""
    rows = stage(df.select(*named.values(), answered.alias("_answered"), has_repeats(F.col("conversation")).alias("_repeats")), "summary")
    return rows.agg(
        F.count("*").alias("trajectories"),
        F.avg("correct_score").alias("mean_correct_score"),
        F.count_if(F.col("correct_score") == 1.0).alias("fully_correct"),
        F.avg("reward").alias("mean_reward"),
        F.avg("token_count").alias("mean_tokens"),
        F.lit(_median(rows, "token_count")).cast("double").alias("median_tokens"),
        F.count_if("_answered").alias("parsed_answer"),
        F.count_if(F.col("name_penalty") < 0).alias("name_penalized"),
        F.count_if("_repeats").alias("duplicate_trajectory"),
    )


def _median(df: DataFrame, column: str) -> float | None:
    """The median of a staged table's column; None without values."""
    found = exact_quantiles(df, column, {"median": 0.5}).first()
    return None if found is None else found["median"]


def histogram(df: DataFrame, column: str, ordered: bool = False) -> DataFrame:
    """How often each value occurs; ordered: the most frequent first, equals by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column) if ordered else out


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The histogram with each value's place from 0, the most frequent first, equals by value; for many values too."""
    return numbered(histogram(df, column), "n", [column], [], "place", "_values", True).drop("_values")


def lift(df: DataFrame, values: list[str], selected: str = "selected") -> DataFrame:
    """Means of selected and other rows; nulls are skipped."""
    return df.groupBy(selected).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def result_stats(df: DataFrame, sum_tokens: bool = False, first_only: bool = False) -> DataFrame:
    """Macro accuracy and tokens: results with sentinels score nothing but stay in the denominator.

    df has task_id, pos, conversation, token_count and correct_score.
    first_only: a task ends at its first result that is scored (the rule for maths).
    """
    usable = ~(F.array_contains("conversation", "large") | F.array_contains("conversation", "error"))
    rows = df.withColumn("_usable", usable)
    if first_only:
        before = Window.partitionBy("task_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_seen", F.coalesce(F.max(F.col("_usable").cast("int")).over(before), F.lit(0))).where("_seen = 0")
    tokens = F.sum(F.when(F.col("_usable"), F.col("token_count")).otherwise(0))
    per_task = rows.groupBy("task_id").agg(
        (F.sum(F.when(F.col("_usable"), F.col("correct_score")).otherwise(0.0)) / F.count("*")).alias("score"),
        (tokens.cast("double") if sum_tokens else tokens / F.count("*")).alias("tokens"),
    )
    return per_task.agg(F.avg("score").alias("accuracy"), F.avg("tokens").alias("tokens"), F.count("*").alias("tasks"))


def pass_at(df: DataFrame, k: int) -> DataFrame:
    """The mean over tasks of the best score of the first k results."""
    best = df.where(F.col("pos") < k).groupBy("task_id").agg(F.max("correct_score").alias("best"))
    return best.agg(F.avg("best").alias("pass_rate"), F.count("*").alias("tasks"))


def consensus(df: DataFrame, keys: list[str], score_type: str = "exact-match") -> DataFrame:
    """The most given answer of each group, the first given of equals; a missing answer is like no other, not even another missing one.

    Answers are alike by their text (trimmed, lower case), by their first number for "gsm8k", as expressions for "math".
    """
    plain = X.exact_gold(F.col("final_answer"))
    alike = {"exact-match": plain, "gsm8k": X.exact_gold(X.first_number(F.col("final_answer"))), "math": latex.answer_key(plain)}[score_type]
    own = F.when(alike.isNull(), F.col("pos"))
    answers = df.withColumns({"answer_key": alike, "_alone": own}).groupBy(*keys, "answer_key", "_alone").agg(F.count("*").alias("votes"), F.min("pos").alias("first_pos"), F.avg("correct_score").alias("score"), F.sum("token_count").alias("tokens"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "first_pos"))
    return answers.withColumn("_place", first).where("_place = 1").drop("_place", "_alone")


def consistency_curve(df: DataFrame, rounds: int) -> DataFrame:
    """For each k to ``rounds``, over the first k results of every task: pass rate, accuracy of the consensus, and tokens."""
    most = df.withColumn("k", F.explode(F.sequence(F.greatest(F.col("pos") + 1, F.lit(1)).cast("int"), F.greatest(F.col("pos") + 1, F.lit(rounds)).cast("int")))).where(F.col("k") <= rounds)
    passed = most.groupBy("k", "task_id").agg(F.max("correct_score").alias("best"), F.sum("token_count").alias("all_tokens"))
    voted = consensus(most, ["k", "task_id"]).select("k", "task_id", F.col("score").alias("vote_score"))
    return passed.join(voted, ["k", "task_id"]).groupBy("k").agg(F.avg("best").alias("pass_rate"), F.avg("vote_score").alias("consensus_accuracy"), F.avg("all_tokens").alias("tokens"), F.count("*").alias("tasks"))


def token_budget(df: DataFrame, quantile: float = 0.85, by: list[str] | None = None) -> DataFrame:
    """floor of the exact, interpolated quantile of tokens (to six places) plus one; results that ended in error or too large are left out."""
    usable = df.where(~F.col("termination_reason").isin("error", "large"))
    at = exact_quantiles(usable, "token_count", {"_at": quantile}, by)
    return at.select(*(by or []), (F.floor(F.round("_at", 6)) + 1).alias("budget"))


def compare_exact(df: DataFrame) -> DataFrame:
    """Exact matches by the report's normaliser, and those that the reward counts as fully correct, over trajectories."""
    said = X.exact_report(F.col("final_answer")) == X.exact_report(F.col("answer"))
    rows = stage(
        df.select(
            said.alias("_hit"),
            (F.coalesce(F.col("correct_score"), F.lit(0.0)) == 1.0).alias("_full"),
            F.coalesce(F.col("token_count"), F.lit(0)).alias("_tokens"),
            (F.coalesce("final_answer", F.lit("")) != "").alias("_answered"),
        ),
        "compared",
    )
    hit, full, tokens = F.col("_hit"), F.col("_full"), F.col("_tokens")
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("trajectories"),
        F.count_if(hit).alias("raw_exact_correct"),
        share(hit).alias("raw_exact_accuracy"),
        F.count_if(full).alias("reward_qualified_correct"),
        share(full).alias("reward_qualified_accuracy"),
        (F.count_if(hit) - F.count_if(full)).alias("correct_but_format_penalized"),
        F.coalesce(F.avg(tokens), F.lit(0.0)).alias("mean_tokens"),
        F.lit(_median(rows, "_tokens") or 0.0).alias("median_tokens"),
        F.count_if("_answered").alias("parsed_answer"),
    )


def compare_runs(baseline: DataFrame, post: DataFrame) -> DataFrame:
    """Two runs side by side: (metric, baseline, post) for each figure of ``compare_exact`` and each kind of ending."""

    def figures(df: DataFrame, name: str) -> DataFrame:
        one = compare_exact(df)
        long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in one.columns])).alias("x")).select("x.*")
        ends = df.groupBy(F.concat(F.lit("termination "), F.coalesce("termination_reason", F.lit("unknown"))).alias("metric")).agg(F.count("*").cast("double").alias(name))
        return long.unionByName(ends)

    return figures(baseline, "baseline").join(figures(post, "post"), "metric", "full").select("metric", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("post", F.lit(0.0)).alias("post"))


def stage_deltas(summary: DataFrame, stage: str, order: str, values: list[str]) -> DataFrame:
    """Differences, and percentages, of each stage's values from the first stage's."""
    first = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each stage
    out = summary
    for v in values:
        base = F.first(v).over(first)
        out = out.withColumns({f"{v}_delta": F.col(v) - base, f"{v}_percent": F.when(base != 0, 100 * (F.col(v) - base) / base)})
    return out


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Pairs, mean chosen value and mean gap of each speaker."""
    return pairs.groupBy("speaker").agg(F.count("*").alias("pairs"), F.avg("chosen_value").alias("mean_value"), F.avg("distance").alias("mean_gap"))
