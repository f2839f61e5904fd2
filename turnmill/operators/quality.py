"""Quality checks as a table (check, status, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import chat
from turnmill.functions import text as X

from .scoring import is_mixed


def at_least(value: Column, good: float, fair: float | None = None) -> Column:
    status = F.when(value >= good, "PASS")
    return status.when(value >= fair, "WARN").otherwise("FAIL") if fair is not None else status.otherwise("FAIL")


def at_most(value: Column, good: float, fair: float | None = None, worst: str = "FAIL") -> Column:
    status = F.when(value <= good, "PASS")
    return status.when(value <= fair, "WARN").otherwise(worst) if fair is not None else status.otherwise(worst)


def _rows(one: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """checks: of each name, its value and status, over one row of aggregates."""
    array = F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value")) for name, (value, status) in checks.items()])
    return one.select(F.explode(array).alias("x")).select("x.*")


def trajectory_checks(df: DataFrame, tasks: int, per_task: int) -> DataFrame:
    """Counts and terminations of trajectories (task_id, termination_reason, final_answer)."""
    sizes = df.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("termination_reason") == "error").alias("error"), F.count_if(F.col("termination_reason") == "large").alias("large"), F.count_if(F.col("termination_reason") == "agreement").alias("agreement"), F.count_if(F.coalesce("final_answer", F.lit("")) != "").alias("answered"))
    one = sizes.agg(F.count("*").alias("tasks"), F.count_if(F.col("n") != per_task).alias("odd"), F.min("task_id").alias("low"), F.max("task_id").alias("high"), *[(F.sum(c) / F.sum("n")).alias(c) for c in ("error", "large", "agreement", "answered")])
    ids = (F.col("low") != 0) | (F.col("high") != F.col("tasks") - 1)
    checks = {
        "task_count": (F.col("tasks"), F.when(F.col("tasks") == tasks, "PASS").otherwise("FAIL")),
        "results_per_task": (F.col("odd"), F.when(F.col("odd") == 0, "PASS").otherwise("FAIL")),
        "task_ids": (ids.cast("double"), F.when(ids, "FAIL").otherwise("PASS")),
        "answer_rate": (F.col("answered"), at_least(F.col("answered"), 0.9, 0.5)),
        "error_rate": (F.col("error"), at_most(F.col("error"), 0.0, 0.05)),
        "large_rate": (F.col("large"), at_most(F.col("large"), 0.0, 0.2, "FAIL")),
        "agreement_rate": (F.col("agreement"), F.when(F.col("agreement") >= 0.5, "PASS").otherwise("WARN")),
    }
    return _rows(one, checks)


def independence_checks(df: DataFrame) -> DataFrame:
    """Whether the speakers of trajectories (system_first, system_second, context_first, context_second, turns) are apart, and take turns from Alice on."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    by = F.transform("turns", lambda t: t["speaker"])
    turn = F.transform("turns", lambda t, k: F.when(k % 2 == 0, F.lit("Alice")).otherwise(F.lit("Bob")))
    none = lambda c, worst: (F.col(c), F.when(F.col(c) == 0, "PASS").otherwise(worst))
    one = df.agg(
        F.count_if((F.coalesce("system_first", F.lit("")) != "") & F.col("system_first").eqNullSafe(F.col("system_second"))).alias("system"),
        F.count_if(~empty("context_first") & F.col("context_first").eqNullSafe(F.col("context_second"))).alias("context"),
        F.count_if(empty("context_first") & empty("context_second")).alias("empty"),
        F.count_if(~by.eqNullSafe(turn)).alias("turns"),
        F.count_if((F.size("turns") > 0) & ~F.get(by, F.lit(0)).eqNullSafe(F.lit("Alice"))).alias("first"),
    )
    checks = {"same_system": none("system", "FAIL"), "same_context": none("context", "FAIL"), "empty_context": none("empty", "INFO"), "alternation": none("turns", "FAIL"), "alice_first": none("first", "WARN")}
    return _rows(one, checks)


def conversation_checks(df: DataFrame, name_prefix: bool = True) -> DataFrame:
    """Trajectories (conversation) with an utterance that mixes names, and with one that repeats another; each counts once."""
    plain = F.filter(F.transform("conversation", lambda s: F.lower(X.strip_speaker_bold(s))), lambda s: s != "")
    one = df.agg(F.count_if(F.exists("conversation", is_mixed)).alias("mixed"), F.avg((F.size(F.array_distinct(plain)) < F.size(plain)).cast("double")).alias("repeat"))
    mixed = F.when((F.col("mixed") == 0) | F.lit(not name_prefix), "PASS").otherwise("WARN")
    return _rows(one, {"name_mixing": (F.col("mixed"), mixed), "duplicate_rate": (F.col("repeat"), at_most(F.col("repeat"), 0.0, 0.05))})


def turn_checks(turns: DataFrame, name_prefix: bool = True) -> DataFrame:
    """Prefixes, blanks, odd characters and cut ends of turns (speaker, content, finish_reason)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    prefixed = F.regexp_like(F.coalesce("content", F.lit("")), F.concat(F.lit(r"^\s*\**\s*"), F.coalesce("speaker", F.lit("")), F.lit(r"\s*:")))
    one = turns.agg(
        share(prefixed).alias("prefix"),
        F.count_if(X.trimmed(F.coalesce("content", F.lit(""))) == "").alias("blank"),
        F.count_if(X.is_mojibake(F.col("content"))).alias("mojibake"),
        F.count_if(F.col("finish_reason") == "length").alias("cut"),
    )
    none = lambda c, worst: F.when(F.col(c) == 0, "PASS").otherwise(worst)
    prefix = at_least(F.col("prefix"), 0.99, 0.9) if name_prefix else F.when(F.col("prefix").isNotNull(), "PASS").otherwise("FAIL")
    checks = {
        "name_prefix_rate": (F.col("prefix"), prefix),
        "blank_turns": (F.col("blank"), none("blank", "FAIL")),
        "mojibake_turns": (F.col("mojibake"), none("mojibake", "WARN")),
        "truncated_turns": (F.col("cut"), none("cut", "WARN")),
    }
    return _rows(one, checks)


def selection_checks(df: DataFrame, epsilon: float) -> DataFrame:
    """Lift and order of selected rows (selected, rank, reward, correct_score); a group without values has mean 0."""
    mean = lambda c, on: F.coalesce(F.avg(F.when(F.col("selected") == on, F.col(c))), F.lit(0.0))
    ranked = df.where("selected and rank is not null")
    # Ranks are dealt to buckets by tens of thousands; a bucket's first row is held against the last of the one before.
    bucket = F.floor(F.col("rank") / 10_000)
    rises = ranked.withColumn("_up", F.col("reward") > F.lag("reward").over(Window.partitionBy(bucket).orderBy("rank")))
    edges = rises.groupBy(bucket.alias("bucket")).agg(F.count_if("_up").alias("rises"), F.min_by("reward", "rank").alias("first"), F.max_by("reward", "rank").alias("last"))
    over = F.coalesce(F.col("first") > F.lag("last").over(Window.orderBy("bucket")), F.lit(False))  # a row for each bucket
    order = edges.withColumn("_over", over).agg((F.coalesce(F.sum("rises"), F.lit(0)) + F.count_if("_over")).alias("rises"))
    one = df.agg(F.count_if("selected").alias("chosen"), (mean("reward", True) - mean("reward", False)).alias("lift"), (mean("correct_score", True) - mean("correct_score", False)).alias("correct"), F.count_if(F.col("selected") & (F.col("reward") < epsilon)).alias("below"))
    checks = {
        "selected_count": (F.col("chosen"), F.when(F.col("chosen") > 0, "PASS").otherwise("FAIL")),
        "reward_lift": (F.col("lift"), F.when(F.col("lift") > 0, "PASS").otherwise("FAIL")),
        "correctness_lift": (F.col("correct"), F.when(F.col("correct") > 0, "PASS").otherwise("WARN")),
        "threshold": (F.col("below"), F.when(F.col("below") == 0, "PASS").otherwise("FAIL")),
    }
    return _rows(one, checks).unionByName(_rows(order, {"rank_order": (F.col("rises"), F.when(F.col("rises") == 0, "PASS").otherwise("FAIL"))}))


def source_rows(rows: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Training rows (task_id, trajectory_id, text) with the turns and system prompts that they were made of."""
    return rows.join(trajectories.select("task_id", "trajectory_id", "turns", "system_first", "system_second"), ["task_id", "trajectory_id"])


def routing_checks(rows: DataFrame, trajectories: DataFrame, merged_system: bool = False, read=chat.read_tagged) -> DataFrame:
    """Whether training rows (task_id, trajectory_id, speaker, text) give own turns as assistant, the partner's as user, and the recorded system prompt.

    merged_system: the prompt begins the first user message, alone or with the partner's first turn behind it.
    """
    strip = lambda xs: F.transform(xs, X.trimmed)
    met = source_rows(rows, trajectories).withColumn("_m", read(F.col("text")))
    of = lambda role: strip(F.transform(F.filter("_m", lambda m: m["role"] == role), lambda m: m["content"]))
    said = lambda who: strip(F.transform(F.filter("turns", lambda t: t["speaker"] == who), lambda t: t["content"]))
    partner = F.when(F.col("speaker") == "Alice", "Bob").otherwise("Alice")
    system = X.trimmed(F.coalesce(F.when(F.col("speaker") == "Alice", F.col("system_first")).otherwise(F.col("system_second")), F.lit("")))
    met = met.select(F.get("_m", F.lit(0)).alias("first"), of("assistant").alias("assistant"), of("user").alias("user"), said(F.col("speaker")).alias("own"), said(partner).alias("other"), system.alias("system"))
    begins = F.get("user", F.lit(0))
    if merged_system:
        rest = X.trimmed(F.substring(begins, F.length("system") + 1, F.length(begins)))
        after = F.slice("user", F.lit(2), F.greatest(F.size("user") - 1, F.lit(0)))
        later = F.slice("other", F.lit(2), F.greatest(F.size("other") - 1, F.lit(0)))
        users = F.startswith(begins, F.col("system")) & F.when(rest == "", after == F.col("other")).otherwise((rest == F.get("other", F.lit(0))) & (after == later))
        good = (F.col("first.role") == "user") & users
    else:
        good = (F.col("first.role") == "system") & (X.trimmed(F.col("first.content")) == F.col("system")) & (F.col("user") == F.col("other"))
    wrong = ~F.coalesce((F.col("assistant") == F.col("own")) & good, F.lit(False))
    one = met.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))
    return _rows(one, {"role_routing": (F.col("wrong"), F.when(F.col("n") == 0, "WARN").when(F.col("wrong") == 0, "PASS").otherwise("FAIL"))})


def fields_present(df: DataFrame, fields: list[str]) -> DataFrame:
    """Whether the columns are there; they may be null."""
    found = [(f"field_{f}", "PASS" if f in df.columns else "FAIL", float(f in df.columns)) for f in fields]
    return df.sparkSession.createDataFrame(found, "check string, status string, value double")


def field_checks(lines: DataFrame, fields: list[str]) -> DataFrame:
    """How many results of raw task lines (value) lack each field; one that is there may be null.  Lines that are no JSON are passed over."""
    raw = F.from_json("value", "results array<string>")["results"]
    keys = lines.select(F.explode(raw).alias("r")).select(F.json_object_keys("r").alias("keys")).where("keys is not null")
    one = keys.agg(*[F.count_if(~F.array_contains("keys", f)).alias(f"_{k}") for k, f in enumerate(fields)])
    return _rows(one, {f"field_{f}": (F.col(f"_{k}"), F.when(F.col(f"_{k}") == 0, "PASS").otherwise("FAIL")) for k, f in enumerate(fields)})


def pair_checks(pairs: DataFrame, min_value: float, min_gap: float) -> DataFrame:
    """How many pairs and states there are, and whether every pair passes both strict thresholds."""
    bad = (F.col("chosen_value") <= min_value) | (F.col("distance") <= min_gap)
    one = pairs.agg(F.count("*").alias("n"), F.count_distinct("task_id", "state_id").alias("states"), F.count_if(bad).alias("bad"))
    return _rows(one, {"state_count": (F.col("states"), F.when(F.col("states") > 0, "PASS").otherwise("WARN")), "pair_count": (F.col("n"), F.when(F.col("n") > 0, "PASS").otherwise("WARN")), "pair_thresholds": (F.col("bad"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"))})


def failed(*checks: DataFrame) -> bool:
    """Whether any check failed."""
    return not reduce(DataFrame.unionByName, checks).where("status = 'FAIL'").isEmpty()
