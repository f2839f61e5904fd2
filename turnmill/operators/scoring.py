"""Scores of trajectories: correctness, length, fluency, format, and their sum."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import chat, latex
from turnmill.functions import text as X
from turnmill.shipping import ship
from turnmill.types import Settings

DEFAULTS = Settings()


def is_mixed(sentence: Column) -> Column:
    """Whether an utterance names both speakers, or one of them twice."""
    alice, bob = (F.regexp_count(sentence, F.lit(f"{n}:")) for n in ("Alice", "Bob"))
    return ((alice > 0) & (bob > 0)) | (alice > 1) | (bob > 1)


def format_offence(conversation: Column, check_names: bool = True, mode: str = "current") -> Column:
    """The first offence of a conversation, "name" or "duplicate", or null; in one utterance the name counts.

    mode "legacy": names are no offence, and speakers are stripped as sets of characters.
    """
    if mode == "legacy":
        check_names = False
        plain = F.transform(conversation, lambda s: F.lower(X.strip_speaker_legacy(X.trimmed(s))))
    else:
        plain = F.transform(conversation, X.strip_speaker if check_names else X.exact_gold)
    kind = F.transform(
        conversation,
        lambda s, k: F.when(is_mixed(s) & F.lit(check_names), F.lit("name")).when(F.array_position(plain, F.get(plain, k)) <= k, F.lit("duplicate")),
    )
    return F.get(F.filter(kind, lambda x: x.isNotNull()), F.lit(0))


def name_penalty(conversation: Column, enabled: bool = True, penalty: float = DEFAULTS.name_penalty) -> Column:
    """One penalty if any utterance mixes or repeats names."""
    return F.when(F.lit(enabled) & F.exists(conversation, is_mixed), F.lit(penalty)).otherwise(F.lit(0.0))


def correct_score(answers: Column, is_list: Column, final: Column, score_type: Column, math_equal: Column | None = None, maths: bool = True) -> Column:
    """Best F1 over gold answers, equivalence in maths, or exact match; a list is matched without stripping backslashes.

    math_equal: another comparison than that of canonical expressions.  A missing final answer is an empty one.
    maths: False leaves the comparison, which is Python, out of the plan; a maths row is an error then.
    """
    one, final = F.get(answers, F.lit(0)), F.coalesce(final, F.lit(""))
    f1 = F.array_max(F.transform(answers, lambda a: X.token_f1(a, final)))
    exact = F.when(is_list, F.array_contains(F.transform(answers, X.exact_gold), X.exact_gold(final))).otherwise(X.exact_gold(one) == X.exact_prediction(final))
    is_maths = ~is_list & (score_type == "math")
    if math_equal is not None:
        same = math_equal
    elif maths:
        same = latex.maths_equal(F.when(is_maths, X.exact_gold(one)), F.when(is_maths, X.exact_gold(final)))
    else:
        same = F.raise_error(F.lit("an answer in maths, but maths=False")).cast("boolean")
    exact = F.when(is_maths, same).otherwise(exact)
    return F.coalesce(F.when(score_type == "f1-score", f1).otherwise(exact.cast("double")), F.lit(0.0))


def score(df: DataFrame, lambda1: float = DEFAULTS.lambda1, lambda2: float = DEFAULTS.lambda2, cal_ppl: bool = True, check_names: bool = True, token_cap: float | None = None, long_tokens: int = DEFAULTS.long_tokens, math_equal: Column | None = None, mode: str = "current", maths: bool = True) -> DataFrame:
    """Add correct_score, token_score, ppl_score and reward.

    df has task_id, conversation, token_count, losses, answers, answer_is_list,
    final_answer and score_type.  token_cap replaces the most tokens of the task.
    mode "legacy" takes the older format rule, and a task all of whose conversations are too large is an
    error; the oldest local scorer's cutoff is long_tokens=500.
    maths=False keeps the plan free of Python where no row is scored as maths.
    """
    is_large = F.array_contains("conversation", "large")
    none = F.raise_error(F.concat(F.lit("all conversations are too large in task "), F.coalesce(F.col("task_id").cast("string"), F.lit("null")))).cast("int") if mode == "legacy" else F.lit(1)
    most = F.lit(float(token_cap)) if token_cap is not None else F.coalesce(F.max(F.when(~is_large, F.col("token_count"))).over(Window.partitionBy("task_id")), none).cast("double")
    said = F.filter("conversation", lambda s: s != "large")
    offence = format_offence(said, check_names, mode)
    judged = F.lit(cal_ppl) & (F.col("token_count") <= long_tokens) & (F.size(said) > 0)
    out = df.withColumns({"_most": most, "_offence": F.when(judged, offence), "_judged": judged})
    token = F.when(is_large | (F.col("token_count") <= DEFAULTS.short_tokens), F.lit(-1.0)).otherwise(F.when(F.col("_most") == 0, F.lit(0.0)).otherwise(F.lit(lambda1) * F.col("token_count") / F.nullif(F.col("_most"), F.lit(0.0))))
    ppl = F.when(~F.lit(cal_ppl), F.lit(0.0)).when(~F.col("_judged"), F.lit(-1.0)).when(F.col("_offence").isNotNull(), F.lit(0.0)).otherwise(F.lit(lambda2) / F.coalesce(F.array_max("losses"), F.lit(1.0)))
    correct = F.when(F.col("_offence") == "name", F.lit(0.0)).otherwise(correct_score(F.col("answers"), F.col("answer_is_list"), F.col("final_answer"), F.col("score_type"), math_equal, maths))
    out = out.withColumns({"correct_score": correct, "token_score": token, "ppl_score": ppl}).drop("_most", "_offence", "_judged")
    return out.withColumn("reward", F.col("correct_score") + F.col("token_score") + F.col("ppl_score"))


def search_reward(df: DataFrame, budget: float, **settings) -> DataFrame:
    """Scores of rollouts within a search: the token budget stands for the task's most tokens, and names cost nothing more."""
    return score(df, token_cap=budget, **settings).withColumns({"name_penalty": F.lit(0.0), "effective_reward": F.col("reward")})


#: What gives a mean loss for each of some framed utterances; the model behind it is the user's own.
LossProvider = Callable[[list[str]], list[float]]


def with_losses(df: DataFrame, provider: LossProvider, merge_system: bool = False, batch: int = 16) -> DataFrame:
    """Add losses, one for each utterance of conversation that is no sentinel "large", framed as a model's own turn.

    provider is called on the workers with at most ``batch`` texts, and must be picklable.
    """
    said = F.filter("conversation", lambda s: s != "large")
    framed = F.transform(said, lambda s: chat.frame_for_loss(s, merge_system))

    @F.pandas_udf("array<double>")
    def losses(rows: pd.Series) -> pd.Series:
        texts = [t for row in rows for t in row]
        found = [float(x) for k in range(0, len(texts), batch) for x in provider(texts[k : k + batch])]
        if len(found) != len(texts):
            raise ValueError("a loss provider must return a loss for each text")
        ends = np.cumsum([len(row) for row in rows])
        return pd.Series([found[b - len(row) : b] for row, b in zip(rows, ends, strict=True)])

    ship(df.sparkSession)
    return df.withColumn("losses", losses(framed))


def effective_reward(reward: Column, penalty: Column) -> Column:
    return F.coalesce(reward, F.lit(0.0)) + F.coalesce(penalty, F.lit(0.0))


def perplexity_reward(logprobs: Column) -> Column:
    """exp of the mean negative log probability; null without any."""
    return F.exp(-F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(logprobs), F.lit(0)))


def perplexity_score(sentences: Column, lambda2: float = DEFAULTS.lambda2) -> Column:
    """The oldest fluency term: lambda2 over the highest perplexity of some sentences, each the log probabilities of its tokens.

    A sentence's first token has none and is left out; sentences of one token do not count, and without others the term is null.
    """
    each = F.transform(sentences, lambda s: perplexity_reward(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))))
    return F.lit(float(lambda2)) / F.array_max(each)


def mean_loss(losses: Column, mode: str = "current") -> Column:
    """The mean of the losses of a text's tokens, the first token aside, over those that are not 0 (padding); null if all are.

    mode "legacy": the first four of them do not count.
    """
    kept = F.slice(losses, F.lit(5), F.greatest(F.size(losses) - 4, F.lit(0))) if mode == "legacy" else losses
    told = F.filter(kept, lambda x: x != 0)
    return F.aggregate(told, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(told), F.lit(0))


def legacy_clean(conversation: Column, penalty: float = DEFAULTS.name_penalty) -> Column:
    """The older cleaning: a penalty for each utterance that repeats a name, and an end after one that mixes them."""
    def step(state: Column, s: Column) -> Column:
        alice, bob = (F.regexp_count(s, F.lit(f"{n}:")) for n in ("Alice", "Bob"))
        mixed = (alice > 0) & (bob > 0)
        more = F.when(state["over"], F.lit(0.0)).when(mixed | (alice > 1) | (bob > 1), F.lit(penalty)).otherwise(F.lit(0.0))
        return F.struct((state["sum"] + more).alias("sum"), (state["over"] | mixed).alias("over"))

    return F.aggregate(conversation, F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("over")), step, lambda s: s["sum"])


def agreement(turns: DataFrame, keys: list[str], mode: str = "current") -> DataFrame:
    """Of turns (keys, pos, speaker, parsed_answer): where another speaker first confirms the last answer, and the final answer.

    mode "legacy": whoever gives the last answer again confirms it.
    """
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col("parsed_answer") != "", F.col("parsed_answer"))
    last = F.last(given, ignorenulls=True).over(before)
    by = F.last(F.when(given.isNotNull(), F.col("speaker")), ignorenulls=True).over(before)
    marked = turns.withColumn("_agreed", F.coalesce((given == last) & (F.lit(mode == "legacy") | (F.col("speaker") != by)), F.lit(False)))
    out = marked.groupBy(*keys).agg(
        F.min(F.when(F.col("_agreed"), F.col("pos"))).alias("agreed_pos"),
        F.min(F.when(F.col("_agreed"), F.struct("pos", "parsed_answer"))).alias("_at"),
        F.max(F.when(given.isNotNull(), F.struct("pos", "parsed_answer"))).alias("_last"),
    )
    return out.select(*keys, "agreed_pos", F.coalesce(F.col("_at.parsed_answer"), F.col("_last.parsed_answer")).alias("final_answer"))
