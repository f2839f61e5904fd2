"""Training sets made of trajectories, states, pairs and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import chat
from turnmill.functions import text as X
from turnmill.staging import stage
from turnmill.types import Settings

from .compose import both_speakers
from .pairs import argmax_argmin
from .scoring import effective_reward, name_penalty, score
from .selection import select_by_dataset, split_in_order, split_rows

DEFAULTS = Settings()
Render = Callable[..., Column]


def within(df: DataFrame, text: str, limit: int, strict: bool = False, tokenizer: X.Tokenizer = X.tokens) -> DataFrame:
    """Rows whose text has at most ``limit`` tokens; strict: fewer than that."""
    n = X.token_count(F.col(text), tokenizer)
    return df.where(n < limit if strict else n <= limit)


def _system(speaker: Column) -> Column:
    return F.coalesce(F.when(speaker == "Alice", F.col("system_first")).otherwise(F.col("system_second")), F.lit(""))


def sft_rows(trajectories: DataFrame, merge_system: bool = False, max_tokens: int | None = None, tokenizer: X.Tokenizer = X.tokens) -> DataFrame:
    """Each trajectory as a text for each speaker that has turns in it: own turns as assistant, all others as user, behind the recorded system prompt."""
    each = both_speakers(trajectories).where(F.exists("turns", lambda t: t["speaker"].eqNullSafe(F.col("speaker"))))
    messages = chat.adapt(chat.own_turns(_system(F.col("speaker")), F.col("turns"), F.col("speaker")), merge_system)
    out = each.select("speaker", chat.render(messages).alias("text"), "task_id", "trajectory_id", "reward", "correct_score")
    return out if max_tokens is None else within(out, "text", max_tokens, tokenizer=tokenizer)


def speaker_datasets(trajectories: DataFrame, seed: int = DEFAULTS.seed, iteration: int = 0, train_share: float = DEFAULTS.sft_train_share, **settings) -> DataFrame:
    """The texts of ``sft_rows``, split into train and test for each speaker in md5 order; write them with ``write_splits(df, path, ("speaker", "split"))``."""
    keyed = sft_rows(trajectories, **settings).withColumn("_key", F.concat_ws(":", "speaker", "task_id", "trajectory_id"))
    return split_rows(keyed, f"{seed}:{iteration}:sft-split", "_key", train_share, partition=["speaker"]).drop("_key")


def pair_rows(pairs: DataFrame, merge_system: bool = False) -> DataFrame:
    """Pairs (speaker, system_first, system_second, prefix_turns, chosen, rejected and values) as prompt and completions."""
    messages = chat.adapt(chat.own_turns(_system(F.col("speaker")), F.coalesce("prefix_turns", F.array()), F.col("speaker")), merge_system)
    asked = pairs.withColumns({"_m": messages}).withColumn("prompt", chat.render(F.col("_m"), ask=True))

    def completion(text: str) -> Column:
        full = chat.render(F.concat("_m", F.array(chat.message("assistant", F.col(text)))))
        return chat.completion_text(full, F.col("prompt"), F.col(text)).alias(text)

    return asked.select("speaker", "prompt", completion("chosen"), completion("rejected"), "task_id", "state_id", "chosen_value", "rejected_value", "distance")


def pair_datasets(pairs: DataFrame, train_share: float = DEFAULTS.pair_train_share, **settings) -> DataFrame:
    """The rows of ``pair_rows`` with their split for each speaker: in order of task and state, the first share is train, one row at least."""
    return split_in_order(pair_rows(pairs, **settings), "task_id", ["state_id"], train_share, 1, ["speaker"])


def branches_of(states: DataFrame) -> DataFrame:
    """A row for each branch of states (task_id, state_id, speaker, prefix_turns, branches)."""
    each = states.select("task_id", "state_id", "speaker", "prefix_turns", F.explode("branches").alias("_b"))
    kept = [c for c in states.schema["branches"].dataType.elementType.names if c not in each.columns]
    return each.select("task_id", "state_id", "speaker", "prefix_turns", *[F.col(f"_b.{c}").alias(c) for c in kept])


def score_branches(branches: DataFrame, penalise_names: bool = True, **settings) -> DataFrame:
    """Scores of branches; the most tokens are those of all states of a task, not of each state."""
    out = score(branches, check_names=penalise_names, **settings)
    out = out.withColumn("name_penalty", name_penalty(F.col("conversation"), penalise_names))
    return out.withColumn("effective_reward", effective_reward(F.col("reward"), F.col("name_penalty")))


def nest_states(branches: DataFrame) -> DataFrame:
    """Branches back in their states, in order of branch_id."""
    keys = ["task_id", "state_id", "speaker"]
    own = F.struct("branch_id", *[c for c in branches.columns if c not in (*keys, "prefix_turns", "branch_id")])
    ordered = F.array_sort(F.collect_list(own), lambda a, b: F.when(a["branch_id"] < b["branch_id"], -1).when(a["branch_id"] > b["branch_id"], 1).otherwise(0))
    return branches.groupBy(*keys).agg(F.first("prefix_turns").alias("prefix_turns"), ordered.alias("branches"))


def anchor_turns(branches: DataFrame, keys: list[str]) -> DataFrame:
    """The first turn of the first branch, by branch_id, that has one which is no error; groups without any are left out."""
    usable = branches.where(F.size("turns") > 0).withColumn("anchor", F.get("turns", F.lit(0))).where(~F.coalesce("anchor.content", F.lit("")).eqNullSafe("error"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("branch_id"))
    return usable.withColumn("_place", first).where("_place = 1").select(*keys, "anchor")


def _prompts(template: Column, second: Column, speaker: Column) -> Column:
    partner = F.when(speaker == "Alice", "Bob").otherwise("Alice")
    own = F.when(speaker == "Alice", F.col("information_first")).otherwise(F.col("information_second"))
    return X.fill_template(F.when(speaker == "Alice", template).otherwise(second), name=speaker, partner=partner, question=F.col("question"), information=own)


def legacy_pair_rows(results: DataFrame, template: str, train_share: float = DEFAULTS.pair_train_share) -> DataFrame:
    """The older pairs: each task's best and worst conversation, once with each speaker's prompt, split in order of tasks.

    results has task_id, trajectory_id, reward, question, information_first, information_second and conversation.
    """
    ids = argmax_argmin(results)
    own = ["question", "information_first", "information_second", "conversation"]
    best = results.select("task_id", F.col("trajectory_id").alias("chosen_id"), *own)
    worst = results.select("task_id", F.col("trajectory_id").alias("rejected_id"), F.col("conversation").alias("_worse"))
    both = both_speakers(ids.join(best, ["task_id", "chosen_id"]).join(worst, ["task_id", "rejected_id"]))
    prompt = _prompts(F.lit(template), F.lit(template), F.col("speaker"))
    rows = both.select("task_id", "speaker", prompt.alias("prompt"), chat.as_conversation(F.col("conversation")).alias("chosen"), chat.as_conversation(F.col("_worse")).alias("rejected"))
    return split_in_order(rows, "task_id", ["speaker"], train_share)


def legacy_sft_rows(results: DataFrame, template_first: str, template_second: str, epsilon: float = DEFAULTS.epsilon, seed: str = "42", train_share: float = DEFAULTS.sft_train_share) -> DataFrame:
    """The older rows: the trajectories that ``select_by_dataset`` leaves, once with each speaker's prompt, every utterance the assistant's; split in md5 order."""
    each = both_speakers(select_by_dataset(results, epsilon=epsilon))
    system = F.array(chat.message("system", _prompts(F.lit(template_first), F.lit(template_second), F.col("speaker"))))
    said = F.transform("conversation", lambda s: chat.message("assistant", s))
    rows = each.select("task_id", "speaker", "dataset_name", "reward", F.concat(system, said).alias("messages"), F.concat_ws(":", "task_id", "speaker").alias("_key"))
    return split_rows(rows, seed, "_key", train_share).drop("_key")


def chat_pairs(lines: DataFrame, train_share: float = DEFAULTS.pair_train_share) -> DataFrame:
    """Lines (task_id, dpo_results of chosen and rejected utterances) as pairs of messages, split in order of lines."""
    each = lines.select("task_id", F.posexplode("dpo_results").alias("pair_no", "_p"))
    rows = each.select("task_id", "pair_no", chat.as_conversation(F.col("_p.chosen")).alias("chosen"), chat.as_conversation(F.col("_p.rejected")).alias("rejected"))
    return split_in_order(rows, "task_id", ["pair_no"], train_share)


def chat_task(df: DataFrame, task: str, insert_system: bool = True, bos: str | None = None) -> DataFrame:
    """Format messages for a training task: sft and generation (messages), rm (chosen, rejected), dpo and orpo (chosen, rejected, and prompt or not).

    Adds text, or text_prompt, text_chosen and text_rejected.  insert_system puts
    an empty system message in front where there is none.
    """
    ready = chat.with_system if insert_system else lambda m: m
    if task in ("sft", "generation"):
        return df.withColumn("text", chat.render(ready(F.col("messages")), ask=task == "generation"))
    if task not in ("rm", "dpo", "orpo"):
        raise ValueError(f"task {task} is none of sft, generation, rm, dpo, orpo")
    if not {"chosen", "rejected"} <= set(df.columns):
        raise ValueError(f"task {task} needs the columns chosen and rejected")
    if task == "rm":
        return df.withColumns({f"text_{c}": chat.render(ready(F.col(c))) for c in ("chosen", "rejected")})
    is_chat = [f for c in ("chosen", "rejected") for f in (df.schema[c].dataType.simpleString(),) if not f.startswith("array<struct<")]
    if is_chat:
        raise ValueError(f"task {task} needs messages of role and content")
    has_prompt = "prompt" in df.columns and df.schema["prompt"].dataType.simpleString().startswith("array<struct<")
    prompt = F.col("prompt") if has_prompt else chat.prompt_part(F.col("chosen"))
    answer = lambda c: chat.render(F.col(c) if has_prompt else chat.completion_part(F.col(c)))
    plain = lambda text: F.when(F.startswith(text, F.lit(bos)), F.substring(text, F.lit(len(bos) + 1), F.length(text))).otherwise(text) if bos else text
    return df.withColumns({"text_prompt": chat.render(ready(prompt)), **{f"text_{c}": plain(answer(c)) for c in ("chosen", "rejected")}})


def node_prefixes(edges: DataFrame, max_depth: int | None = None, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Nodes of trees (keys, node_id, parent_id, depth, content and others) with prefix: the contents from below the root to the node.

    Each node knows the contents up to one above it, at first its parent, and
    takes over what that one knows, so that a round doubles the way: there are as
    many joins as the greatest depth has binary digits.  Only ids and contents
    take part in the rounds.  Nodes below ``max_depth`` are left out, as
    are those whose way to the root is broken.
    """
    at = [*keys, "node_id"]
    kept = edges if max_depth is None else edges.where(F.col("depth") <= max_depth)
    is_root = F.col("parent_id").isNull()
    none = F.array().cast("array<string>")
    way = stage(kept.where(is_root | (F.col("depth") > 0)).select(*at, F.col("parent_id").alias("_jump"), F.when(is_root, none).otherwise(F.array("content")).alias("prefix"), F.when(is_root, 0).otherwise(F.col("depth")).alias("_depth")), "ways")
    while way.where(_is_open()).limit(1).count():
        above = way.select(*keys, F.col("node_id").alias("_jump"), F.col("_jump").alias("_next"), F.col("prefix").alias("_above"))
        longer = way.where(_is_open()).join(above, [*keys, "_jump"]).select(*at, F.col("_next").alias("_jump"), F.concat("_above", "prefix").alias("prefix"), "_depth")
        way = stage(way.where(~_is_open()).unionByName(longer), "ways")
    top, below = way.where("_depth = 0"), way.where("_depth > 0 and size(prefix) = _depth")
    roots = top.select(*keys, F.col("node_id").alias("_jump"))
    whole = top.unionByName(below.join(roots, [*keys, "_jump"], "left_semi"))
    return kept.join(whole.select(*at, "prefix"), at).select(*edges.columns, "prefix")


def _is_open() -> Column:
    """Whether a way does not reach the root yet."""
    return F.size("prefix") < F.col("_depth")


def tree_records(edges: DataFrame, prompts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The older record of a tree: of each child of a node with children, the conversation from the root's prompt on, and its value.

    prompts has task_id, and a prompt for each speaker (prompt_first, prompt_second): the one whose turn it is at the child's depth.
    """
    nodes = node_prefixes(edges, max_depth).where("parent_id is not null").join(prompts, "task_id")
    prompt = F.when(F.col("depth") % 2 == 0, F.col("prompt_first")).otherwise(F.col("prompt_second"))
    return nodes.select("task_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), F.concat(F.array(prompt), "prefix").alias("conversation"), "value")


def legacy_tree_pairs(edges: DataFrame, pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """The older pairs of a tree, not told apart by speaker: whole conversations from the prompt to the better and the worse child.

    pairs are those of ``tree_pairs`` over the edges; prompts as in ``tree_records``, by the depth of the state.
    """
    ways = node_prefixes(edges).select("task_id", F.col("node_id").alias("state_id"), F.col("depth").alias("_depth"), "prefix")
    rows = pairs.join(ways, ["task_id", "state_id"]).join(prompts, "task_id")
    prompt = F.when(F.col("_depth") % 2 == 0, F.col("prompt_first")).otherwise(F.col("prompt_second"))
    told = lambda c: F.concat(F.array(prompt), F.col("prefix"), F.array(c)).alias(c)
    return rows.select("task_id", "state_id", told("chosen"), told("rejected"), "chosen_value", "distance")


def root_pair(edges: DataFrame, min_value: float = DEFAULTS.min_value, min_gap: float = DEFAULTS.min_gap) -> DataFrame:
    """The pair of a root's best and worst child, if it passes both strict thresholds (the older format pair)."""
    from .pairs import extremes

    roots = edges.where("parent_id is null").select("task_id", F.col("node_id").alias("parent_id"))
    children = edges.join(roots, ["task_id", "parent_id"]).select("task_id", "parent_id", F.col("content").alias("candidate"), "value", "seq")
    return extremes(children, ["task_id", "parent_id"], min_value, min_gap).drop("parent_id")
