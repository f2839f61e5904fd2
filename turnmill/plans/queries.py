"""Queries over the test tables, one for each operator or family, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnmill.functions import chat, latex
from turnmill.functions import text as X
from turnmill.operators import analysis, builders, compose, pairs, quality, replay, scoring, selection
from turnmill.sources import datasets, tasks
from turnmill.staging import shared_dir, stage
from turnmill.streaming import scoring as incremental
from turnmill.types import Settings

from . import fixture
from .fixture import table
from .register import ORACLES, QUERIES, query

S = Settings()


def _r(c, digits: int = 9):
    return F.round(c, digits)


# Scoring and selection


@query("SELECT conv_id, CAST(task_id AS BIGINT) AS task_id, correct_score, round(token_score, 9) AS token_score, round(ppl_score, 9) AS ppl_score, round(reward, 9) AS reward FROM scored", derived=True)
def score_trajectories(spark, sf):
    return fixture.scored(spark, sf).select("conv_id", "task_id", "correct_score", *[_r(c).alias(c) for c in ("token_score", "ppl_score", "reward")])


def _selected(spark, sf):
    return selection.select_trajectories(fixture.scored(spark, sf))


@query("SELECT conv_id, task_id, round(effective_reward, 9) AS effective_reward, rank FROM chosen", derived=True)
def select_top_window(spark, sf):
    return _selected(spark, sf).select("conv_id", "task_id", _r("effective_reward").alias("effective_reward"), F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id, pos, CASE WHEN content LIKE '%<A>%</A%' THEN list_last(regexp_extract_all(content, '<A>(.*?)</A', 1)) END AS answer FROM turns", derived=True)
def parse_tag_answer(spark, sf):
    return fixture.turns(spark, sf).select("conv_id", F.col("pos").cast("long").alias("pos"), X.parse_tag(F.col("content")).alias("answer"))


@query("SELECT conv_id, agreed_pos, final_answer FROM ended", derived=True)
def agreement(spark, sf):
    return scoring.agreement(fixture.turns(spark, sf), ["conv_id"]).select("conv_id", F.col("agreed_pos").cast("long").alias("agreed_pos"), "final_answer")


@query(
    r"""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
n AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(trim(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), 'm='), 'm ='), '\s+'), lambda x: x <> '') AS a,
  list_filter(regexp_split_to_array(trim(trim(regexp_replace(lower(reply), '^\s+|\s+$', '', 'g'), 'm='), 'm ='), '\s+'), lambda x: x <> '') AS b FROM p WHERE reply IS NOT NULL),
ca AS (SELECT conv_id, turn, t, count(*) AS k FROM (SELECT conv_id, turn, unnest(a) AS t FROM n) GROUP BY ALL),
cb AS (SELECT conv_id, turn, t, count(*) AS k FROM (SELECT conv_id, turn, unnest(b) AS t FROM n) GROUP BY ALL),
tp AS (SELECT conv_id, turn, sum(least(ca.k, cb.k)) AS tp FROM ca JOIN cb USING (conv_id, turn, t) GROUP BY ALL)
SELECT n.conv_id, n.turn, round(CASE WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 2 * (tp / len(b)::DOUBLE) * (tp / len(a)::DOUBLE) / (tp / len(b)::DOUBLE + tp / len(a)::DOUBLE) END, 9)::DOUBLE AS f1 FROM n LEFT JOIN tp USING (conv_id, turn)"""
)
def token_f1(spark, sf):
    from pyspark.sql import Window

    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").repartition(spark.sparkContext.defaultParallelism, "conv_id").withColumn("reply", reply).where("reply is not null")
    return rows.select("conv_id", "turn", _r(X.token_f1(F.col("text"), F.col("reply"))).alias("f1"))


@query("SELECT conv_id, coalesce(lower(final_answer) IN (lower(answer)), false) AS list_match, coalesce(lower(trim(final_answer, chr(92))) = lower(answer), false) AS single_match FROM traj", derived=True)
def exact_match_list(spark, sf):
    df = fixture.trajectories(spark, sf)
    score = lambda is_list: scoring.correct_score(F.col("answers"), F.lit(is_list), F.col("final_answer"), F.col("score_type")) == 1.0
    return df.select("conv_id", score(True).alias("list_match"), score(False).alias("single_match"))


@query(
    "SELECT conv_id, CASE WHEN name_pos IS NOT NULL AND (dup_pos IS NULL OR name_pos <= dup_pos) THEN 'name' WHEN dup_pos IS NOT NULL THEN 'duplicate' END AS offence, CASE WHEN name_pos IS NOT NULL THEN -10.0 ELSE 0.0 END::DOUBLE AS name_penalty, dup_pos IS NOT NULL AS has_repeats FROM traj",
    derived=True,
)
def format_gate(spark, sf):
    said = F.transform("turns", lambda t: t["content"])
    return fixture.trajectories(spark, sf).select("conv_id", scoring.format_offence(said).alias("offence"), scoring.name_penalty(F.col("conversation")).alias("name_penalty"), analysis.has_repeats(F.col("conversation")).alias("has_repeats"))


@query(
    r"""WITH m AS (SELECT conv_id, pos, (regexp_matches(content, 'Alice:') AND regexp_matches(content, 'Bob:')) AS mixed, is_mixed FROM mixed JOIN turns USING (conv_id, pos)),
f AS (SELECT conv_id, min(CASE WHEN mixed THEN pos END) AS last FROM m GROUP BY conv_id)
SELECT conv_id, CAST(sum(CASE WHEN is_mixed AND (last IS NULL OR pos <= last) THEN -10.0 ELSE 0.0 END) AS DOUBLE) AS penalty FROM m JOIN f USING (conv_id) GROUP BY conv_id""",
    derived=True,
)
def legacy_clean(spark, sf):
    return fixture.trajectories(spark, sf).select("conv_id", scoring.legacy_clean(F.col("conversation")).alias("penalty"))


@query(
    """WITH given AS (SELECT conv_id, pos, parsed_answer, last_value(parsed_answer IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM turns),
hit AS (SELECT conv_id, min(pos) AS agreed_pos FROM given WHERE parsed_answer = held GROUP BY conv_id)
SELECT t.conv_id, any_value(h.agreed_pos) AS agreed_pos, coalesce(max(t.parsed_answer) FILTER (t.pos = h.agreed_pos), arg_max(t.parsed_answer, t.pos) FILTER (t.parsed_answer IS NOT NULL)) AS final_answer FROM turns t LEFT JOIN hit h USING (conv_id) GROUP BY t.conv_id""",
    derived=True,
)
def legacy_agreement(spark, sf):
    return scoring.agreement(fixture.turns(spark, sf), ["conv_id"], mode="legacy").select("conv_id", F.col("agreed_pos").cast("long").alias("agreed_pos"), "final_answer")


@query(
    r"""WITH plain AS (SELECT conv_id, pos, lower(trim(trim(regexp_replace(content, '^\s+|\s+$', '', 'g'), 'Alice:'), 'Bob:')) AS said FROM turns),
again AS (SELECT conv_id, bool_or(n > 1) AS twice FROM (SELECT conv_id, said, count(*) AS n FROM plain GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, CASE WHEN twice THEN 'duplicate' END AS offence FROM again""",
    derived=True,
)
def legacy_format(spark, sf):
    df = fixture.trajectories(spark, sf)
    return df.select("conv_id", scoring.format_offence(F.transform("turns", lambda t: t["content"]), mode="legacy").alias("offence"))


# Preference pairs


def _branches(spark, sf):
    conv = F.col("conv_id")
    candidate = F.when(conv % 23 == 0, "error").when(conv % 19 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("trajectory_id") % 3).cast("string")))
    df = fixture.scored(spark, sf)
    return df.select("task_id", F.col("trajectory_id").alias("branch_id"), candidate.alias("candidate"), F.col("reward").alias("effective_reward"))


@query(
    """WITH v AS (SELECT task_id, 'c' || CAST(trajectory_id % 3 AS VARCHAR) AS candidate, avg(reward) AS value, min(trajectory_id) AS seq FROM scored WHERE conv_id % 23 <> 0 AND conv_id % 19 <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY value DESC, seq) AS b, row_number() OVER (PARTITION BY task_id ORDER BY value, seq DESC) AS w, count(*) OVER (PARTITION BY task_id) AS n FROM v),
p AS (SELECT task_id, max(CASE WHEN b = 1 THEN candidate END) AS chosen, max(CASE WHEN w = 1 THEN candidate END) AS rejected, max(CASE WHEN b = 1 THEN value END) AS hi, max(CASE WHEN w = 1 THEN value END) AS lo FROM r WHERE n > 1 GROUP BY task_id)
SELECT task_id, chosen, rejected, round(hi, 9) AS chosen_value, round(lo, 9) AS rejected_value, round(hi - lo, 9) AS distance FROM p WHERE hi > 0.4::DOUBLE AND hi - lo > 0.2::DOUBLE""",
    derived=True,
)
def state_pairs(spark, sf):
    out = pairs.state_pairs(_branches(spark, sf), ["task_id"])
    return out.select("task_id", "chosen", "rejected", *[_r(c).alias(c) for c in ("chosen_value", "rejected_value", "distance")])


def _paths(spark, sf):
    trajectory = F.col("trajectory_id").cast("int")
    action = lambda p: F.when(p == 0, F.substring(F.lit("xy"), F.floor(trajectory / 2).cast("int") + 1, F.lit(1))).when(p == 1, F.substring(F.lit("xy"), trajectory % 2 + 1, F.lit(1))).otherwise("z")
    df = fixture.scored(spark, sf).withColumn("actions", F.transform(F.sequence(F.lit(0), F.size("turns") - 1), action))
    path = F.concat(F.array(F.lit("")), F.transform("actions", lambda a, k: F.array_join(F.slice("actions", F.lit(1), k + 1), "")))
    return df.select("task_id", F.col("conv_id").alias("rollout"), "reward", path.alias("path"))


def _edges(spark, sf):
    nodes = pairs.backpropagate(_paths(spark, sf))
    return nodes.withColumn("content", F.right("node_id", F.lit(1)))


_EDGES_SQL = """WITH acts AS (SELECT t.conv_id, t.task_id, s.reward, t.pos, CASE t.pos WHEN 0 THEN substr('xy', CAST(t.trajectory_id // 2 + 1 AS INTEGER), 1) WHEN 1 THEN substr('xy', CAST(t.trajectory_id % 2 + 1 AS INTEGER), 1) ELSE 'z' END AS a FROM turns t JOIN scored s USING (conv_id)),
paths AS (SELECT conv_id, task_id, reward, pos + 1 AS depth, string_agg(a, '') OVER (PARTITION BY conv_id ORDER BY pos) AS node_id FROM acts UNION ALL SELECT conv_id, task_id, reward, 0, '' FROM scored),
edges AS (SELECT task_id, node_id, CASE WHEN depth > 0 THEN left(node_id, CAST(depth - 1 AS INTEGER)) END AS parent_id, depth, avg(reward) AS value, count(*) AS visits, min(conv_id) AS seq FROM paths GROUP BY ALL)"""


@query(_EDGES_SQL + " SELECT task_id, node_id, parent_id, depth, round(value, 9) AS value, visits, seq FROM edges", derived=True)
def tree_backprop(spark, sf):
    return _edges(spark, sf).select("task_id", "node_id", "parent_id", F.col("depth").cast("long").alias("depth"), _r("value").alias("value"), "visits", "seq")


@query(
    _EDGES_SQL
    + """, steps AS (SELECT task_id, conv_id, depth, node_id, avg(reward) OVER (PARTITION BY task_id, node_id ORDER BY conv_id) AS v FROM paths),
l AS (SELECT task_id, left(node_id, CAST(depth - 1 AS INTEGER)) AS parent_id, list({c: node_id, v: v, hi: node_id, hv: v, lo: node_id, lv: v} ORDER BY conv_id) AS l FROM steps WHERE depth > 0 GROUP BY ALL),
h AS (SELECT task_id, parent_id, list_reduce(l, lambda a, x: {c: x.c, v: x.v,
  hi: CASE WHEN x.v > CASE WHEN a.hi = x.c THEN x.v ELSE a.hv END THEN x.c ELSE a.hi END, hv: CASE WHEN a.hi = x.c OR x.v > a.hv THEN x.v ELSE a.hv END,
  lo: CASE WHEN x.v < CASE WHEN a.lo = x.c THEN x.v ELSE a.lv END THEN x.c ELSE a.lo END, lv: CASE WHEN a.lo = x.c OR x.v < a.lv THEN x.v ELSE a.lv END}) AS s FROM l)
SELECT task_id, parent_id, s.hi AS chosen, round(s.hv, 9) AS chosen_value, s.lo AS rejected, round(s.lv, 9) AS rejected_value FROM h""",
    derived=True,
)
def path_extremes(spark, sf):
    out = pairs.path_extremes(_paths(spark, sf))
    return out.select("task_id", "parent_id", "chosen", "rejected", *[_r(c).alias(c) for c in ("chosen_value", "rejected_value")])


_TREE_SQL = (
    _EDGES_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY task_id, parent_id ORDER BY value DESC, seq) AS b, row_number() OVER (PARTITION BY task_id, parent_id ORDER BY value, seq DESC) AS w, count(*) OVER (PARTITION BY task_id, parent_id) AS n FROM edges WHERE parent_id IS NOT NULL),
p AS (SELECT task_id, parent_id AS state_id, depth - 1 AS depth, right(max(CASE WHEN b = 1 THEN node_id END), 1) AS chosen, right(max(CASE WHEN w = 1 THEN node_id END), 1) AS rejected, max(CASE WHEN b = 1 THEN value END) AS hi, max(CASE WHEN w = 1 THEN value END) AS lo FROM r WHERE n > 1 GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY hi DESC, state_id) AS place, count(*) OVER (PARTITION BY task_id) AS n FROM p WHERE hi > 0.4::DOUBLE AND hi - lo > 0.2::DOUBLE),
kept AS (SELECT *, CASE WHEN depth % 2 = 0 THEN 'Alice' ELSE 'Bob' END AS speaker FROM ok WHERE place <= CASE WHEN n >= 2 THEN greatest(1, floor(0.5::DOUBLE * n)) ELSE n END)"""
)


@query(_TREE_SQL + " SELECT task_id, state_id, speaker, chosen, rejected, round(hi, 9) AS chosen_value, round(hi - lo, 9) AS distance FROM kept", derived=True)
def tree_pairs(spark, sf):
    return pairs.tree_pairs(_edges(spark, sf)).select("task_id", "state_id", "speaker", "chosen", "rejected", _r("chosen_value").alias("chosen_value"), _r("distance").alias("distance"))


@query(_TREE_SQL + " SELECT speaker, count(*) AS pairs, round(avg(hi), 9) AS mean_value, round(avg(hi - lo), 9) AS mean_gap FROM kept GROUP BY speaker", derived=True)
def pair_stats(spark, sf):
    return analysis.pair_stats(pairs.tree_pairs(_edges(spark, sf))).select("speaker", "pairs", _r("mean_value").alias("mean_value"), _r("mean_gap").alias("mean_gap"))


@query(
    _EDGES_SQL
    + """, d AS (SELECT *, ((task_id * 37) % 100) / 100.0::DOUBLE AS u, row_number() OVER (PARTITION BY task_id ORDER BY round(value, 9) DESC, node_id) AS place FROM edges),
e AS (SELECT *, exp(round(value, 9) - max(round(value, 9)) OVER (PARTITION BY task_id)) AS wt FROM d WHERE place <= 10),
c AS (SELECT *, sum(wt) OVER (PARTITION BY task_id ORDER BY place) AS upto, sum(wt) OVER (PARTITION BY task_id) AS whole, count(*) OVER (PARTITION BY task_id) AS n FROM e)
SELECT task_id, node_id FROM c WHERE upto >= u * whole OR place = n QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY place) = 1""",
    derived=True,
)
def softmax_topk(spark, sf):
    nodes = _edges(spark, sf).withColumn("value", _r("value"))
    draw = ((F.col("task_id") * 37) % 100) / 100.0
    return pairs.softmax_draw(nodes, ["task_id"], draw).select("task_id", "node_id")


@query("SELECT task_id, arg_min(trajectory_id, (-reward, trajectory_id)) AS chosen_id, arg_min(trajectory_id, (reward, trajectory_id)) AS rejected_id FROM scored GROUP BY task_id", derived=True)
def argmax_argmin_pairs(spark, sf):
    return pairs.argmax_argmin(fixture.scored(spark, sf))


@query(
    "SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < a.p_partkey AND b.p_brand = a.p_brand AND levenshtein(a.p_name, b.p_name) / (greatest(length(a.p_name), length(b.p_name)) + 1.0::DOUBLE) < 0.25::DOUBLE)"
)
def near_dup_edit(spark, sf):
    nodes = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_name").alias("content"))
    return pairs.unlike_selected(nodes, nodes, ["p_brand"], earlier="p_partkey").select("p_partkey")


# Chat rows


def _speaker_messages(spark, sf):
    df = compose.both_speakers(fixture.trajectories(spark, sf))
    return df.withColumn("messages", chat.own_turns(F.concat(F.lit("You are "), F.col("speaker"), F.lit(".")), F.col("turns"), F.col("speaker")))


_SPEAKER_SQL = """WITH who AS (SELECT unnest(['Alice', 'Bob']) AS me),
msgs AS (SELECT conv_id, me, pos, CASE WHEN speaker = me THEN 'assistant' ELSE 'user' END AS role, content FROM turns, who UNION ALL SELECT conv_id, me, -1, 'system', 'You are ' || me || '.' FROM traj, who)"""


@query(_SPEAKER_SQL + " SELECT conv_id, me AS speaker, string_agg('<|' || role || '|>' || chr(10) || content || '</s>' || chr(10), '' ORDER BY pos) AS text FROM msgs GROUP BY conv_id, me HAVING count(*) FILTER (role = 'assistant') > 0", derived=True)
def speaker_rows(spark, sf):
    own = _speaker_messages(spark, sf).where(F.exists("turns", lambda t: t["speaker"] == F.col("speaker")))
    return own.select("conv_id", "speaker", chat.render(F.col("messages")).alias("text"))


@query(
    _SPEAKER_SQL
    + """, as_user AS (SELECT conv_id, me, pos, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, content FROM msgs),
marked AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id, me ORDER BY pos) THEN 1 ELSE 0 END AS new FROM as_user),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, me ORDER BY pos) AS g FROM marked),
merged AS (SELECT conv_id, me, g, any_value(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM grouped GROUP BY conv_id, me, g)
SELECT conv_id, me AS speaker, count(*) AS n, md5(string_agg(role || ':' || content, '|' ORDER BY g)) AS digest FROM merged GROUP BY conv_id, me""",
    derived=True,
)
def chat_merge(spark, sf):
    merged = _speaker_messages(spark, sf).withColumn("m", chat.adapt(F.col("messages"), True))
    digest = F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))
    return merged.select("conv_id", "speaker", F.size("m").cast("long").alias("n"), digest.alias("digest"))


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last, '<|' || role || '|>' || chr(10) || text || '</s>' || chr(10) AS r FROM conversations)
SELECT conv_id, coalesce(string_agg(CASE WHEN turn < last THEN r END, '' ORDER BY turn), '') AS prompt, max(CASE WHEN turn = last THEN r END) AS completion FROM m GROUP BY conv_id"""
)
def pair_format(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("t")).withColumn("messages", F.transform("t", lambda x: chat.message(x["role"], x["text"])))
    full, prompt = chat.render(F.col("messages")), chat.render(chat.prompt_part(F.col("messages")))
    return nested.select("conv_id", prompt.alias("prompt"), chat.completion_text(full, prompt, chat.render(chat.completion_part(F.col("messages")))).alias("completion"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || rtrim(text, chr(10)), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_split(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("t"))
    back = nested.select("conv_id", chat.read_tagged(chat.render_chatml(F.transform("t", lambda x: chat.message(x["role"], x["text"])))).alias("m"))
    digest = F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))
    return back.select("conv_id", F.size("m").cast("long").alias("n"), digest.alias("digest"))


# Composing datasets


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 < floor(0.98::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_train_test(spark, sf):
    return selection.split_rows(table(spark, sf, "documents").select("doc_id"), "42", "doc_id", S.sft_train_share)


@query(
    """WITH s(lang, share) AS (VALUES ('en', 0.5::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 1.0::DOUBLE)),
r AS (SELECT doc_id, lang, share, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN s USING (lang))
SELECT doc_id, lang, md5('7|' || doc_id) AS order_key FROM r WHERE place <= floor(share * n)"""
)
def mix_proportional(spark, sf):
    return compose.mix(table(spark, sf, "documents").select("doc_id", "lang"), "lang", {"en": 0.5, "de": 0.3, "fr": 1.0}, "7", "doc_id")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn, dense_rank() OVER (ORDER BY lang) - 1 AS source_no FROM documents")
def round_robin_mix(spark, sf):
    out = compose.round_robin(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return out.select("doc_id", "lang", F.col("turn").cast("long").alias("turn"), F.col("source_no").cast("long").alias("source_no"))


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), d AS (SELECT unnest(range(max(n) // 2, max(n) // 2 + max(n))) AS t, max(n) // 2 AS b FROM r) SELECT t - b AS draw, p_partkey FROM d, r WHERE r.i = t % r.n")
def cursor_wraparound(spark, sf):
    part = table(spark, sf, "part").select("p_partkey")
    n = part.count()  # a whole lap from the middle on
    return compose.cursor(part, "p_partkey", n // 2, n).select(F.col("draw").cast("long").alias("draw"), "p_partkey")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf):
    return compose.unfinished(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def overlap_anti(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return compose.unfinished(docs, docs.join(table(spark, sf, "labels"), "doc_id"), "text").select("doc_id")


@query(
    r"""WITH b AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark),
d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE p <> '' AND contains(t, p))"""
)
def decontaminate(spark, sf):
    docs = fixture.spread(table(spark, sf, "documents").select("doc_id", "text"))
    return compose.decontaminate(docs, table(spark, sf, "benchmark")).select("doc_id")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 0 THEN 'low' END, d.source) AS source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def stage_overlay(spark, sf):
    labels = table(spark, sf, "labels")
    first = labels.select("doc_id", F.when(F.col("quality") == 0, "low").alias("source"), "quality")
    second = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("source"))
    return compose.overlay(table(spark, sf, "documents").select("doc_id", "source"), first, second, keys=["doc_id"])


@query(
    """WITH e AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY user_id, island"""
)
def island_group(spark, sf):
    out = compose.islands(table(spark, sf, "events"), "event_type", "event_id", ["user_id"])
    return out.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


# Analysis


@query("SELECT round(avg(best), 9) AS pass_rate, count(*) AS tasks FROM (SELECT task_id, max(correct_score) AS best FROM scored WHERE trajectory_id < 2 GROUP BY task_id)", derived=True)
def pass_at_k(spark, sf):
    return analysis.pass_at(fixture.scored(spark, sf), 2).select(_r("pass_rate").alias("pass_rate"), "tasks")


_VOTE_SQL = "WITH v AS (SELECT task_id, lower(final_answer) AS answer_key, CASE WHEN final_answer IS NULL THEN trajectory_id END AS alone, count(*) AS votes, min(trajectory_id) AS first_pos, avg(correct_score) AS score FROM scored GROUP BY ALL)"


@query(_VOTE_SQL + " SELECT task_id, answer_key, votes, round(score, 9) AS score FROM v QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY votes DESC, first_pos) = 1", derived=True)
def consensus_vote(spark, sf):
    return analysis.consensus(fixture.scored(spark, sf), ["task_id"]).select("task_id", "answer_key", "votes", _r("score").alias("score"))


@query(
    """WITH m AS (SELECT s.*, k FROM scored s, (SELECT unnest(range(1, 5)) AS k) WHERE trajectory_id < k),
p AS (SELECT k, task_id, max(correct_score) AS best, sum(token_count) AS toks FROM m GROUP BY ALL),
v AS (SELECT k, task_id, lower(final_answer) AS a, CASE WHEN final_answer IS NULL THEN trajectory_id END AS alone, count(*) AS votes, min(trajectory_id) AS f, avg(correct_score) AS score FROM m GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, task_id ORDER BY votes DESC, f) = 1)
SELECT CAST(k AS INTEGER) AS k, round(avg(best), 9) AS pass_rate, round(avg(score), 9) AS consensus_accuracy, round(avg(toks), 6) AS tokens, count(*) AS tasks FROM p JOIN w USING (k, task_id) GROUP BY k""",
    derived=True,
)
def sc_curve(spark, sf):
    out = analysis.consistency_curve(fixture.scored(spark, sf), 4)
    return out.select("k", _r("pass_rate").alias("pass_rate"), _r("consensus_accuracy").alias("consensus_accuracy"), _r("tokens", 6).alias("tokens"), "tasks")


@query(
    "SELECT count(*) AS trajectories, round(avg(correct_score), 9) AS mean_correct_score, count(*) FILTER (correct_score = 1) AS fully_correct, round(avg(reward), 9) AS mean_reward, round(avg(token_count), 6) AS mean_tokens, CAST(median(token_count) AS DOUBLE) AS median_tokens, count(*) FILTER (coalesce(final_answer, '') <> '') AS parsed_answer, count(*) FILTER (name_penalty < 0) AS name_penalized, count(*) FILTER (dup_pos IS NOT NULL) AS duplicate_trajectory FROM penalised",
    derived=True,
)
def run_summary(spark, sf):
    df = fixture.scored(spark, sf).withColumn("name_penalty", scoring.name_penalty(F.col("conversation")))
    out = analysis.run_summary(df)
    return out.withColumns({c: _r(c, d) for c, d in (("mean_correct_score", 9), ("mean_reward", 9), ("mean_tokens", 6))})


@query("SELECT termination_reason, count(*) AS n FROM traj GROUP BY termination_reason", derived=True)
def termination_hist(spark, sf):
    return analysis.histogram(fixture.trajectories(spark, sf), "termination_reason")


def _marked(spark, sf):
    df = stage(fixture.scored(spark, sf), "scored")
    chosen = selection.select_trajectories(df).select("conv_id", "rank", "effective_reward", F.lit(True).alias("selected"))
    return df.join(chosen, "conv_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


@query("SELECT c.conv_id IS NOT NULL AS selected, count(*) AS n, round(avg(s.reward), 9) AS mean_reward, round(avg(s.correct_score), 9) AS mean_correct_score, round(avg(s.token_count), 6) AS mean_token_count FROM scored s LEFT JOIN chosen c USING (conv_id) GROUP BY 1", derived=True)
def lift_report(spark, sf):
    out = analysis.lift(_marked(spark, sf), ["reward", "correct_score", "token_count"])
    return out.select("selected", "n", _r("mean_reward").alias("mean_reward"), _r("mean_correct_score").alias("mean_correct_score"), _r("mean_token_count", 6).alias("mean_token_count"))


@query(
    "SELECT round(avg(score), 9) AS accuracy, round(avg(tokens), 6) AS tokens, count(*) AS tasks FROM (SELECT task_id, sum(CASE WHEN is_large THEN 0.0::DOUBLE ELSE correct_score END) / count(*) AS score, sum(CASE WHEN is_large THEN 0 ELSE token_count END) / count(*) AS tokens FROM scored GROUP BY task_id)",
    derived=True,
)
def result_stats_macro(spark, sf):
    return analysis.result_stats(fixture.scored(spark, sf)).select(_r("accuracy").alias("accuracy"), _r("tokens", 6).alias("tokens"), "tasks")


@query("SELECT task_id, CAST(floor(round(quantile_cont(token_count::DOUBLE, 0.85::DOUBLE), 6)) + 1 AS BIGINT) AS budget FROM traj WHERE NOT is_large GROUP BY task_id", derived=True)
def token_budget(spark, sf):
    return analysis.token_budget(fixture.trajectories(spark, sf), S.budget_quantile, ["task_id"])


_COMPARE_SQL = "h AS (SELECT *, coalesce(lower(trim(final_answer, chr(92))), '') = lower(answer) AS hit, correct_score = 1.0 AS good FROM scored)"


@query(
    "WITH " + _COMPARE_SQL + " SELECT count(*) AS trajectories, count(*) FILTER (hit) AS raw_exact_correct, round(avg(hit::INTEGER), 9) AS raw_exact_accuracy, count(*) FILTER (good) AS reward_qualified_correct, round(avg(good::INTEGER), 9) AS reward_qualified_accuracy, count(*) FILTER (hit) - count(*) FILTER (good) AS correct_but_format_penalized, round(avg(token_count), 6) AS mean_tokens, median(token_count)::DOUBLE AS median_tokens, count(*) FILTER (coalesce(final_answer, '') <> '') AS parsed_answer FROM h",
    derived=True,
)
def compare_exact(spark, sf):
    out = analysis.compare_exact(fixture.scored(spark, sf))
    return out.withColumns({"raw_exact_accuracy": _r("raw_exact_accuracy"), "reward_qualified_accuracy": _r("reward_qualified_accuracy"), "mean_tokens": _r("mean_tokens", 6)})


_SIDE_SQL = """SELECT CASE WHEN trajectory_id < 2 THEN 'baseline' ELSE 'post' END AS run, unnest(['trajectories', 'raw_exact_correct', 'raw_exact_accuracy', 'reward_qualified_correct', 'reward_qualified_accuracy', 'correct_but_format_penalized', 'mean_tokens', 'median_tokens', 'parsed_answer']) AS metric,
unnest([count(*)::DOUBLE, count(*) FILTER (hit), avg(hit::INTEGER), count(*) FILTER (good), avg(good::INTEGER), count(*) FILTER (hit) - count(*) FILTER (good), avg(token_count), median(token_count), count(*) FILTER (coalesce(final_answer, '') <> '')]) AS v FROM h GROUP BY 1
UNION ALL SELECT CASE WHEN trajectory_id < 2 THEN 'baseline' ELSE 'post' END, 'termination ' || termination_reason, count(*) FROM h GROUP BY ALL"""


@query("WITH " + _COMPARE_SQL + f", m AS ({_SIDE_SQL}) SELECT metric, round(coalesce(max(v) FILTER (run = 'baseline'), 0.0), 6)::DOUBLE AS baseline, round(coalesce(max(v) FILTER (run = 'post'), 0.0), 6)::DOUBLE AS post FROM m GROUP BY metric", derived=True)
def compare_runs(spark, sf):
    df = fixture.scored(spark, sf)
    out = analysis.compare_runs(df.where("trajectory_id < 2"), df.where("trajectory_id >= 2"))
    return out.select("metric", _r("baseline", 6).alias("baseline"), _r("post", 6).alias("post"))


@query(
    "WITH s AS (SELECT CAST(trajectory_id AS BIGINT) AS stage, avg(reward) AS r FROM scored GROUP BY 1) SELECT stage, round(r, 9) AS reward, round(r - first_value(r) OVER (ORDER BY stage), 9) AS reward_delta, round(100 * (r - first_value(r) OVER (ORDER BY stage)) / first_value(r) OVER (ORDER BY stage), 6) AS reward_percent FROM s",
    derived=True,
)
def stage_deltas(spark, sf):
    stages = fixture.scored(spark, sf).groupBy(F.col("trajectory_id").alias("stage")).agg(F.avg("reward").alias("reward"))
    return analysis.stage_deltas(stages, "stage", "stage", ["reward"]).select("stage", _r("reward").alias("reward"), _r("reward_delta").alias("reward_delta"), _r("reward_percent", 6).alias("reward_percent"))


# Quality checks

_TIER = "CASE WHEN {v} <= 0 THEN 'PASS' WHEN {v} <= {fair} THEN 'WARN' ELSE 'FAIL' END"


@query(
    r"""WITH sizes AS (SELECT task_id, count(*) AS n FROM traj GROUP BY task_id),
one AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN coalesce(final_answer, '') <> '' THEN 1.0 ELSE 0.0 END)::DOUBLE AS answered, avg(CASE WHEN is_large THEN 1.0 ELSE 0.0 END)::DOUBLE AS lrg,
  avg(CASE WHEN NOT is_large AND conv_id % 43 = 7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS err, avg(CASE WHEN termination_reason = 'agreement' AND conv_id % 43 <> 7 THEN 1.0 ELSE 0.0 END)::DOUBLE AS agr FROM traj),
tk AS (SELECT count(*)::DOUBLE AS tasks, (count(*) FILTER (n <> 4))::DOUBLE AS odd, min(task_id) <> 0 OR max(task_id) <> count(*) - 1 AS gap FROM sizes)
SELECT 'answer_rate' AS "check", CASE WHEN answered >= 0.9 THEN 'PASS' WHEN answered >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS status, round(answered, 9) AS value FROM one
UNION ALL SELECT 'large_rate', """
    + _TIER.format(v="lrg", fair="0.2")
    + """, round(lrg, 9) FROM one
UNION ALL SELECT 'error_rate', """
    + _TIER.format(v="err", fair="0.05")
    + """, round(err, 9) FROM one
UNION ALL SELECT 'agreement_rate', CASE WHEN agr >= 0.5 THEN 'PASS' ELSE 'WARN' END, round(agr, 9) FROM one
UNION ALL SELECT 'task_count', CASE WHEN tasks = 25 THEN 'PASS' ELSE 'FAIL' END, tasks FROM tk
UNION ALL SELECT 'results_per_task', CASE WHEN odd = 0 THEN 'PASS' ELSE 'FAIL' END, odd FROM tk
UNION ALL SELECT 'task_ids', CASE WHEN gap THEN 'FAIL' ELSE 'PASS' END, gap::INTEGER::DOUBLE FROM tk""",
    derived=True,
)
def quality_checks(spark, sf):
    ended = F.when((F.col("conv_id") % 43 == 7) & (F.col("termination_reason") != "large"), "error").otherwise(F.col("termination_reason"))
    return quality.trajectory_checks(fixture.trajectories(spark, sf).withColumn("termination_reason", ended), 25, 4).withColumn("value", _r("value"))


@query(
    r"""WITH tt AS (SELECT avg(CASE WHEN regexp_matches(content, '^\s*\**\s*' || speaker || '\s*:') THEN 1.0 ELSE 0.0 END)::DOUBLE AS pre, (count(*) FILTER (conv_id % 5 = 0 AND pos = 3))::DOUBLE AS blank, (count(*) FILTER ((conv_id + pos) % 29 = 0))::DOUBLE AS cut, (count(*) FILTER (conv_id % 9 = 4 AND pos IN (1, 2) AND NOT (conv_id % 5 = 0 AND pos = 3)))::DOUBLE AS odd FROM
  (SELECT conv_id, pos, speaker, CASE WHEN conv_id % 5 = 0 AND pos = 3 THEN ' ' ELSE content END AS content FROM turns)),
pl AS (SELECT conv_id, pos, lower(regexp_replace(regexp_replace(content, '^\s*\**\s*(Alice|Bob)\s*:\s*', ''), '^\s+|\s+$', '', 'g')) AS plain FROM turns),
rp AS (SELECT conv_id, count(*) > count(DISTINCT plain) AS twice FROM pl WHERE plain <> '' GROUP BY conv_id),
cc AS (SELECT (count(*) FILTER (name_pos IS NOT NULL))::DOUBLE AS mix, avg(coalesce(twice, false)::INTEGER)::DOUBLE AS rep FROM traj LEFT JOIN rp USING (conv_id))
SELECT 'name_prefix_rate' AS "check", CASE WHEN pre >= 0.99 THEN 'PASS' WHEN pre >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS status, round(pre, 9) AS value FROM tt
UNION ALL SELECT 'blank_turns', CASE WHEN blank = 0 THEN 'PASS' ELSE 'FAIL' END, blank FROM tt
UNION ALL SELECT 'mojibake_turns', CASE WHEN odd = 0 THEN 'PASS' ELSE 'WARN' END, odd FROM tt
UNION ALL SELECT 'truncated_turns', CASE WHEN cut = 0 THEN 'PASS' ELSE 'WARN' END, cut FROM tt
UNION ALL SELECT 'name_mixing', CASE WHEN mix = 0 THEN 'PASS' ELSE 'WARN' END, mix FROM cc
UNION ALL SELECT 'duplicate_rate', """
    + _TIER.format(v="rep", fair="0.05")
    + ", round(rep, 9) FROM cc",
    derived=True,
)
def quality_checks_turns(spark, sf):
    odd = (F.col("conv_id") % 9 == 4) & F.col("pos").isin(1, 2)  # a replacement character, or one below a tab
    said = F.when(odd, F.concat("content", F.when(F.col("pos") == 1, F.lit("\ufffd")).otherwise(F.lit("\x03")))).otherwise(F.col("content"))
    blank = F.when((F.col("conv_id") % 5 == 0) & (F.col("pos") == 3), F.lit(" ")).otherwise(said)
    turns = fixture.turns(spark, sf).withColumns({"content": blank, "finish_reason": F.when((F.col("conv_id") + F.col("pos")) % 29 == 0, "length").otherwise("stop")})
    both = quality.turn_checks(turns).unionByName(quality.conversation_checks(fixture.trajectories(spark, sf)))
    return both.withColumn("value", _r("value"))


@query(
    """WITH m AS (SELECT s.*, c.rank, c.conv_id IS NOT NULL AS selected FROM scored s LEFT JOIN chosen c USING (conv_id)),
one AS (SELECT (count(*) FILTER (selected))::DOUBLE AS chosen, coalesce(avg(reward) FILTER (selected), 0) - coalesce(avg(reward) FILTER (NOT selected), 0) AS lift, coalesce(avg(correct_score) FILTER (selected), 0) - coalesce(avg(correct_score) FILTER (NOT selected), 0) AS correct, (count(*) FILTER (selected AND reward < 0.6::DOUBLE))::DOUBLE AS below FROM m),
ups AS (SELECT (count(*) FILTER (up))::DOUBLE AS rises FROM (SELECT reward > lag(reward) OVER (ORDER BY rank) AS up FROM m WHERE selected))
SELECT 'selected_count' AS "check", CASE WHEN chosen > 0 THEN 'PASS' ELSE 'FAIL' END AS status, chosen AS value FROM one
UNION ALL SELECT 'reward_lift', CASE WHEN lift > 0 THEN 'PASS' ELSE 'FAIL' END, round(lift, 9) FROM one
UNION ALL SELECT 'correctness_lift', CASE WHEN correct > 0 THEN 'PASS' ELSE 'WARN' END, round(correct, 9) FROM one
UNION ALL SELECT 'threshold', CASE WHEN below = 0 THEN 'PASS' ELSE 'FAIL' END, below FROM one
UNION ALL SELECT 'rank_order', CASE WHEN rises = 0 THEN 'PASS' ELSE 'FAIL' END, rises FROM ups""",
    derived=True,
)
def quality_checks_selection(spark, sf):
    return quality.selection_checks(_marked(spark, sf), S.epsilon).withColumn("value", _r("value"))


@query(
    _TREE_SQL + """ SELECT 'state_count' AS "check", CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'WARN' END AS status, count(DISTINCT (task_id, state_id))::DOUBLE AS value FROM kept
UNION ALL SELECT 'pair_count', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'WARN' END, count(*)::DOUBLE FROM kept
UNION ALL SELECT 'pair_thresholds', CASE WHEN count(*) FILTER (hi <= 0.4::DOUBLE OR hi - lo <= 0.2::DOUBLE) = 0 THEN 'PASS' ELSE 'FAIL' END, (count(*) FILTER (hi <= 0.4::DOUBLE OR hi - lo <= 0.2::DOUBLE))::DOUBLE FROM kept""",
    derived=True,
)
def quality_checks_pairs(spark, sf):
    return quality.pair_checks(pairs.tree_pairs(_edges(spark, sf)), S.min_value, S.min_gap)


_PROMPTS_SQL = "CASE WHEN {c} % 10 = 0 THEN 'You are both.' ELSE 'You are Alice.' END AS system_first, CASE WHEN {c} % 10 = 0 THEN 'You are both.' ELSE 'You are Bob.' END AS system_second"


def _full(spark, sf, df=None):
    """Trajectories with system prompts and private contexts."""
    df = fixture.trajectories(spark, sf) if df is None else df
    shared = F.col("conv_id") % 10 == 0
    prompt = lambda name: F.when(shared, "You are both.").otherwise(f"You are {name}.")
    context = lambda side: F.when(F.col("conv_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("conv_id") % 9 == 0, "same").otherwise(side)))
    return df.withColumns({"system_first": prompt("Alice"), "system_second": prompt("Bob"), "context_first": context("a"), "context_second": context("b")})


@query(
    """WITH one AS (SELECT (count(*) FILTER (conv_id % 10 = 0))::DOUBLE AS system, (count(*) FILTER (conv_id % 6 <> 0 AND conv_id % 9 = 0))::DOUBLE AS context, (count(*) FILTER (conv_id % 6 = 0))::DOUBLE AS empty, (count(*) FILTER (conv_id % 8 = 0))::DOUBLE AS swapped FROM traj)
SELECT 'same_system' AS "check", CASE WHEN system = 0 THEN 'PASS' ELSE 'FAIL' END AS status, system AS value FROM one
UNION ALL SELECT 'same_context', CASE WHEN context = 0 THEN 'PASS' ELSE 'FAIL' END, context FROM one
UNION ALL SELECT 'empty_context', CASE WHEN empty = 0 THEN 'PASS' ELSE 'INFO' END, empty FROM one
UNION ALL SELECT 'alternation', CASE WHEN swapped = 0 THEN 'PASS' ELSE 'FAIL' END, swapped FROM one
UNION ALL SELECT 'alice_first', CASE WHEN swapped = 0 THEN 'PASS' ELSE 'WARN' END, swapped FROM one""",
    derived=True,
)
def quality_checks_independence(spark, sf):
    swap = lambda t: F.when(F.col("conv_id") % 8 == 0, F.when(t["speaker"] == "Alice", "Bob").otherwise("Alice")).otherwise(t["speaker"])
    return quality.independence_checks(_full(spark, sf).withColumn("turns", F.transform("turns", lambda t: t.withField("speaker", swap(t)))))


# Training sets


_SFT_SQL = rf"""WITH who AS (SELECT unnest(['Alice', 'Bob']) AS me), pr AS (SELECT conv_id, {_PROMPTS_SQL.format(c="conv_id")} FROM traj),
msgs AS (SELECT conv_id, me, pos, CASE WHEN speaker = me THEN 'assistant' ELSE 'user' END AS role, content FROM turns, who UNION ALL SELECT conv_id, me, -1, 'system', CASE WHEN me = 'Alice' THEN system_first ELSE system_second END FROM pr, who),
said AS (SELECT conv_id, me AS speaker, string_agg('<|' || role || '|>' || chr(10) || content || '</s>' || chr(10), '' ORDER BY pos) AS text FROM msgs GROUP BY conv_id, me HAVING count(*) FILTER (role = 'assistant') > 0),
short AS (SELECT * FROM said WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 600)"""


@query(
    _SFT_SQL
    + """, r AS (SELECT s.*, t.task_id, t.trajectory_id, c.reward, c.correct_score, md5('42:0:sft-split|' || speaker || ':' || t.task_id || ':' || t.trajectory_id) AS k FROM short s JOIN traj t USING (conv_id) JOIN scored c USING (conv_id))
SELECT speaker, md5(text) AS text, task_id, trajectory_id, round(reward, 9) AS reward, correct_score, CASE WHEN row_number() OVER (PARTITION BY speaker ORDER BY k) - 1 < floor(0.98::DOUBLE * count(*) OVER (PARTITION BY speaker)) THEN 'train' ELSE 'test' END AS split FROM r""",
    derived=True,
)
def speaker_datasets(spark, sf):
    out = builders.speaker_datasets(_full(spark, sf, fixture.scored(spark, sf)), max_tokens=600)
    return out.select("speaker", F.md5("text").alias("text"), "task_id", "trajectory_id", _r("reward").alias("reward"), "correct_score", "split")


@query(_SFT_SQL + """ SELECT 'role_routing' AS "check", CASE WHEN count(*) FILTER (conv_id % 10 = 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (count(*) FILTER (conv_id % 10 = 1))::DOUBLE AS value FROM said""", derived=True)
def quality_checks_routing(spark, sf):
    full = _full(spark, sf, fixture.scored(spark, sf))
    other = full.withColumn("system_first", F.when(F.col("conv_id") % 10 == 1, "other").otherwise(F.col("system_first"))).withColumn("system_second", F.when(F.col("conv_id") % 10 == 1, "other").otherwise(F.col("system_second")))
    return quality.routing_checks(builders.sft_rows(full), other, read=_read_plain)


def _read_plain(text):
    """Read the default rendering back through the tagged reader."""
    tagged = F.replace(F.regexp_replace(text, r"<\|(system|user|assistant)\|>\n", "<|im_start|>$1\n"), F.lit("</s>\n"), F.lit("<|im_end|>\n"))
    return chat.read_tagged(tagged)


def _states(spark, sf):
    """Two states for each task: branches of the root (even trajectories) and of Bob's answer (odd ones), with the first turn as prefix."""
    df = _full(spark, sf)
    bob = F.col("trajectory_id") % 2 == 1
    first = F.get(F.col("turns"), F.lit(0))
    kept = ["conversation", "token_count", "losses", "answers", "answer_is_list", "final_answer", "score_type", "system_first", "system_second", "turns"]
    return df.select("task_id", F.when(bob, "bob_after_alice").otherwise("alice_root").alias("state_id"), F.when(bob, "Bob").otherwise("Alice").alias("speaker"), F.when(bob, F.array(first)).otherwise(F.array().cast(df.schema["turns"].dataType)).alias("prefix_turns"), F.col("trajectory_id").alias("branch_id"), F.concat(F.lit("c"), F.floor(F.col("trajectory_id") / 2).cast("string")).alias("candidate"), *kept)


@query("SELECT task_id, CASE WHEN trajectory_id % 2 = 1 THEN 'bob_after_alice' ELSE 'alice_root' END AS state_id, trajectory_id AS branch_id, round(reward, 9) AS reward, round(effective_reward, 9) AS effective_reward FROM penalised", derived=True)
def score_branches(spark, sf):
    states = builders.nest_states(_states(spark, sf))
    out = builders.score_branches(builders.branches_of(states))
    return out.select("task_id", "state_id", "branch_id", _r("reward").alias("reward"), _r("effective_reward").alias("effective_reward"))


@query("SELECT task_id, arg_min(content, conv_id) AS content FROM turns WHERE pos = 0 AND trajectory_id <> 0 GROUP BY task_id", derived=True)
def anchor_turns(spark, sf):
    broken = F.when(F.col("branch_id") == 0, F.transform("turns", lambda t: t.withField("content", F.lit("error")))).otherwise(F.col("turns"))
    out = builders.anchor_turns(_states(spark, sf).withColumn("turns", broken), ["task_id"])
    return out.select("task_id", F.col("anchor.content").alias("content"))


@query(
    """WITH b AS (SELECT p.*, CASE WHEN trajectory_id % 2 = 1 THEN 'bob_after_alice' ELSE 'alice_root' END AS state_id, 'c' || CAST(trajectory_id // 2 AS VARCHAR) AS candidate FROM penalised p),
v AS (SELECT task_id, state_id, candidate, avg(effective_reward) AS value, min(trajectory_id) AS seq, min(conv_id) AS conv_id FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, state_id ORDER BY value DESC, seq) AS b, row_number() OVER (PARTITION BY task_id, state_id ORDER BY value, seq DESC) AS w, count(*) OVER (PARTITION BY task_id, state_id) AS n FROM v),
p AS (SELECT task_id, state_id, max(CASE WHEN b = 1 THEN candidate END) AS chosen, max(CASE WHEN w = 1 THEN candidate END) AS rejected, max(CASE WHEN b = 1 THEN value END) AS hi, max(CASE WHEN w = 1 THEN value END) AS lo FROM r WHERE n > 1 GROUP BY ALL),
f AS (SELECT task_id, state_id, min(trajectory_id) AS trajectory_id FROM b GROUP BY ALL),
ok AS (SELECT p.*, CASE WHEN p.state_id = 'alice_root' THEN 'Alice' ELSE 'Bob' END AS speaker, t.conv_id, u.content FROM p JOIN f USING (task_id, state_id) JOIN traj t ON t.task_id = f.task_id AND t.trajectory_id = f.trajectory_id JOIN turns u ON u.conv_id = t.conv_id AND u.pos = 0 WHERE hi > 0.4::DOUBLE AND hi - lo > 0.2::DOUBLE),
q AS (SELECT *, CASE WHEN conv_id % 10 = 0 THEN 'You are both.' ELSE 'You are ' || speaker || '.' END AS sys FROM ok)
SELECT speaker, '<|system|>' || chr(10) || sys || '</s>' || chr(10) || CASE WHEN speaker = 'Bob' THEN '<|user|>' || chr(10) || content || '</s>' || chr(10) ELSE '' END || '<|assistant|>' || chr(10) AS prompt, chosen || '</s>' || chr(10) AS chosen, rejected || '</s>' || chr(10) AS rejected, task_id, state_id, round(hi - lo, 9) AS distance,
CASE WHEN row_number() OVER (PARTITION BY speaker ORDER BY task_id, state_id) - 1 < greatest(1, floor(0.9::DOUBLE * count(*) OVER (PARTITION BY speaker))) THEN 'train' ELSE 'test' END AS split FROM q""",
    derived=True,
)
def pair_datasets(spark, sf):
    scored = stage(builders.score_branches(_states(spark, sf)), "branches")
    found = pairs.state_pairs(scored, ["task_id", "state_id", "speaker"])
    first = scored.groupBy("task_id", "state_id").agg(F.min_by(F.struct("system_first", "system_second", "prefix_turns"), "branch_id").alias("f")).select("task_id", "state_id", "f.*")
    out = builders.pair_datasets(found.join(first, ["task_id", "state_id"]))
    return out.select("speaker", "prompt", "chosen", "rejected", "task_id", "state_id", _r("distance").alias("distance"), "split")


_LEGACY_SQL = """WITH src AS (SELECT s.*, CASE task_id % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'arc' ELSE 'cbt' END AS dataset_name FROM scored s),
top AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY reward DESC, trajectory_id) = 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY reward DESC, task_id) - 1 AS place, count(*) OVER (PARTITION BY dataset_name) AS n FROM top),
win AS (SELECT * FROM pl WHERE place >= CASE WHEN dataset_name IN ('math', 'arc') THEN floor(0.1::DOUBLE * n) ELSE 0 END AND place < floor(CASE WHEN dataset_name IN ('math', 'arc') THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END * n) AND reward >= 0.6::DOUBLE)"""


def _legacy(spark, sf):
    name = F.element_at(F.array(F.lit("math"), F.lit("arc"), F.lit("cbt")), (F.col("task_id") % 3 + 1).cast("int"))
    info = {"dataset_name": name, "question": F.concat(F.lit("q"), F.col("task_id").cast("string")), "information_first": F.lit("one"), "information_second": F.lit("two")}
    return fixture.scored(spark, sf).withColumns(info)


@query(_LEGACY_SQL + " SELECT dataset_name, conv_id, round(reward, 9) AS reward FROM win", derived=True)
def select_by_dataset(spark, sf):
    return selection.select_by_dataset(_legacy(spark, sf)).select("dataset_name", "conv_id", _r("reward").alias("reward"))


@query(_LEGACY_SQL + " SELECT count(*) FILTER (reward >= 0.6::DOUBLE) AS count, round(avg(token_count) FILTER (reward >= 0.6::DOUBLE), 6) AS average_token, round(avg(reward) FILTER (reward >= 0.6::DOUBLE), 9) AS average_reward FROM top", derived=True)
def selection_means(spark, sf):
    return selection.selection_means(_legacy(spark, sf)).select("count", _r("average_token", 6).alias("average_token"), _r("average_reward").alias("average_reward"))


@query(
    _LEGACY_SQL
    + """, who AS (SELECT unnest(['Alice', 'Bob']) AS speaker),
sides AS (SELECT conv_id, md5(string_agg('assistant:' || content, '|' ORDER BY pos) || CASE WHEN any_value(is_large) THEN '|assistant:large' ELSE '' END) AS said FROM turns JOIN traj USING (conv_id) GROUP BY conv_id),
r AS (SELECT task_id, speaker, dataset_name, CASE WHEN speaker = 'Alice' THEN 'Alice asks Bob: q' || task_id || ' with one' ELSE 'Bob tells Alice: two on q' || task_id END AS prompt, said, md5('42|' || task_id || ':' || speaker) AS k FROM win JOIN sides USING (conv_id), who)
SELECT task_id, speaker, dataset_name, prompt, said, CASE WHEN row_number() OVER (ORDER BY k) - 1 < floor(0.98::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM r""",
    derived=True,
)
def legacy_sft_rows(spark, sf):
    out = builders.legacy_sft_rows(_legacy(spark, sf), "${name} asks ${partner}: ${question} with ${information}", "${name} tells ${partner}: ${information} on ${question}")
    said = F.md5(F.array_join(F.transform(F.slice("messages", F.lit(2), F.size("messages") - 1), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))
    return out.select("task_id", "speaker", "dataset_name", F.get("messages", F.lit(0))["content"].alias("prompt"), said.alias("said"), "split")


@query(
    """WITH ids AS (SELECT task_id, arg_min(conv_id, (-reward, trajectory_id)) AS a, arg_min(conv_id, (reward, trajectory_id)) AS b FROM scored GROUP BY task_id), who AS (SELECT unnest(['Alice', 'Bob']) AS speaker),
sides AS (SELECT conv_id, md5(string_agg(CASE WHEN pos = 0 THEN 'system:' ELSE 'assistant:' END || content, '|' ORDER BY pos) || CASE WHEN any_value(is_large) THEN '|assistant:large' ELSE '' END) AS said FROM turns JOIN traj USING (conv_id) GROUP BY conv_id)
SELECT task_id, speaker, speaker || ' and ' || CASE speaker WHEN 'Alice' THEN 'Bob' ELSE 'Alice' END || ' on q' || task_id || ': ' || CASE speaker WHEN 'Alice' THEN 'one' ELSE 'two' END AS prompt, x.said AS chosen, y.said AS rejected,
CASE WHEN row_number() OVER (ORDER BY task_id, speaker) - 1 < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM ids JOIN sides x ON x.conv_id = a JOIN sides y ON y.conv_id = b, who""",
    derived=True,
)
def legacy_pair_rows(spark, sf):
    out = builders.legacy_pair_rows(_legacy(spark, sf), "${name} and ${partner} on ${question}: ${information}")
    said = lambda c: F.md5(F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias(c)
    return out.select("task_id", "speaker", "prompt", said("chosen"), said("rejected"), "split")


@query(
    """WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
r AS (SELECT conv_id AS task_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair_no, 'system:' || text || '|assistant:' || next AS chosen, 'system:' || text AS rejected FROM n WHERE next IS NOT NULL)
SELECT task_id, pair_no, md5(chosen) AS chosen, md5(rejected) AS rejected, CASE WHEN row_number() OVER (ORDER BY task_id, pair_no) - 1 < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM r"""
)
def chat_pairs(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    nested = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(ordered.alias("t"))
    made = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x, k: F.struct(F.array(x["text"], F.get("t", k + 1)["text"]).alias("chosen"), F.array(x["text"]).alias("rejected")))
    out = builders.chat_pairs(nested.select("task_id", made.alias("dpo_results")))
    said = lambda c: F.md5(F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias(c)
    return out.select("task_id", F.col("pair_no").cast("long").alias("pair_no"), said("chosen"), said("rejected"), "split")


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS opens, '<|' || role || '|>' || chr(10) || text || '</s>' || chr(10) AS r FROM conversations)
SELECT conv_id, md5(CASE WHEN any_value(opens) = 'system' AND max(last) > 0 THEN '' ELSE '<|system|>' || chr(10) || '</s>' || chr(10) END || coalesce(string_agg(CASE WHEN turn < last THEN r END, '' ORDER BY turn), '')) AS prompt, md5(max(CASE WHEN turn = last THEN r END)) AS chosen, md5(max(CASE WHEN turn = last THEN replace(r, text, 'no ' || conv_id) END)) AS rejected,
md5(CASE WHEN any_value(opens) = 'system' THEN '' ELSE '<|system|>' || chr(10) || '</s>' || chr(10) END || string_agg(r, '' ORDER BY turn) || '<|assistant|>' || chr(10)) AS generation FROM m GROUP BY conv_id"""
)
def chat_task_formats(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("t")).withColumn("messages", F.transform("t", lambda x: chat.message(x["role"], x["text"])))
    last = F.element_at("messages", -1)
    worse = F.concat(chat.prompt_part(F.col("messages")), F.array(chat.message(last["role"], F.concat(F.lit("no "), F.col("conv_id").cast("string")))))
    dpo = builders.chat_task(nested.withColumns({"chosen": F.col("messages"), "rejected": worse}), "dpo")
    out = builders.chat_task(dpo, "generation")
    return out.select("conv_id", F.md5("text_prompt").alias("prompt"), F.md5("text_chosen").alias("chosen"), F.md5("text_rejected").alias("rejected"), F.md5("text").alias("generation"))


@query("WITH s AS (SELECT conv_id, turn, text, '<|user|>' || chr(10) || text || '</s>' || chr(10) AS t FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 60) SELECT conv_id, turn FROM s".replace("\\\\", "\\"))
def prompt_length(spark, sf):
    return builders.within(table(spark, sf, "conversations"), "text", 60, strict=True).select("conv_id", "turn")


@query(_EDGES_SQL + " SELECT task_id, node_id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth = 0 THEN '' ELSE array_to_string(string_split(node_id, ''), '>') END AS prefix FROM edges", derived=True)
def node_prefixes(spark, sf):
    return builders.node_prefixes(stage(_edges(spark, sf), "edges")).select("task_id", "node_id", F.col("depth").cast("long").alias("depth"), F.array_join("prefix", ">").alias("prefix"))


@query(_EDGES_SQL + " SELECT task_id, parent_id AS node_id, node_id AS child_id, CASE WHEN depth % 2 = 0 THEN 'A' ELSE 'B' END || '>' || array_to_string(string_split(node_id, ''), '>') AS conversation, round(value, 9) AS value FROM edges WHERE parent_id IS NOT NULL", derived=True)
def tree_records(spark, sf):
    edges = stage(_edges(spark, sf), "edges")
    prompts = edges.select("task_id", F.lit("A").alias("prompt_first"), F.lit("B").alias("prompt_second")).distinct()
    out = builders.tree_records(edges, prompts)
    return out.select("task_id", "node_id", "child_id", F.array_join("conversation", ">").alias("conversation"), _r("value").alias("value"))


@query(
    _EDGES_SQL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY value DESC, seq) AS b, row_number() OVER (PARTITION BY task_id ORDER BY value, seq DESC) AS w, count(*) OVER (PARTITION BY task_id) AS n FROM edges WHERE depth = 1)
SELECT task_id, max(CASE WHEN b = 1 THEN node_id END) AS chosen, max(CASE WHEN w = 1 THEN node_id END) AS rejected, round(max(value) - min(value), 9) AS distance FROM r WHERE n > 1 GROUP BY task_id HAVING max(value) > 0.4::DOUBLE AND max(value) - min(value) > 0.2::DOUBLE""",
    derived=True,
)
def root_pair(spark, sf):
    return builders.root_pair(stage(_edges(spark, sf), "edges")).select("task_id", "chosen", "rejected", _r("distance").alias("distance"))


@query(
    """WITH w AS (SELECT *, 100 AS cap FROM parts)
SELECT conv_id, round(CASE WHEN offence IS DISTINCT FROM 'name' AND lower(coalesce(final_answer, '')) IN (lower(answer)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN is_large OR token_count <= 40 THEN -1.0::DOUBLE ELSE (-0.5)::DOUBLE * token_count / cap END + CASE WHEN NOT judged THEN -1.0::DOUBLE WHEN offence IS NOT NULL THEN 0.0::DOUBLE ELSE 0.6::DOUBLE / max_loss END, 9) AS effective_reward, 0.0::DOUBLE AS name_penalty FROM w""",
    derived=True,
)
def search_reward(spark, sf):
    return scoring.search_reward(fixture.trajectories(spark, sf), 100).select("conv_id", _r("effective_reward").alias("effective_reward"), "name_penalty")


def _length_loss(texts: list[str]) -> list[float]:
    return [1.0 + len(t) % 7 / 10.0 for t in texts]


@query("SELECT conv_id, round(sum(1.0::DOUBLE + (length('<|user|>' || chr(10) || '</s>' || chr(10) || '<|assistant|>' || chr(10) || content || '</s>' || chr(10)) % 7) / 10.0::DOUBLE), 6) AS loss, count(*) AS n FROM turns GROUP BY conv_id", derived=True)
def loss_provider(spark, sf):
    out = scoring.with_losses(fixture.trajectories(spark, sf).drop("losses"), _length_loss, merge_system=True)
    return out.select("conv_id", _r(F.aggregate("losses", F.lit(0.0), lambda a, x: a + x), 6).alias("loss"), F.size("losses").cast("long").alias("n"))


@query("SELECT conv_id, CAST(sum(CASE WHEN pos % 2 = 0 THEN token_count ELSE length(content) END) + CASE WHEN any_value(is_large) THEN CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 5 END ELSE 0 END AS BIGINT) AS tokens FROM (SELECT t.conv_id, t.pos, t.token_count, t.content, j.is_large FROM turns t JOIN traj j USING (conv_id)) GROUP BY conv_id", derived=True)
def alternating_count(spark, sf):
    letters = lambda t: F.split(t, "")
    return fixture.trajectories(spark, sf).select("conv_id", X.alternating_count(F.col("conversation"), (X.tokens, letters)).cast("long").alias("tokens"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 < floor(0.3::DOUBLE * count(*) OVER (PARTITION BY source))")
def first_rows(spark, sf):
    return selection.first_rows(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", share=0.3, by="source").select("doc_id")


@query(
    """WITH e AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY event_id))
SELECT event_id, CAST(sum(new) OVER (ORDER BY event_id) AS BIGINT) AS island FROM e"""
)
def islands_of_all(spark, sf):
    return compose.islands(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", F.col("island").cast("long").alias("island"))


# Text


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS spaced, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS tokens,
coalesce(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), ''), text) AS number, trim(trim(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), 'm='), 'm =') AS f1_text,
regexp_replace(left(text, CAST(coalesce(nullif(least(coalesce(nullif(instr(text, ' of '), 0), 1000000000), coalesce(nullif(instr(text, '.'), 0), 1000000000)), 1000000000), length(text) + 1) - 1 AS BIGINT)), CASE WHEN instr(text, ' of ') > 0 OR instr(text, '.') > 0 THEN '\s+$' ELSE 'a^' END, '') AS trimmed,
trim(trim(text, 'Alice:'), 'Bob:') AS legacy FROM documents"""
)
def text_scalars(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.single_spaced(t).alias("spaced"), X.token_count(t).alias("tokens"), X.first_number(t).alias("number"), X.f1_text(t).alias("f1_text"), X.trim_at(t, [" of ", "."]).alias("trimmed"), X.strip_speaker_legacy(t).alias("legacy"))


@query("SELECT p_partkey, replace(replace('Hello ${name}, ask ${partner} about ${other}', '${name}', p_name), '${partner}', p_brand) AS text FROM part")
def fill_template(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.fill_template(F.lit("Hello ${name}, ask ${partner} about ${other}"), name=F.col("p_name"), partner=F.col("p_brand")).alias("text"))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) / (greatest(length(a.p_name), length(b.p_name)) + 1.0::DOUBLE) AS both, levenshtein(a.p_name, b.p_name) / (length(b.p_name) + 1.0::DOUBLE) AS new FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_shares(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return a.join(b, "p_partkey").select("p_partkey", X.edit_share(F.col("p_name"), F.col("next")).alias("both"), X.edit_share_new(F.col("p_name"), F.col("next")).alias("new"))


def _answers(spark, sf):
    a = F.col("p_size").cast("string")
    wrapped = F.concat(F.lit("so x = \\boxed{\\frac{"), a, F.lit("}{2}} dollars"))
    return table(spark, sf, "part").select("p_partkey", "p_size", wrapped.alias("solution"))


@query(r"SELECT p_partkey, '\frac{' || p_size || '}{2}' AS boxed, '\frac{' || p_size || '}{2}' AS normal FROM part")
def boxed_parse(spark, sf):
    return _answers(spark, sf).select("p_partkey", latex.boxed_answer(F.col("solution")).alias("boxed"), X.normalize_answer(F.col("solution")).alias("normal"))


@query("SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def latex_equiv(spark, sf):
    half = F.floor(F.col("p_size") / 2).cast("string")
    return _answers(spark, sf).select("p_partkey", latex.latex_equal(latex.boxed_answer(F.col("solution")), half).alias("same"))


def _forms(spark, sf):
    """An answer of each part, in one of eight forms: quotients, sums, roots."""
    n, m = F.col("p_size").cast("string"), (F.col("p_partkey") % 7 + 1).cast("string")
    times = lambda c, k: (c.cast("int") * k).cast("string")
    forms = [
        F.concat(F.lit("\\frac{"), n, F.lit("}{"), m, F.lit("}")),
        F.concat(n, F.lit("/"), m),
        F.concat(F.lit("$\\dfrac{"), times(n, 2), F.lit("}{"), times(m, 2), F.lit("}$")),
        F.concat(n, F.lit(" \\cdot \\frac{1}{"), m, F.lit("}")),
        F.concat(F.lit("x+"), n),
        F.concat(n, F.lit(" + x")),
        F.concat(F.lit("\\sqrt{"), (m.cast("int") * m.cast("int") * 3).cast("string"), F.lit("}")),
        F.concat(m, F.lit("\\sqrt{3}")),
    ]
    return table(spark, sf, "part").select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 8).cast("int")).alias("answer"))


@query(
    """WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 7 + 1 AS m, p_partkey % 8 AS form FROM part)
SELECT CAST(min(p_partkey) AS BIGINT) AS first_id, count(*) AS answers FROM (SELECT p_partkey, CASE WHEN form < 4 THEN 'q' || CAST(n // gcd(n, m) AS VARCHAR) || '/' || CAST(m // gcd(n, m) AS VARCHAR) WHEN form < 6 THEN 'x' || CAST(n AS VARCHAR) ELSE 'r' || CAST(m AS VARCHAR) END AS class FROM p) GROUP BY class"""
)
def maths_classes(spark, sf):
    return _forms(spark, sf).groupBy(latex.answer_key(F.col("answer")).alias("key")).agg(F.min("p_partkey").cast("long").alias("first_id"), F.count("*").alias("answers")).drop("key")


@query(
    r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '\frac{' || p_size || '}{\sqrt{2}}' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN p_name ELSE '{' || p_size || '}' END AS boxed FROM part"""
)
def boxed_variants(spark, sf):
    """Nested braces, \\fbox, none, one that does not close, the last of two, a box without braces around it."""
    n = F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("\\boxed{1} or \\boxed{\\frac{"), n, F.lit("}{\\sqrt{2}}} {")),
        F.concat(F.lit("so \\fbox{"), n, F.lit("}.")),
        F.concat(F.lit("it is "), n),
        F.concat(F.lit("so \\boxed{"), n),
        F.concat(F.lit("$\\boxed "), F.col("p_name"), F.lit("$ as said")),
        F.concat(F.lit("\\boxed{{"), n, F.lit("}}")),
    ]
    return table(spark, sf, "part").select("p_partkey", latex.boxed_answer(F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int"))).alias("boxed"))


@query(
    """WITH w AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
k AS (SELECT x.id, 1 + CASE WHEN x.a = y.a AND x.b = y.b THEN 2 WHEN x.a = y.a OR x.b = y.b OR x.a = y.b OR x.b = y.a THEN 1 ELSE 0 END AS n FROM w x JOIN w y ON y.id = x.id + 1)
SELECT id AS p_partkey, round(2 * (n / 3.0::DOUBLE) * (n / 3.0::DOUBLE) / (2 * (n / 3.0::DOUBLE) + 1e-8::DOUBLE), 9) AS score FROM k"""
)
def rouge_summary(spark, sf):
    """Two sentences in either order: the common words are those of both pairs of sentences."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("said"))
    gold, said = F.concat("p_name", F.lit(". yes")), F.concat(F.lit("yes.  "), "said", F.lit("."))
    return parts.join(after, "p_partkey").select("p_partkey", _r(X.rouge_l(gold, said)).alias("score"))


@query(
    """WITH g AS (SELECT task_id, trajectory_id AS pos, coalesce(final_answer, '') AS final_answer, coalesce(final_answer, 'none ' || trajectory_id) AS own FROM traj),
k AS (SELECT task_id, own, count(*) AS n, min(pos) AS first FROM g GROUP BY ALL), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC, first) = 1)
SELECT g.task_id, g.pos, g.final_answer FROM g JOIN c USING (task_id, own)""",  # single letters are alike only if equal
    derived=True,
)
def f1_cluster(spark, sf):
    return replay.cluster_by_f1(fixture.trajectories(spark, sf).select("task_id", F.col("trajectory_id").alias("pos"), F.coalesce("final_answer", F.lit("")).alias("final_answer")))


# Loaders, over sources made from the test tables


@query(
    r"""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS q, array_agg(l_returnflag || l_linenumber ORDER BY l_linenumber, l_returnflag) AS sentences FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, q || chr(10) || 'Please choose your answer from [''R'', ''it''''s'', ''a"b''] ' AS question, array_to_string(sentences[1 : len(sentences) // 2], '|') AS first, array_to_string(sentences[len(sentences) // 2 + 1 :], '|') AS second FROM s""".replace("''it''''s''", '"it\'\'s"')
)
def load_cbt(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("s")))).alias("x"))
    source = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("id")).select("id", F.col("o_orderpriority").alias("question"), F.array(F.lit("R"), F.lit("it's"), F.lit('a"b')).alias("options"), F.lit("R").alias("answer"), F.transform("x", lambda v: v["s"]).alias("sentences"))
    return datasets.cbt(source).select("id", "question", F.array_join("context_first", "|").alias("first"), F.array_join("context_second", "|").alias("second"))


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS answer FROM part")
def load_gsm8k(spark, sf):
    source = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.concat(F.lit("think #### "), F.col("p_size").cast("string"), F.lit(" \n")).alias("answer"))
    return datasets.gsm8k(source).select("id", F.get("answers", F.lit(0)).alias("answer"))


@query(r"SELECT p_partkey AS id, '\frac{' || p_size || '}{2}' AS answer FROM part")
def load_math(spark, sf):
    source = _answers(spark, sf).select(F.col("p_partkey").alias("id"), F.col("solution").alias("problem"), "solution")
    return datasets.math(source).select("id", F.get("answers", F.lit(0)).alias("answer"))


def _choices(spark, sf):
    texts = F.array(F.col("p_name"), F.col("p_brand"), F.col("p_type"))
    question = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 100).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), question.alias("question"), texts.alias("texts"), (F.col("p_size") % 3).alias("nth"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS answer FROM part")
def load_arc(spark, sf):
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    source = _choices(spark, sf).select("id", "question", F.struct(F.col("texts").alias("text"), labels.alias("label")).alias("choices"), F.get(labels, F.col("nth")).alias("answerKey"))
    return datasets.arc(source).select("id", F.get("answers", F.lit(0)).alias("answer"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS answer, md5('42|' || p_partkey) AS order_key FROM part WHERE p_name || ' ' || (p_partkey % 100) NOT IN (SELECT p_name || ' ' || (p_partkey % 100) FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 50)")
def load_mmlu(spark, sf):
    source = _choices(spark, sf).select("id", "question", F.col("texts").alias("choices"), F.col("nth").alias("answer"))
    other = source.join(table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50").select(F.col("l_partkey").alias("id")).distinct(), "id")
    return datasets.mmlu(source, other).select("id", F.get("answers", F.lit(0)).alias("answer"), "order_key")


@query(
    """WITH e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'd' || l_partkey) - 1 AS nth, 'd' || l_partkey AS d FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42|' || id || '|' || CAST(nth AS VARCHAR))) - 1 AS place FROM e)
SELECT id, coalesce(string_agg(CASE WHEN place % 2 = 0 THEN d END, '|' ORDER BY place), '') AS first, coalesce(string_agg(CASE WHEN place % 2 = 1 THEN d END, '|' ORDER BY place), '') AS second FROM r GROUP BY id"""
)
def load_trivia(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("d")))).alias("x"))
    source = lines.select("id", F.lit("q").alias("question"), F.struct(F.array(F.lit("a"), F.lit("b")).alias("aliases")).alias("answer"), F.struct(F.transform("x", lambda v: v["d"]).alias("description")).alias("search_results"))
    return datasets.trivia_qa(source).select("id", F.array_join("context_first", "|").alias("first"), F.array_join("context_second", "|").alias("second"))


def _wiki(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    title = lambda k: F.concat(F.lit("t"), k.cast("string"))
    context = F.transform("x", lambda v, k: F.struct(title(k).alias("title"), F.array(v["l_returnflag"], v["l_partkey"].cast("string")).alias("sentences")))
    return lines.select("id", F.lit("q").alias("question"), F.lit("a").alias("answer"), context.alias("context"), F.transform(F.slice("x", F.lit(1), F.lit(3)), lambda v, k: F.struct(title(k).alias("title"), F.lit(0).alias("idx"))).alias("supporting_facts"))


_WIKI_SQL = """WITH l AS (SELECT l_orderkey, l_returnflag AS a, l_partkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS seat FROM lineitem),
e AS (SELECT l_orderkey AS id, 't' || (seat - 1) AS title, a, b, seat FROM l),
m AS (SELECT *, seat <= 3 AS sup, md5('42|' || id || '|' || title) AS mark FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY id, sup ORDER BY {order}) - 1 AS nth FROM m),
s AS (SELECT *, CASE WHEN sup THEN nth % 2 ELSE CAST('0x' || left(mark, 1) AS INTEGER) % 2 END AS side, title || ': ' || a || {joint} || b || chr(10) AS p FROM n)
SELECT id, coalesce(string_agg(CASE WHEN side = 0 THEN p END, '|' ORDER BY NOT sup, CASE WHEN sup THEN nth ELSE seat END), '') AS first, coalesce(string_agg(CASE WHEN side = 1 THEN p END, '|' ORDER BY NOT sup, CASE WHEN sup THEN nth ELSE seat END), '') AS second FROM s GROUP BY id"""


@query(_WIKI_SQL.format(order="seat", joint="''"))
def load_two_wiki(spark, sf):
    return datasets.two_wiki(_wiki(spark, sf)).select("id", F.array_join("context_first", "|").alias("first"), F.array_join("context_second", "|").alias("second"))


@query(_WIKI_SQL.format(order="mark, seat", joint="' '"))
def load_hotpot(spark, sf):
    source = _wiki(spark, sf).withColumns({"context": F.struct(F.transform("context", lambda c: c["title"]).alias("title"), F.transform("context", lambda c: c["sentences"]).alias("sentences")), "supporting_facts": F.struct(F.transform("supporting_facts", lambda c: c["title"]).alias("title"))})
    return datasets.hotpot_qa(source).select("id", F.array_join("context_first", "|").alias("first"), F.array_join("context_second", "|").alias("second"))


# Task lines: written, added to, replaced, read back, and scored as they arrive


def _recorded(spark, sf):
    """The fixture's trajectories as task lines have them."""
    return fixture.trajectories(spark, sf).select(F.col("task_id").cast("int").alias("task_id"), F.col("trajectory_id").cast("int").alias("trajectory_id"), F.col("answers").alias("answer"), "conversation", "final_answer", "termination_reason", "score_type", F.col("token_count").cast("int").alias("token_count"), F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["content"].alias("content"))).alias("turns"))


def _own_folder(spark, name):
    return f"{shared_dir(spark)}/turnmill/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT task_id, trajectory_id, answer AS gold, final_answer, termination_reason, token_count, n_turns, said
FROM traj JOIN (SELECT conv_id, count(*) AS n_turns, md5(string_agg(speaker || '|' || content, '|' ORDER BY pos)) AS said FROM turns GROUP BY conv_id) USING (conv_id)""",
    derived=True,
)
def task_lines_round_trip(spark, sf):
    rows, path = stage(_recorded(spark, sf), "recorded"), _own_folder(spark, "task-lines")
    tasks.publish_tasks(rows.where("task_id % 3 = 0").withColumn("final_answer", F.lit("replaced below")), path)
    tasks.publish_tasks(rows, path, replace=True, token="all")
    tasks.publish_tasks(rows.withColumn("final_answer", F.lit("there already")), path)
    back = tasks.trajectories(tasks.published_tasks(spark, path))
    said = F.md5(F.array_join(F.flatten(F.transform("turns", lambda t: F.array(t["speaker"], t["content"]))), "|"))
    gold = F.get(tasks.gold_answers(F.col("answer"))[0], F.lit(0))
    long = lambda c: F.col(c).cast("long").alias(c)
    return back.select(long("task_id"), long("trajectory_id"), gold.alias("gold"), "final_answer", "termination_reason", long("token_count"), F.size("turns").cast("long").alias("n_turns"), said.alias("said"))


@query("SELECT task_id, trajectory_id, correct_score, round(token_score, 9) AS token_score FROM scored", derived=True)
def incremental_scores(spark, sf):
    rows, path = stage(_recorded(spark, sf), "recorded"), _own_folder(spark, "arriving")
    for part in ("task_id % 2 = 0", "task_id % 3 < 2", "true"):  # tasks come again with each part
        tasks.write_tasks(rows.where(part), f"{path}/in/{uuid.uuid4().hex}")

        def score(df):
            answers, is_list = tasks.gold_answers(F.col("answer"))
            ready = df.drop("correct_score", "token_score", "ppl_score", "reward").withColumns({"answers": answers, "answer_is_list": is_list, "losses": F.array(F.lit(1.0))})
            return scoring.score(ready, maths=False)

        incremental.score_stream(incremental.stream_tasks(spark, f"{path}/in/*"), f"{path}/out", f"{path}/progress", score).awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("task_id").cast("long").alias("task_id"), F.col("trajectory_id").cast("long").alias("trajectory_id"), "correct_score", _r("token_score").alias("token_score"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, role, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: length(x) + 10) AS w FROM conversations WHERE role <> 'system'),
p AS (SELECT *, CAST(1 + coalesce(sum(len(w) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins, (role = 'user') = (conv_id % 2 = 0) AS own FROM s),
ids AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 5 + conv_id % 2 AS id FROM (SELECT DISTINCT conv_id FROM s) UNION ALL
  SELECT conv_id, begins + j - 1 AS i, list_concat(CASE WHEN role = 'user' THEN [1, 2] ELSE [3, 4] END, w)[j] AS id FROM (SELECT *, unnest(generate_series(1, len(w) + 2)) AS j FROM p)),
r AS (SELECT conv_id, begins + 2 AS reply, row_number() OVER (PARTITION BY conv_id ORDER BY begins) AS k FROM p WHERE own),
o0 AS (SELECT conv_id, begins AS other FROM p WHERE NOT own),
o AS (SELECT conv_id, other, row_number() OVER (PARTITION BY conv_id ORDER BY other) AS k FROM (SELECT * FROM o0 UNION ALL
  SELECT conv_id, 0 FROM (SELECT conv_id, min(other) AS other FROM o0 GROUP BY conv_id) JOIN r USING (conv_id) WHERE k = 1 AND other > reply)),
z AS (SELECT conv_id, CASE WHEN k = 1 THEN 0 ELSE other END AS a, reply AS b FROM o JOIN r USING (conv_id, k) UNION ALL
  SELECT conv_id, other, 1000000000 FROM (SELECT conv_id, max(other) AS other, count(*) AS n FROM o GROUP BY conv_id) LEFT JOIN (SELECT conv_id, count(*) AS m FROM r GROUP BY conv_id) USING (conv_id) WHERE coalesce(m, 0) < n),
l AS (SELECT i.conv_id, i.i, CASE WHEN EXISTS (SELECT 1 FROM z WHERE z.conv_id = i.conv_id AND i.i >= z.a AND i.i < z.b) THEN -100 ELSE i.id END AS label FROM ids i)
SELECT conv_id, count(*) AS n_ids, count(*) FILTER (label <> -100) AS n_kept, md5(string_agg(label, ',' ORDER BY i)) AS labels FROM l GROUP BY conv_id"""
)
def reply_labels(spark, sf):
    said = table(spark, sf, "conversations").where("role <> 'system'")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    marker = lambda role: F.when(role == "user", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))
    turn = lambda t: F.concat(marker(t["role"]), F.transform(X.tokens(t["text"]), lambda w: F.length(w) + 10))
    ids = said.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.concat(F.array((5 + F.col("conv_id") % 2).cast("int")), F.flatten(F.transform("t", turn))).alias("ids"))
    out = ids.withColumn("labels", chat.label_replies(F.col("ids"), [1, 2], [3, 4], [5], [6]))
    kept = F.size(F.filter("labels", lambda x: x != -100))
    return out.select("conv_id", F.size("ids").cast("long").alias("n_ids"), kept.cast("long").alias("n_kept"), F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), ",")).alias("labels"))
