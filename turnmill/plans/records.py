"""Queries that write records and read them back, and those of single text, scoring and tree rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import text as X
from turnmill.operators import analysis, builders, compose, pairs, quality, replay, scoring, selection
from turnmill.operators.quantiles import exact_quantiles
from turnmill.sources import datasets, tasks
from turnmill.staging import stage

from . import fixture
from . import queries as base
from .fixture import table
from .register import query

_r, _own_folder = base._r, base._own_folder


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# Files written and read back


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 3)
SELECT CAST(p_partkey AS BIGINT) AS task_id, CAST(k AS BIGINT) AS trajectory_id, p_name AS final_answer, CAST(p_size + k AS BIGINT) AS token_count FROM p, (SELECT unnest([0, 1]) AS k) WHERE p_partkey % 10 <> 4"""
)
def task_line_scan(spark, sf):
    """Lines of parts, of which some are cut off (no JSON) and some have no results."""
    one = lambda k: F.struct(F.col("p_partkey").cast("int").alias("task_id"), F.lit(k).alias("trajectory_id"), F.col("p_name").alias("final_answer"), (F.col("p_size") + k).alias("token_count"))
    results = F.when(F.col("p_partkey") % 10 != 4, F.array(one(0), one(1))).otherwise(F.array().cast("array<struct<task_id:int,trajectory_id:int,final_answer:string,token_count:int>>"))
    line = F.to_json(F.struct(F.col("p_partkey").alias("task_id"), results.alias("results")))
    cut = F.when(F.col("p_partkey") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    path = _own_folder(spark, "lines")
    table(spark, sf, "part").select(cut.alias("value")).write.text(path)
    back = tasks.trajectories(tasks.read_tasks(spark, path))
    return back.select(_long("task_id"), _long("trajectory_id"), "final_answer", _long("token_count"))


@query(
    r"""SELECT CAST(p_partkey AS BIGINT) AS "index", CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN chr(10) || p_name || chr(10) || p_brand WHEN 2 THEN '' ELSE '' END AS prompt FROM part"""
)
def prompt_pool(spark, sf):
    """Prompts with two elements, with line breaks inside, without an end, without any."""
    forms = [
        F.concat(F.lit("Say <p>"), "p_name", F.lit("</p> or <p>"), "p_brand", F.lit("</p>")),
        F.concat(F.lit("<p>\n"), "p_name", F.lit("\n"), "p_brand", F.lit("</p> \n")),
        F.concat(F.lit("<p>"), "p_name"),
        F.col("p_name"),
    ]
    path = _own_folder(spark, "prompts")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.get(F.array(*forms), (F.col("p_partkey") % 4).cast("int")).alias("prompt"))
    rows.write.json(path)
    return tasks.prompt_pool(spark, path).select(_long("index"), "prompt")


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1 < floor(0.9::DOUBLE * count(*) OVER (PARTITION BY lang)) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_folders(spark, sf):
    """Each language's train and test rows in folders of their own, read back."""
    path = _own_folder(spark, "splits")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    tasks.write_splits(selection.split_rows(docs, "42", "doc_id", 0.9, partition=["lang"]), path, ("lang", "split"))
    return spark.read.parquet(path).select("doc_id", "lang", "split")


@query("SELECT doc_id, source, 1 + CAST(doc_id % 3 = 0 AS INTEGER) AS lines FROM documents")
def appended_lines(spark, sf):
    """Lines added in two runs; readers find both."""
    path, docs = _own_folder(spark, "appended"), table(spark, sf, "documents").select("doc_id", "source")
    tasks.append_lines(docs, path)
    tasks.append_lines(docs.where("doc_id % 3 = 0"), path)
    back = spark.read.schema("doc_id long, source string").json(path)
    return back.groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("lines"))


@query(
    """WITH s AS (SELECT p_brand, count(*) AS parts, round(avg(p_size), 4) AS mean_size FROM part GROUP BY p_brand)
SELECT format, p_brand, parts, printf('%.4f', mean_size) AS mean_size FROM s, (SELECT unnest(['json', 'csv', 'markdown']) AS format)"""
)
def report_files(spark, sf):
    """A summary as JSON, CSV and Markdown, each read back."""
    path = _own_folder(spark, "reports")
    summary = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.round(F.avg("p_size"), 4).alias("mean_size"))
    tasks.write_reports(stage(summary, "summary"), path, "Parts")
    shape = "p_brand string, parts long, mean_size double"
    as_text = F.format_string("%.4f", "mean_size").alias("mean_size")
    typed = lambda name, df: df.select(F.lit(name).alias("format"), "p_brand", "parts", as_text)
    cells = F.split(F.col("value"), r" \| ")
    lines = spark.read.text(f"{path}/markdown").where("value like '| Brand%'").select(F.transform(cells, lambda c: F.btrim(c, F.lit("| "))).alias("c"))
    markdown = lines.select(F.lit("markdown").alias("format"), F.get("c", F.lit(0)).alias("p_brand"), F.get("c", F.lit(1)).cast("long").alias("parts"), F.get("c", F.lit(2)).alias("mean_size"))
    return typed("json", spark.read.schema(shape).json(f"{path}/json")).unionByName(typed("csv", spark.read.schema(shape).option("header", True).csv(f"{path}/csv"))).unionByName(markdown)


@query(
    """WITH told AS (SELECT conv_id, string_agg(chr(10) || '[' || (pos + 1) || '] ' || speaker || ': ' || content || chr(10) || '(' || token_count || ' tokens, answer ' || coalesce(parsed_answer, 'none') || ', finish none)', chr(10) ORDER BY pos) AS said FROM turns GROUP BY conv_id)
SELECT task_id, trajectory_id, printf('task_%05d_traj_%02d.txt', task_id, trajectory_id) AS name, md5(concat_ws(chr(10), 'Task ' || task_id || ', trajectory ' || trajectory_id, 'Data: exact-match', 'Gold answer: ' || answer, 'Answer: ' || final_answer, 'Ended: ' || termination_reason, 'Tokens: ' || token_count, said, CASE WHEN is_large THEN chr(10) || '(a turn went over the limit)' END)) AS text
FROM traj JOIN told USING (conv_id)""",
    derived=True,
)
def transcript_texts(spark, sf):
    each = fixture.turns(spark, sf)
    turn = F.struct("pos", "speaker", "content", "token_count", "parsed_answer", F.lit(None).cast("string").alias("finish_reason"))
    told = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = fixture.trajectories(spark, sf).drop("turns").join(told, "conv_id")
    out = tasks.transcripts(rows)
    return out.select(_long("task_id"), _long("trajectory_id"), "name", F.md5("text").alias("text"))


@query(
    """WITH m AS (SELECT s.conv_id, s.task_id, s.trajectory_id, c.conv_id IS NOT NULL AS selected, t.content FROM scored s LEFT JOIN chosen c USING (conv_id) JOIN turns t ON t.conv_id = s.conv_id AND t.pos = 0)
SELECT conv_id, selected, CASE WHEN length(content) > 60 THEN left(replace(content, chr(10), ' '), 60) || ' …' ELSE replace(content, chr(10), ' ') END AS content FROM m QUALIFY row_number() OVER (PARTITION BY selected ORDER BY task_id, trajectory_id) <= 3""",
    derived=True,
)
def sample_rows(spark, sf):
    """The first three trajectories that were selected, and that were not: a listing."""
    rows = base._marked(spark, sf).select("conv_id", "task_id", "trajectory_id", "selected", F.get("turns", F.lit(0))["content"].alias("content"))
    return tasks.sample_listing(rows, ["task_id", "trajectory_id"], 3, 60, "selected").select("conv_id", "selected", "content")


@query(
    "SELECT CAST(row_number() OVER (ORDER BY coalesce(task, -1), coalesce(n, -1)) - 1 AS BIGINT) AS place, task AS task_id, n AS trajectory_id FROM (SELECT CASE WHEN conv_id // 4 <> 2 THEN conv_id // 4 END AS task, CASE WHEN conv_id % 4 <> 1 THEN conv_id % 4 END AS n FROM traj)",
    derived=True,
)
def lines_in_order(spark, sf):
    """The places of trajectories in written task lines: by file, line and place in the line; those without an id come first."""
    rows, path = base._recorded(spark, sf), _own_folder(spark, "ordered")
    gaps = rows.withColumns({"task_id": F.when(F.col("task_id") != 2, F.col("task_id")), "trajectory_id": F.when(F.col("trajectory_id") != 1, F.col("trajectory_id"))})
    tasks.write_tasks(gaps, path)
    lines = tasks.read_tasks(spark, path).select("results", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    each = lines.select("file", "block", "line", F.posexplode("results").alias("nth", "r")).select(F.struct("file", "block", "line", "nth").alias("at"), "r.task_id", "r.trajectory_id")
    return selection.numbered(each, "at", [], [], "place", "_all").select("place", _long("task_id"), _long("trajectory_id"))


@query(
    """WITH one AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 5 = 0) AS no_rank, count(*) FILTER (p_partkey % 7 = 0) AS no_reward, count(*) FILTER (p_partkey % 13 = 0) AS no_selected FROM part WHERE p_partkey % 11 <> 0)
SELECT 'field_reward' AS "check", CASE WHEN no_reward = 0 THEN 'PASS' ELSE 'FAIL' END AS status, no_reward::DOUBLE AS value FROM one
UNION ALL SELECT 'field_rank', CASE WHEN no_rank = 0 THEN 'PASS' ELSE 'FAIL' END, no_rank::DOUBLE FROM one
UNION ALL SELECT 'field_selected', CASE WHEN no_selected = 0 THEN 'PASS' ELSE 'FAIL' END, no_selected::DOUBLE FROM one"""
)
def fields_of_lines(spark, sf):
    """Fields that results of raw lines lack; a null rank is there; some lines are no JSON."""
    key = F.col("p_partkey")
    fields = F.concat_ws(",", F.when(key % 13 != 0, F.lit('"selected":false')), F.when(key % 5 != 0, F.when(key % 3 == 0, '"rank":null').otherwise('"rank":1')), F.when(key % 7 != 0, F.lit('"reward":0.5')))
    line = F.concat(F.lit('{"task_id":'), key.cast("string"), F.lit(',"results":[{'), fields, F.when(key % 11 != 0, F.lit("}]}")).otherwise("}"))
    path = _own_folder(spark, "fields")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return quality.field_checks(spark.read.text(path), ["reward", "rank", "selected"])


# Rules of texts


@query(
    r"""WITH s AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'Alice' ELSE 'Bob' END AS speaker, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' Alice: ' ELSE 'Bob ' END || text AS said, CASE WHEN turn % 5 = 0 THEN 'qa' ELSE 'debate' END AS kind FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN kind = 'debate' AND NOT regexp_matches(said, '^\s*' || speaker) THEN speaker || ':' || said ELSE said END) AS said FROM s"""
)
def speaker_prefix(spark, sf):
    said = F.concat(F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, " Alice: ").otherwise("Bob "), F.col("text"))
    rows = table(spark, sf, "conversations").withColumns({"speaker": F.when(F.col("conv_id") % 2 == 0, "Alice").otherwise("Bob"), "said": said, "kind": F.when(F.col("turn") % 5 == 0, "qa").otherwise("debate")})
    return rows.select("conv_id", "turn", F.md5(X.add_speaker(F.col("said"), F.col("speaker"), F.col("kind"))).alias("said"))


@query(
    r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1. ' || p_name || chr(10) || '3. ' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_name || chr(10) || 'You must begin your response with "${name}:".' ELSE '' END AS prompt FROM part"""
)
def name_instruction(spark, sf):
    """Templates with either line, one at the end, one without its number (which stays), and nothing else."""
    must, should = '2. You must begin your response with "${name}:".', ' 12.  You should start your utterance with "${name}:". '
    forms = [
        F.concat(F.lit("1. "), "p_name", F.lit(f"\n{must}\n3. "), "p_type"),
        F.concat("p_name", F.lit(f"\n{should}\n")),
        F.concat("p_name", F.lit("\n" + must[3:])),
        F.lit(f"{must}\n{should}"),
    ]
    return table(spark, sf, "part").select("p_partkey", X.drop_name_instruction(F.get(F.array(*forms), (F.col("p_partkey") % 4).cast("int"))).alias("prompt"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_brand END AS told FROM part")
def docstrings(spark, sf):
    """One docstring, the second of two, one in single quotes, three marks, none."""
    double, single = '"""', "'''"
    forms = [
        F.concat(F.lit(f"def f():\n  {double} "), "p_name", F.lit(f"\n  {double}\n  '''x'''")),
        F.concat(F.lit(f"def g(): {double}"), "p_name", F.lit(f"{double}\ndef f(): {double}"), "p_type", F.lit(double)),
        F.concat(F.lit(f"def f(): {single}\n"), "p_brand", F.lit(single)),
        F.concat(F.lit(f"{double}"), "p_name", F.lit(f"{double} {double}")),
        F.col("p_name"),
    ]
    return table(spark, sf, "part").select("p_partkey", X.docstring(F.get(F.array(*forms), (F.col("p_partkey") % 5).cast("int"))).alias("told"))


@query("SELECT doc_id, lang AS language, n_chars FROM documents")
def projected_columns(spark, sf):
    """Some columns, one of them under another name, and one that is not there."""
    return compose.project(table(spark, sf, "documents"), ["doc_id", "lang", "n_chars", "score"], {"lang": "language"})


_PHASES = ["hotpot_qa", "mwh_qa", "trival_qa", "mmlu", "arc"]


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'validation' END WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'dev' END WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'validation' END WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END END AS split FROM part")
def split_names(spark, sf):
    """The split that a phase reads of each row's dataset; one has no entry."""
    name = F.get(F.array(*[F.lit(x) for x in _PHASES]), F.col("p_size") % 5)
    phase = F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("test")
    return table(spark, sf, "part").select("p_partkey", datasets.split_name(name, phase).alias("split"))


# Scores and reports


_LOGPROBS_SQL = r"""WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: (length(x) % 7) / 10.0::DOUBLE) AS l FROM conversations)"""


def _token_losses():
    return F.transform(X.tokens(F.col("text")), lambda w: (F.length(w) % 7) / 10.0)


@query(
    _LOGPROBS_SQL + " SELECT conv_id, round(0.6::DOUBLE / max(CASE WHEN len(l) > 1 THEN exp(list_sum(l[2:]) / (len(l) - 1)) END), 9) AS ppl_score FROM w GROUP BY conv_id"
)
def perplexities(spark, sf):
    """The oldest fluency term over the log probabilities of each conversation's words."""
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.transform(_token_losses(), lambda x: -x)).alias("sentences"))
    return each.select("conv_id", _r(scoring.perplexity_score(F.col("sentences"))).alias("ppl_score"))


@query(
    _LOGPROBS_SQL
    + """, z AS (SELECT conv_id, turn, list_filter(l, lambda x: x <> 0) AS a, list_filter(l[5:], lambda x: x <> 0) AS b FROM w)
SELECT conv_id, turn, round(list_sum(a) / nullif(len(a), 0), 9) AS loss, round(list_sum(b) / nullif(len(b), 0), 9) AS legacy_loss FROM z"""
)
def mean_losses(spark, sf):
    """Mean losses of texts from those of their tokens, by the current rule and by the older one, which begins later."""
    losses = _token_losses()
    return table(spark, sf, "conversations").select("conv_id", "turn", _r(scoring.mean_loss(losses)).alias("loss"), _r(scoring.mean_loss(losses, "legacy")).alias("legacy_loss"))


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5::DOUBLE), 6) AS half, round(quantile_cont(l_extendedprice, 0.85::DOUBLE), 6) AS most, round(quantile_cont(l_extendedprice, 0.999::DOUBLE), 6) AS nearly_all FROM lineitem GROUP BY ALL")
def price_quantiles(spark, sf):
    out = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"half": 0.5, "most": 0.85, "nearly_all": 0.999}, ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", *[_r(c, 6).alias(c) for c in ("half", "most", "nearly_all")])


@query("SELECT quantile_cont(l_quantity, 0.5::DOUBLE) AS half, quantile_cont(l_quantity, 0.01::DOUBLE) AS low FROM lineitem")
def quantity_quantiles(spark, sf):
    """Values with very many ties, over the whole table."""
    return exact_quantiles(table(spark, sf, "lineitem"), "l_quantity", {"half": 0.5, "low": 0.01})


@query("SELECT l_partkey, n, CAST(row_number() OVER (ORDER BY n DESC, l_partkey) - 1 AS BIGINT) AS place FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def most_common_parts(spark, sf):
    return analysis.most_common(table(spark, sf, "lineitem"), "l_partkey").select("l_partkey", "n", "place")


@query(
    "SELECT conv_id, task_id, round(effective_reward, 9) AS effective_reward, CAST(place - floor(0.2::DOUBLE * total) AS BIGINT) AS rank FROM placed WHERE place >= floor(0.2::DOUBLE * total) AND place < floor(0.8::DOUBLE * total) AND effective_reward >= 0.1::DOUBLE",
    derived=True,
)
def select_middle_window(spark, sf):
    """A window that leaves out both ends, ranked from 0."""
    out = selection.select_trajectories(fixture.scored(spark, sf), 0.2, 0.8, 0.1)
    return out.select("conv_id", "task_id", _r("effective_reward").alias("effective_reward"), _long("rank"))


# Trees

# Leaders of up to four rollouts of a task, level by level: the first earlier rollout at the same node that
# leads one of its children and whose content is close, else the rollout itself.
_REPLAY_SQL = """, said AS (SELECT task, depth, max(CASE WHEN k = 0 THEN c END) AS c0, max(CASE WHEN k = 1 THEN c END) AS c1, max(CASE WHEN k = 2 THEN c END) AS c2, max(CASE WHEN k = 3 THEN c END) AS c3 FROM spoken GROUP BY ALL),
close AS (SELECT task, depth, c0, c1, c2, c3, {near01} AS n01, {near02} AS n02, {near03} AS n03, {near12} AS n12, {near13} AS n13, {near23} AS n23 FROM said),
led AS (SELECT DISTINCT task, CAST(0 AS BIGINT) AS depth, 0 AS l0, 0 AS l1, 0 AS l2, 0 AS l3 FROM spoken
UNION ALL SELECT task, depth, l0, l1, l2, CASE WHEN c3 IS NULL THEN NULL WHEN p3 = p0 AND n03 AND l0 = 0 THEN 0 WHEN p3 = p1 AND n13 AND l1 = 1 THEN 1 WHEN p3 = p2 AND n23 AND l2 = 2 THEN 2 ELSE 3 END AS l3
FROM (SELECT *, CASE WHEN c2 IS NULL THEN NULL WHEN p2 = p0 AND n02 AND l0 = 0 THEN 0 WHEN p2 = p1 AND n12 AND l1 = 1 THEN 1 ELSE 2 END AS l2
FROM (SELECT *, CASE WHEN c0 IS NULL THEN NULL ELSE 0 END AS l0, CASE WHEN c1 IS NULL THEN NULL WHEN p1 = p0 AND n01 AND c0 IS NOT NULL THEN 0 ELSE 1 END AS l1
FROM (SELECT close.*, led.l0 AS p0, led.l1 AS p1, led.l2 AS p2, led.l3 AS p3 FROM led JOIN close ON close.task = led.task AND close.depth = led.depth + 1)))),
ways AS (SELECT led.task, led.depth, k, CASE k WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS leader, reward FROM led JOIN rollouts USING (task)),
nodes AS (SELECT task, depth, CASE WHEN depth = 0 THEN 0 ELSE leader END AS leader, avg(reward) AS value, count(*) AS visits FROM ways WHERE depth = 0 OR leader IS NOT NULL GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY depth > 0, leader, depth) - 1 AS seq FROM nodes),
above AS (SELECT n.*, w.leader AS parent_leader FROM numbered n LEFT JOIN ways w ON w.task = n.task AND w.depth = n.depth - 1 AND w.k = n.leader)
SELECT a.task AS task_id, 'node_' || a.seq AS node_id, 'node_' || p.seq AS parent_id, a.depth, md5(CASE WHEN a.depth = 0 THEN '' ELSE s.c END) AS content, round(a.value, 9) AS value, a.visits
FROM above a LEFT JOIN numbered p ON p.task = a.task AND p.depth = a.depth - 1 AND p.leader = CASE WHEN a.depth = 1 THEN 0 ELSE a.parent_leader END LEFT JOIN spoken s ON s.task = a.task AND s.depth = a.depth AND s.k = a.leader"""


def _replay_sql(share: float, plain: str = "{0}") -> str:
    """The SQL of a replay over ``spoken`` (task, depth, k, c) and ``rollouts`` (task, k, reward); plain makes text that has a byte for each character."""
    near = lambda a, b: f"(c{a} = c{b} OR abs(length(c{a}) - length(c{b})) < {share} * (length(c{b}) + 1) AND levenshtein({plain.format(f'c{a}')}, {plain.format(f'c{b}')}) / (length(c{b}) + 1.0::DOUBLE) < {share}::DOUBLE)"
    return _REPLAY_SQL.format(**{f"near{a}{b}": near(a, b) for a in range(4) for b in range(a + 1, 4)})


_TREE_OF_FIXTURE = "WITH RECURSIVE spoken AS (SELECT task_id AS task, pos + 1 AS depth, CAST(trajectory_id AS INTEGER) AS k, content AS c FROM turns), rollouts AS (SELECT task_id AS task, CAST(trajectory_id AS INTEGER) AS k, reward FROM scored)"

_TREE_OF_PARTS = """WITH RECURSIVE p AS (SELECT p_partkey // 4 AS task, CAST(p_partkey % 4 AS INTEGER) AS k, p_retailprice AS reward, p_brand AS a, p_type || ' ' || p_name AS b, CASE WHEN p_size % 3 > 0 THEN p_type END AS c FROM part),
spoken AS (SELECT task, CAST(1 AS BIGINT) AS depth, k, a AS c FROM p UNION ALL SELECT task, 2, k, b FROM p UNION ALL SELECT task, 3, k, c FROM p WHERE c IS NOT NULL), rollouts AS (SELECT task, k, reward FROM p)"""


def _tree(df):
    return df.select("task_id", "node_id", "parent_id", _long("depth"), F.md5("content").alias("content"), _r("value").alias("value"), "visits")


def replayed(spark, sf):
    """The trees of the fixture's tasks, with whole contents."""
    said = F.transform("turns", lambda t: t["content"])
    return replay.replay_tree(fixture.scored(spark, sf).select("task_id", F.col("conv_id").alias("rollout"), "reward", said.alias("contents")))


# DuckDB counts the bytes of an edit: characters other than ASCII are replaced by one of it.
@query(_TREE_OF_FIXTURE + _replay_sql(0.1, r"regexp_replace({0}, '[^\x00-\x7F]', '~', 'g')"), derived=True)
def tree_replay(spark, sf):
    return _tree(replayed(spark, sf))


@query(_TREE_OF_PARTS + _replay_sql(0.25))
def tree_merge(spark, sf):
    """Rollouts made of parts, four to a task; their brands, types and names merge within a quarter."""
    said = F.array(F.col("p_brand"), F.concat_ws(" ", "p_type", "p_name"))
    contents = F.when(F.col("p_size") % 3 > 0, F.concat(said, F.array("p_type"))).otherwise(said)
    rows = table(spark, sf, "part").select(F.expr("p_partkey div 4").alias("task_id"), F.col("p_partkey").alias("rollout"), F.col("p_retailprice").alias("reward"), contents.alias("contents"))
    return _tree(replay.replay_tree(rows, 0.25))


@query(
    base._TREE_SQL + """ SELECT task_id, state_id, CASE WHEN depth % 2 = 0 THEN 'A' ELSE 'B' END || '>' || CASE WHEN depth > 0 THEN array_to_string(string_split(state_id, ''), '>') || '>' ELSE '' END || chosen AS chosen,
CASE WHEN depth % 2 = 0 THEN 'A' ELSE 'B' END || '>' || CASE WHEN depth > 0 THEN array_to_string(string_split(state_id, ''), '>') || '>' ELSE '' END || rejected AS rejected, round(hi, 9) AS chosen_value, round(hi - lo, 9) AS distance FROM kept""",
    derived=True,
)
def legacy_tree_pairs(spark, sf):
    edges = stage(base._edges(spark, sf), "edges")
    prompts = edges.select("task_id", F.lit("A").alias("prompt_first"), F.lit("B").alias("prompt_second")).distinct()
    out = builders.legacy_tree_pairs(edges, pairs.tree_pairs(edges), prompts)
    return out.select("task_id", "state_id", F.array_join("chosen", ">").alias("chosen"), F.array_join("rejected", ">").alias("rejected"), _r("chosen_value").alias("chosen_value"), _r("distance").alias("distance"))
