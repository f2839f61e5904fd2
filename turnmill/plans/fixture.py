"""Trajectories derived from the conversations table, with markers set by ids alone.

The raw table triggers neither the answer parser nor the format gate nor the
repeat rule, so speakers, answers and offences are derived from conversation ids.
``SQL`` holds the same derivation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import text as X
from turnmill.operators import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer pieces than there are cores, dealt to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, task_id, trajectory_id, pos, speaker, text, parsed_answer, content, token_count, loss)."""
    raw = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "text")
    raw = raw.repartition(spark.sparkContext.defaultParallelism, "conv_id")  # few bytes, but much work for each
    own = Window.partitionBy("conv_id").orderBy("turn")
    conv, pos = F.col("conv_id"), F.col("pos")
    parsed = F.when((conv + pos) % 5 == 0, F.lit(None)).otherwise(F.substring(F.lit("ABCD"), (1 + (conv * 7 + pos * (conv % 3)) % 4).cast("int"), F.lit(1)))
    out = raw.withColumn("pos", F.row_number().over(own) - 1).withColumns({"speaker": F.when(pos % 2 == 0, "Alice").otherwise("Bob"), "parsed_answer": parsed})
    mark = F.when((conv % 11 == 0) & (pos == 1), " Alice: Bob:").otherwise("")
    said = F.concat(F.col("speaker"), F.lit(": "), F.col("text"), F.coalesce(F.concat(F.lit(" <A>"), F.col("parsed_answer"), F.lit("</A>")), F.lit("")), mark)
    first = F.first("_said").over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_said", said).withColumn("content", F.when((conv % 13 == 0) & (pos == 2), first).otherwise(F.col("_said")))
    return out.select("conv_id", F.expr("conv_id div 4").alias("task_id"), (conv % 4).alias("trajectory_id"), "pos", "speaker", "text", "parsed_answer", "content", X.token_count(F.col("content")).alias("token_count"), (1.0 + (F.length("text") % 7) / 10.0).alias("loss"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation that has turns, ready to be scored."""
    each = turns(spark, sf_dir)
    keys = ["conv_id", "task_id", "trajectory_id"]
    ordered = F.array_sort(F.collect_list(F.struct("pos", "speaker", "content", "loss")))
    nested = each.groupBy(*keys).agg(ordered.alias("turns"), F.sum("token_count").alias("token_count"))
    ended = scoring.agreement(each, keys).drop("task_id", "trajectory_id")
    is_large = F.col("conv_id") % 17 == 0
    gold = F.substring(F.lit("ABCD"), (1 + F.col("task_id") % 4).cast("int"), F.lit(1))
    said = F.transform("turns", lambda t: t["content"])
    return nested.join(ended, "conv_id").select(
        *keys,
        "turns",
        F.when(is_large, F.concat(said, F.array(F.lit("large")))).otherwise(said).alias("conversation"),
        "token_count",
        F.transform("turns", lambda t: t["loss"]).alias("losses"),
        gold.alias("answer"),
        F.array(gold, F.lower(gold)).alias("answers"),
        F.lit(True).alias("answer_is_list"),
        "final_answer",
        F.lit("exact-match").alias("score_type"),
        F.when(is_large, "large").when(F.col("agreed_pos").isNotNull(), "agreement").otherwise("max_round").alias("termination_reason"),
        F.col("trajectory_id").alias("pos"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(trajectories(spark, sf_dir), maths=False)


SQL = r"""
t0 AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role <> 'system'),
t1 AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'Alice' ELSE 'Bob' END AS speaker,
  CASE WHEN (conv_id + pos) % 5 = 0 THEN NULL ELSE substr('ABCD', CAST(1 + (conv_id * 7 + pos * (conv_id % 3)) % 4 AS INTEGER), 1) END AS parsed_answer FROM t0),
t2 AS (SELECT *, speaker || ': ' || text || coalesce(' <A>' || parsed_answer || '</A>', '') || CASE WHEN conv_id % 11 = 0 AND pos = 1 THEN ' Alice: Bob:' ELSE '' END AS said FROM t1),
turns AS (SELECT conv_id, conv_id // 4 AS task_id, conv_id % 4 AS trajectory_id, pos, speaker, text, parsed_answer, content,
    len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS token_count, 1.0::DOUBLE + (length(text) % 7) / 10.0::DOUBLE AS loss
  FROM (SELECT *, CASE WHEN conv_id % 13 = 0 AND pos = 2 THEN first_value(said) OVER (PARTITION BY conv_id ORDER BY pos) ELSE said END AS content FROM t2)),
seen AS (SELECT *, last_value(parsed_answer IGNORE NULLS) OVER w AS last_answer, last_value(CASE WHEN parsed_answer IS NOT NULL THEN speaker END IGNORE NULLS) OVER w AS last_speaker
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
agreed AS (SELECT conv_id, min(pos) AS agreed_pos FROM seen WHERE parsed_answer = last_answer AND speaker <> last_speaker GROUP BY conv_id),
ended AS (SELECT t.conv_id, any_value(a.agreed_pos) AS agreed_pos,
    coalesce(max(CASE WHEN t.pos = a.agreed_pos THEN t.parsed_answer END), arg_max(t.parsed_answer, t.pos) FILTER (t.parsed_answer IS NOT NULL)) AS final_answer
  FROM turns t LEFT JOIN agreed a USING (conv_id) GROUP BY t.conv_id),
mixed AS (SELECT conv_id, pos, (regexp_matches(content, 'Alice:') AND regexp_matches(content, 'Bob:'))
    OR len(regexp_extract_all(content, 'Alice:')) > 1 OR len(regexp_extract_all(content, 'Bob:')) > 1 AS is_mixed,
    lower(regexp_replace(regexp_replace(content, '^\s*(Alice|Bob)\s*:\s*', ''), '^\s+|\s+$', '', 'g')) AS plain FROM turns),
dup AS (SELECT conv_id, pos, is_mixed, row_number() OVER (PARTITION BY conv_id, plain ORDER BY pos) > 1 AS is_dup FROM mixed),
offence AS (SELECT conv_id, min(CASE WHEN is_mixed THEN pos END) AS name_pos, min(CASE WHEN is_dup THEN pos END) AS dup_pos FROM dup GROUP BY conv_id),
traj AS (SELECT t.conv_id, any_value(t.task_id) AS task_id, any_value(t.trajectory_id) AS trajectory_id, sum(t.token_count) AS token_count, max(t.loss) AS max_loss, t.conv_id % 17 = 0 AS is_large,
    substr('ABCD', CAST(1 + any_value(t.task_id) % 4 AS INTEGER), 1) AS answer, any_value(e.final_answer) AS final_answer,
    CASE WHEN t.conv_id % 17 = 0 THEN 'large' WHEN any_value(e.agreed_pos) IS NOT NULL THEN 'agreement' ELSE 'max_round' END AS termination_reason,
    any_value(o.name_pos) AS name_pos, any_value(o.dup_pos) AS dup_pos
  FROM turns t JOIN ended e USING (conv_id) JOIN offence o USING (conv_id) GROUP BY t.conv_id),
task_max AS (SELECT task_id, coalesce(max(CASE WHEN NOT is_large THEN token_count END), 1)::DOUBLE AS most FROM traj GROUP BY task_id),
parts AS (SELECT traj.*, token_count <= 2000 AS judged,
    CASE WHEN token_count <= 2000 THEN CASE WHEN name_pos IS NOT NULL AND (dup_pos IS NULL OR name_pos <= dup_pos) THEN 'name' WHEN dup_pos IS NOT NULL THEN 'duplicate' END END AS offence,
    CASE WHEN is_large OR token_count <= 40 THEN -1.0::DOUBLE ELSE (-0.5)::DOUBLE * token_count / most END AS token_score
  FROM traj JOIN task_max USING (task_id)),
scored AS (SELECT *, correct_score + token_score + ppl_score AS reward FROM (SELECT *,
    CASE WHEN offence IS DISTINCT FROM 'name' AND lower(coalesce(final_answer, '')) IN (lower(answer)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct_score,
    CASE WHEN NOT judged THEN -1.0::DOUBLE WHEN offence IS NOT NULL THEN 0.0::DOUBLE ELSE 0.6::DOUBLE / max_loss END AS ppl_score FROM parts)),
penalised AS (SELECT *, CASE WHEN name_pos IS NOT NULL THEN -10.0::DOUBLE ELSE 0.0::DOUBLE END AS name_penalty,
    reward + CASE WHEN name_pos IS NOT NULL THEN -10.0::DOUBLE ELSE 0.0::DOUBLE END AS effective_reward FROM scored),
best AS (SELECT * FROM penalised QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY effective_reward DESC, trajectory_id) = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY effective_reward DESC, task_id) - 1 AS place, count(*) OVER () AS total FROM best),
chosen AS (SELECT *, row_number() OVER (ORDER BY effective_reward DESC, task_id) - 1 AS rank FROM placed WHERE place < floor(0.7::DOUBLE * total) AND effective_reward >= 0.6::DOUBLE)
"""
