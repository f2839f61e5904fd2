"""Reading and writing task files: JSON lines of nested trajectories."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.types import TASK_LINE


#: Reports are read by people and pass through the driver.
REPORT_ROWS = 10_000


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task lines; lines that are no JSON are passed over."""
    return spark.read.schema(TASK_LINE).option("mode", "DROPMALFORMED").json(path)


def trajectories(tasks: DataFrame) -> DataFrame:
    """A row for each trajectory. Write this table once, so that later scans prune its columns."""
    return tasks.select(F.col("task_id").alias("line_task_id"), F.explode("results").alias("r")).select("r.*")


def gold_answers(answer: Column) -> tuple[Column, Column]:
    """An answer that is a string or a JSON list of strings, as an array, and whether it was a list."""
    parsed = F.from_json(answer, "array<string>")
    is_list = F.startswith(F.trim(answer), F.lit("[")) & parsed.isNotNull()
    return F.when(is_list, parsed).otherwise(F.array(answer)), F.coalesce(is_list, F.lit(False))


def prompt_pool(spark: SparkSession, path: str) -> DataFrame:
    """Prompts (index, prompt) of a JSON lines file: the text of each first <p> element."""
    from turnmill.functions.text import prompt_body

    raw = spark.read.schema("index int, prompt string").option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("prompt", prompt_body(F.col("prompt")))


def write_tasks(df: DataFrame, path: str) -> None:
    """Trajectories as task lines in order of their ids; rows without an id come first."""
    first = lambda c: F.coalesce(F.col(c), F.lit(-1))
    nested = df.withColumn("_r", F.struct(*df.columns)).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(first("trajectory_id").alias("k"), "_r")), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["_r"]).alias("results"))
    nested.orderBy(first("task_id")).write.mode("overwrite").json(path)


def publish_tasks(df: DataFrame, path: str, replace: bool = False, token: str | None = None) -> None:
    """Add trajectories of new tasks to a set of task lines, or put others in place of all of them.

    Lines are written to a folder of their own, in order of task ids; a row of
    the manifest then makes them count, which is the last step.  A run that
    fails before leaves readers what they had.  Tasks that the set has are not
    added again (those without an id count as one task); a token names a run, and one that is done is not done twice.
    One writer at a time.
    """
    spark = df.sparkSession
    entries = _entries(spark, path)
    if token is not None and any(e["token"] == token for e in entries):
        return
    if not replace and entries:
        done = published_tasks(spark, path).select(F.col("task_id").alias("_done")).distinct()
        df = df.join(done, F.col("task_id").eqNullSafe(F.col("_done")), "left_anti")
    name = uuid.uuid4().hex
    write_tasks(df, f"{path}/sets/{name}")
    number = 1 + max((e["number"] for e in entries), default=-1)
    row = spark.range(1).coalesce(1).select(F.lit(number).alias("number"), F.lit(name).alias("name"), F.lit(replace).alias("replaces"), F.lit(token).cast("string").alias("token"))
    row.write.mode("append").json(f"{path}/manifest")


def published_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task lines that the manifest names: the last set that replaced others, and those added since."""
    entries = sorted(_entries(spark, path), key=lambda e: e["number"])
    since = max((k for k, e in enumerate(entries) if e["replaces"]), default=0)
    names = [f"{path}/sets/{e['name']}" for e in entries[since:]]
    if not names:
        return spark.createDataFrame([], TASK_LINE)
    return spark.read.schema(TASK_LINE).option("mode", "DROPMALFORMED").json(names)


def _entries(spark: SparkSession, path: str) -> list[Row]:
    """The rows of a manifest, one for each run that wrote to it."""
    try:
        return spark.read.schema("number int, name string, replaces boolean, token string").json(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def write_splits(df: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    """Parquet, a folder for each split; a typed empty table keeps its schema."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Add rows as JSON lines; readers see whole files only."""
    df.write.mode("append").json(path)


def transcripts(df: DataFrame) -> DataFrame:
    """A readable text of each trajectory, under a name of its own: what it was about, how it ended and scored, prompts, turns.

    Columns that df lacks and values that are null leave their lines out.  Write
    the texts with ``partitionBy("task_id")`` or as they are; a merged file is the table itself.
    """
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("none"))

    def line(label: str, *columns: str) -> Column:
        there = [F.col(c).cast("string") for c in columns if c in df.columns]
        return F.concat(F.lit(f"{label}: "), *[x for pair in zip(there, [F.lit(", ")] * len(there), strict=True) for x in pair][:-1]) if there else F.lit(None).cast("string")

    def turn(t: Column, k: Column) -> Column:
        about = F.concat(F.lit("\n("), shown(t["token_count"]), F.lit(" tokens, answer "), shown(t["parsed_answer"]), F.lit(", finish "), shown(t["finish_reason"]), F.lit(")"))
        return F.concat(F.lit("\n["), (k + 1).cast("string"), F.lit("] "), F.coalesce(t["speaker"], F.lit("")), F.lit(": "), F.coalesce(t["content"], F.lit("")), about)

    head = F.format_string("Task %s, trajectory %s", F.col("task_id").cast("string"), F.col("trajectory_id").cast("string"))
    large = F.when(F.array_contains("conversation", "large"), F.lit("\n(a turn went over the limit)")) if "conversation" in df.columns else F.lit(None).cast("string")
    text = F.concat_ws(
        "\n",
        head,
        line("Data", "dataset_name", "data_type", "score_type"),
        line("Question", "question"),
        line("Gold answer", "answer"),
        line("Answer", "final_answer"),
        line("Ended", "termination_reason"),
        line("Tokens", "token_count"),
        line("Reward", "reward", "correct_score", "token_score", "ppl_score"),
        line("Penalty", "name_penalty"),
        line("Rank", "rank"),
        line("First prompt", "system_first"),
        line("Second prompt", "system_second"),
        F.array_join(F.transform("turns", turn), "\n"),
        large,
    )
    name = F.concat(F.lit("task_"), _padded(F.col("task_id"), 5), F.lit("_traj_"), _padded(F.coalesce("trajectory_id", F.lit(0)), 2), F.lit(".txt"))
    return df.select("task_id", "trajectory_id", name.alias("name"), text.alias("text"))


def _padded(number: Column, width: int) -> Column:
    """A number with zeros in front; longer ones stay whole."""
    text = F.coalesce(number.cast("string"), F.lit("none"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def sample_listing(df: DataFrame, order: list[str], count: int = 5, width: int = 160, by: str | None = None) -> DataFrame:
    """The first few rows in an order, of all or of each group (such as selected or not); texts are on one line, cut to a width."""
    strings = {c for c, kind in df.dtypes if kind == "string"}
    if by is None:
        first = df.orderBy(*order).limit(count)
    else:
        place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        first = df.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")

    def cut(c: str) -> Column:
        line = F.replace(F.col(c), F.lit("\n"), F.lit(" "))
        return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit(" …"))).otherwise(line).alias(c)

    return first.select(*[cut(c) if c in strings and c != by else F.col(c) for c in df.columns])


def render_report(summary: DataFrame, title: str) -> str:
    """A small aggregated table as Markdown; one of more rows than a report holds is an error."""
    rows = summary.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows")
    head = "| " + " | ".join(summary.columns) + " |"
    line = "|" + "---|" * len(summary.columns)
    body = ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", head, line, *body, ""])


def write_reports(summary: DataFrame, path: str, title: str) -> None:
    """One summary as JSON, CSV and Markdown in a folder."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    summary.sparkSession.createDataFrame([(render_report(summary, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
