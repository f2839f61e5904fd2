"""Loaders: source datasets as tasks (question, answers, two private contexts).

Where the dealing of contexts is random, md5 of a seed and a row's own key
stands for it, so that it is the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import latex
from turnmill.functions import text as X
from turnmill.operators.selection import shuffle_key

# The split of each dataset that a phase reads.
SPLITS = {
    "train": {"hotpot_qa": "train", "mwh_qa": "train", "cbt": "train", "gsm8k": "train", "math": "train", "trival_qa": "train", "arc": "train"},
    "test": {"hotpot_qa": "validation", "mwh_qa": "dev", "cbt": "test", "gsm8k": "test", "math": "test", "trival_qa": "validation", "arc": "test"},
}

_OUT = ["question", "answers", "answer_is_list", "context_first", "context_second", "data_type", "dataset_name", "score_type"]

# What the questions of these sets end with, around the options.
CHOOSE = "\nPlease choose your answer from "
SELECT = "\nYou need to select an answer from the options "
SELECT_END = " to fill in the _."


def split_name(dataset: Column, phase: Column) -> Column:
    """The split of a dataset that a phase reads; null where there is none."""
    named = [(p, d, s) for p, of in SPLITS.items() for d, s in of.items()]
    table = F.create_map(*[F.lit(x) for p, d, s in named for x in (f"{p}|{d}", s)])
    return F.try_element_at(table, F.concat(phase, F.lit("|"), dataset))


def _tasks(df: DataFrame, name: str, data_type: str, score_type: str, *extra: str) -> DataFrame:
    return df.withColumns({"data_type": F.lit(data_type), "dataset_name": F.lit(name), "score_type": F.lit(score_type)}).select(*extra, *_OUT)


def _hash(seed: str, *parts: Column) -> Column:
    return shuffle_key(seed, F.concat_ws("|", *parts))


def _dealt(items: DataFrame, key: str) -> DataFrame:
    """From rows (key, side, place, paragraph), the two contexts of each key in order."""
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("place", "paragraph")))), lambda x: x["paragraph"])
    return items.groupBy(key).agg(side(0).alias("context_first"), side(1).alias("context_second"))


def _paragraphs(df: DataFrame, key: str, supports: Column, paragraphs: Column, joint: str, seed: str, shuffled: bool) -> DataFrame:
    """Deal supporting paragraphs evenly, in order or in md5 order, and others by an md5 bit.

    paragraphs: array of (title, sentences); supports: array of titles, of which
    repeats count once.
    """
    each = df.select(key, F.array_distinct(supports).alias("_supports"), F.posexplode(paragraphs).alias("place", "p"))
    each = each.select(key, "place", F.concat(F.col("p.title"), F.lit(": "), F.array_join("p.sentences", joint), F.lit("\n")).alias("paragraph"), F.array_position("_supports", F.col("p.title")).alias("_support"), F.col("p.title").alias("_title"))
    mark = _hash(seed, F.col(key).cast("string"), F.col("_title"))
    order = [mark] if shuffled else [F.col("_support")]
    nth = F.row_number().over(Window.partitionBy(key, F.col("_support") > 0).orderBy(*order, "place")) - 1
    coin = F.conv(F.substring(mark, 1, 1), 16, 10).cast("int") % 2
    is_support = F.col("_support") > 0
    sided = each.withColumns({"side": F.when(is_support, nth % 2).otherwise(coin), "place": F.struct((~is_support).alias("other"), F.when(is_support, nth).otherwise(F.col("place")).alias("at"))})
    return _dealt(sided, key)


def hotpot_qa(df: DataFrame, seed: str = "42", key: str = "id") -> DataFrame:
    """Supporting paragraphs dealt to both speakers in md5 order, the others by an md5 bit."""
    paragraphs = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    contexts = _paragraphs(df, key, F.col("supporting_facts.title"), paragraphs, " ", seed, True)
    own = df.select(key, "question", F.array("answer").alias("answers"), F.lit(False).alias("answer_is_list"))
    return _tasks(own.join(contexts, key), "hotpot_qa", "qa", "f1-score", key)


def two_wiki(df: DataFrame, seed: str = "42", key: str = "id") -> DataFrame:
    """As hotpot_qa, with supporting facts in their order and sentences joined without a blank."""
    contexts = _paragraphs(df, key, F.transform("supporting_facts", lambda s: s["title"]), F.col("context"), "", seed, False)
    own = df.select(key, "question", F.array("answer").alias("answers"), F.lit(False).alias("answer_is_list"))
    return _tasks(own.join(contexts, key), "mwh_qa", "qa", "f1-score", key)


def trivia_qa(df: DataFrame, seed: str = "42", key: str = "id") -> DataFrame:
    """Search results dealt in md5 order; every alias is a gold answer."""
    each = df.select(key, F.posexplode("search_results.description").alias("at", "paragraph"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(_hash(seed, F.col(key).cast("string"), F.col("at").cast("string")))) - 1
    contexts = _dealt(each.withColumn("place", place).withColumn("side", F.col("place") % 2), key)
    own = df.select(key, "question", F.col("answer.aliases").alias("answers"), F.lit(True).alias("answer_is_list"))
    return _tasks(own.join(contexts, key), "trival_qa", "qa", "f1-score", key)


def listed(items: Column) -> Column:
    """An array of strings as a list is written: quoted, in brackets."""
    def quoted(x: Column) -> Column:
        plain = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def cbt(df: DataFrame, key: str = "id") -> DataFrame:
    """Sentences halved; the options follow the question."""
    half = F.floor(F.size("sentences") / 2).cast("int")
    out = df.select(
        key,
        F.concat(F.col("question"), F.lit(CHOOSE), listed(F.col("options")), F.lit(" ")).alias("question"),
        F.array("answer").alias("answers"),
        F.lit(False).alias("answer_is_list"),
        F.slice("sentences", F.lit(1), half).alias("context_first"),
        F.slice("sentences", half + 1, F.size("sentences") - half).alias("context_second"),
    )
    return _tasks(out, "cbt", "qa", "exact-match", key)


def _no_context(df: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.withColumns({"answer_is_list": F.lit(False), "context_first": empty, "context_second": empty})


def gsm8k(df: DataFrame, key: str = "id") -> DataFrame:
    """The answer is what follows ####."""
    out = _no_context(df.select(key, "question", F.array(X.trimmed(F.get(F.split("answer", "####"), F.lit(1)))).alias("answers")))
    return _tasks(out, "gsm8k", "math", "exact-match", key)


def read_math(spark: SparkSession, root: str, phase: str = "train") -> DataFrame:
    """problem and solution of each JSON file under root, the phase's split and a folder for each kind of question; unreadable files are left out.

    id is the file's path from the split on.
    """
    split = SPLITS[phase]["math"]
    read = spark.read.schema("problem string, solution string").option("mode", "DROPMALFORMED").option("multiLine", True).json(f"{root.rstrip('/')}/{split}/*/*")
    return read.select(F.concat(F.lit(f"{split}/"), F.substring_index(F.col("_metadata.file_path"), "/", -2)).alias("id"), "problem", "solution")


def math(df: DataFrame, key: str = "id") -> DataFrame:
    """The answer is the last boxed expression of the solution, in normal form."""
    out = _no_context(df.select(key, F.col("problem").alias("question"), F.array(X.normalize_answer(latex.boxed_answer(F.col("solution")))).alias("answers")))
    return _tasks(out, "math", "math", "math", key)


def arc(df: DataFrame, key: str = "id") -> DataFrame:
    """The gold answer is the text of the key's choice."""
    gold = F.try_element_at(F.map_from_arrays("choices.label", "choices.text"), F.col("answerKey"))
    out = _no_context(df.select(key, F.concat(F.col("question"), F.lit(CHOOSE), listed(F.col("choices.text"))).alias("question"), F.array(gold).alias("answers")))
    return _tasks(out, "arc", "debate", "exact-match", key)


def mmlu(df: DataFrame, arc_questions: DataFrame, seed: str = "42", key: str = "id") -> DataFrame:
    """Questions that the other set lacks, in md5 order (order_key); the answer is a place among the choices."""
    fresh = df.join(arc_questions.select("question").distinct(), "question", "left_anti")
    out = _no_context(fresh.select(key, shuffle_key(seed, F.col(key)).alias("order_key"), F.concat(F.col("question"), F.lit(SELECT), listed(F.col("choices")), F.lit(SELECT_END)).alias("question"), F.array(F.get("choices", F.col("answer").cast("int"))).alias("answers")))
    return _tasks(out, "mmlu", "debate", "exact-match", key, "order_key")
