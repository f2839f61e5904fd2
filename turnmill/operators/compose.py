"""Composing datasets: mixing, interleaving, resuming, overlays, decontamination by substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as X

from turnmill.staging import stage

from .selection import numbered, place_in_group, shuffle_key

#: Characters of benchmark texts that may be broadcast, after they have been summed.
BROADCAST_CHARS = 8 << 20


def mix(df: DataFrame, source: str, shares: dict[str, float], seed: str, key: str) -> DataFrame:
    """The first floor(share * n) rows, by key, of each source named, in md5 order (column ``order_key``)."""
    if any(s < 0 for s in shares.values()):
        raise ValueError("a share is negative")
    share = F.lit(None).cast("double")
    for name, value in shares.items():
        share = F.when(F.col(source) == name, F.lit(float(value))).otherwise(share)
    ranked = place_in_group(df.withColumn("_share", share).where("_share is not null"), source, key)
    return ranked.where(F.col("_place") < F.floor(F.col("_share") * F.col("_n"))).drop("_share", "_n", "_place").withColumn("order_key", shuffle_key(seed, F.col(key)))


def mix_frames(parts: list[tuple[DataFrame, float]], key: str, seed: str, split: str) -> DataFrame:
    """Mix frames of one shape; a test split is never cut, and other splits than train and test are refused."""
    if "train" not in split and "test" not in split:
        raise ValueError("a split's name must have train or test in it")
    if any(s < 0 for _, s in parts):
        raise ValueError("a share is negative")
    tagged = [df.withColumn("_source", F.lit(str(k))) for k, (df, _) in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    if "train" not in split:
        return out.drop("_source")
    return mix(out, "_source", {str(k): s for k, (_, s) in enumerate(parts)}, seed, key).drop("_source")


def round_robin(df: DataFrame, source: str, key: str, count: int | None = None) -> DataFrame:
    """Interleave sources: the first row of each, then the second, and so on (columns ``turn`` and ``source_no``).

    With count, each source gives so many rows, beginning again at its end.
    """
    ranked = place_in_group(df, source, key)
    sources = df.select(source).distinct().withColumn("source_no", F.row_number().over(Window.orderBy(source)) - 1)  # a row for each source
    joined = ranked.join(sources, source)  # broadcast where it turns out to be small
    if count is None:
        return joined.withColumn("turn", F.col("_place")).drop("_place", "_n")
    laps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.lit(count - 1) - F.col("_place")) / F.col("_n")).cast("int")))
    out = joined.where(F.col("_place") < count).withColumn("_lap", F.explode(laps))
    return out.withColumn("turn", F.col("_place") + F.col("_lap") * F.col("_n")).drop("_place", "_n", "_lap")


def cursor(df: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """The next ``count`` rows from a place that begins again at the end (columns ``draw``)."""
    return round_robin(df.withColumn("_all", F.lit(0)), "_all", key, start + count).where(F.col("turn") >= start).withColumn("draw", F.col("turn") - start).drop("_all", "source_no", "turn")


def unfinished(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The tasks that are not done yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def overlay(raw: DataFrame, *later: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stage with the values that later stages have instead; the last stage that has one counts."""
    out = raw
    for df in later:
        named = {c: f"_{c}" for c in df.columns if c not in keys}
        out = out.join(df.withColumnsRenamed(named), keys, "left")
        for c, held in named.items():
            out = out.withColumn(c, F.coalesce(held, c) if c in raw.columns or c in out.columns else F.col(held)).drop(held)
    return out


#: Whole words of a window by which passages and rows meet; a passage takes the longest that fits between its ends.
WINDOWS = (8, 4, 2, 1, 0)
#: Characters of the words on both sides of a short window; a passage takes the most that its own words have.
EDGES = (3, 1)
#: Characters by which passages of one word meet the words that hold them.
GRAMS = (8, 4, 2, 1)
#: Parts that the rows of one word are dealt to.
SALTS = 32


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", passage: str = "text") -> DataFrame:
    """Rows whose text holds no benchmark passage, spacing and capitals aside; empty passages are no passages.

    A passage may begin and end inside a word, but all its words between the first and
    last stand whole in a text that holds it, the first ends a word there, and the
    last begins one.  So passages of two or more words meet texts by a hash of
    the first whole words, or, where these are one or none, of the characters
    around them too, in an equi-join, and only those that meet are searched
    for.  Passages of one word meet the different words of all texts, by their
    first characters, and the words that hold one are joined back to the texts.
    Rows with a null text stay.
    """
    plain = lambda c: F.lower(X.single_spaced(F.col(c)))
    passages = benchmark.select(plain(passage).alias("_passage")).where("_passage <> ''").distinct().withColumn("_words", F.split("_passage", " "))
    inner = F.size("_words") - 2
    passages = passages.withColumn("_n", F.when(inner >= 0, _widest(inner, WINDOWS)))
    edge = lambda word: F.when(F.col("_n") < 2, _widest(F.length(word), EDGES)).otherwise(F.when(F.col("_n") >= 2, 0))
    first, behind = F.get("_words", F.lit(0)), F.get("_words", F.col("_n") + 1)
    passages = stage(passages.withColumns({"_left": edge(first), "_right": edge(behind), "_gram": F.when(F.col("_n").isNull(), _widest(F.length("_passage"), GRAMS))}), "passages")
    found = passages.groupBy("_n", "_left", "_right", "_gram").agg(F.sum(F.length("_passage")).alias("size")).collect()  # a row for each shape, of which there are few
    names = [f"_{c}" for c in df.columns]
    key = [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), F.col(text)).alias("_k2")]
    out = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], *key, plain(text).alias("_plain"))
    back = [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)]
    texts = out.where("_plain <> ''").select("_k1", "_k2", "_plain", F.split("_plain", " ").alias("_words"))
    shapes = [(r["_n"], r["_left"], r["_right"]) for r in found if r["_n"] is not None]
    if shapes:
        windows = F.flatten(F.array(*[_window_hashes("_words", *shape) for shape in shapes]))
        each = texts.select("_k1", "_k2", F.explode(F.array_distinct(windows)).alias("_key"))
        own = F.coalesce(*[F.when((F.col("_n") == n) & (F.col("_left") == a) & (F.col("_right") == b), _window_hash("_words", F.lit(0), n, a, b)) for n, a, b in shapes])
        keyed = passages.where("_n is not null").select(own.alias("_key"), "_passage")
        met = each.join(_sized(keyed, sum(r["size"] for r in found if r["_n"] is not None)), "_key").select("_k1", "_k2", "_passage").distinct()
        met = stage(met, "passages-met")
        hit = out.select("_k1", "_k2", "_plain").join(met, ["_k1", "_k2"]).where(F.contains("_plain", "_passage")).select("_k1", "_k2").distinct()
        out = out.join(hit, ["_k1", "_k2"], "left_anti")
    if len(shapes) < len(found):
        held = _words_that_hold(texts, passages.where("_n is null"), [(r["_gram"], r["size"]) for r in found if r["_n"] is None])
        out = out.join(_texts_with(texts, held), ["_k1", "_k2"], "left_anti")
    return out.select(*back)


def _widest(room: Column, widths: tuple[int, ...]) -> Column:
    """The widest of some widths, given from wide to narrow, that there is room for."""
    found = F.lit(widths[-1])
    for n in reversed(widths[:-1]):
        found = F.when(room >= n, F.lit(n)).otherwise(found)
    return found


def _window_hash(words: str, at: Column, n: int, left: int, right: int) -> Column:
    """The hash of n words behind a place, with so many last characters of the word there and first ones of the word behind."""
    parts = [F.lit(f"{n}:{left}:{right}"), F.slice(words, at + 2, F.lit(n))]
    if left:
        parts.append(F.right(F.get(words, at), F.lit(left)))
    if right:
        parts.append(F.left(F.get(words, at + n + 1), F.lit(right)))
    return F.xxhash64(*parts)


def _window_hashes(words: str, n: int, left: int, right: int) -> Column:
    """Hashes of all runs of n words that have a word on both sides, long enough for its characters."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i < F.size(words) - n - 1))
    if left > 1 or right > 1:
        starts = F.filter(starts, lambda i: (F.length(F.get(words, i)) >= left) & (F.length(F.get(words, i + n + 1)) >= right))
    return F.transform(starts, lambda i: _window_hash(words, i, n, left, right))


def _words_that_hold(texts: DataFrame, passages: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """The different words (_word) of texts that hold a passage of one word; found: the grams' widths and the characters of their passages."""
    vocabulary = texts.select(F.explode(F.array_distinct("_words")).alias("_word")).distinct()

    def grams(letters: Column, width: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(letters)), lambda i: i <= F.size(letters) - width + 1)
        return F.transform(starts, lambda i: F.xxhash64(F.slice(letters, i, F.lit(width))))

    # a function of the letters, so that a word is split once and not for each place
    keys = F.flatten(F.transform(F.array(F.split("_word", "")), lambda letters: F.flatten(F.array(*[grams(letters, g) for g, _ in found]))))
    each = vocabulary.select("_word", F.explode(F.array_distinct(keys)).alias("_key"))
    keyed = passages.select(F.xxhash64(F.slice(F.split("_passage", ""), F.lit(1), F.col("_gram"))).alias("_key"), "_passage")
    met = each.join(_sized(keyed, sum(size for _, size in found)), "_key")
    return stage(met.where(F.contains("_word", "_passage")).select("_word").distinct(), "words-held")


def _texts_with(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Keys of the texts with one of some words; a word that many texts have is dealt to SALTS parts."""
    chars = words.agg(F.sum(F.length("_word"))).first()[0] or 0
    salt = F.pmod("_k1", F.lit(SALTS))
    each = texts.select("_k1", "_k2", salt.alias("_salt"), F.explode(F.array_distinct("_words")).alias("_word"))
    if chars <= BROADCAST_CHARS:
        return each.join(F.broadcast(words), "_word", "left_semi").select("_k1", "_k2").distinct()
    dealt = words.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return each.join(dealt.hint("merge"), ["_word", "_salt"], "left_semi").select("_k1", "_k2").distinct()


def _sized(side: DataFrame, chars: int) -> DataFrame:
    """A side to be broadcast if it has few characters, which were summed, else merged."""
    return F.broadcast(side) if chars <= BROADCAST_CHARS else side.hint("merge")


def islands(df: DataFrame, value: str, order: str, by: list[str] | None = None, spans: int = 64) -> DataFrame:
    """Number the runs of rows with one value in order (column ``island``, from 1), of each group or of all rows.

    Rows of all are first numbered through buckets and dealt to spans of places; a
    span numbers its own runs, and is moved by those of the spans before, less
    the run that goes on across its border.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
        return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")
    placed = stage(numbered(df, order, [], [], "_at", "_all"), "placed")
    dealt = placed.withColumn("_span", F.floor(F.col("_at") * spans / F.col("_all")))
    own = Window.partitionBy("_span").orderBy("_at")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(own))) | (F.row_number().over(own) == 1)
    runs = dealt.withColumn("_run", F.sum(new.cast("int")).over(own))
    ends = runs.groupBy("_span").agg(F.max("_run").alias("_runs"), F.min_by(F.struct(value), "_at").alias("_first"), F.max_by(F.struct(value), "_at").alias("_last"))
    spans_in_order = Window.orderBy("_span")  # a row for each span
    goes_on = (F.row_number().over(spans_in_order) > 1) & F.col(f"_first.{value}").eqNullSafe(F.lag(f"_last.{value}").over(spans_in_order))
    ends = ends.withColumn("_less", goes_on.cast("int"))
    before = spans_in_order.rowsBetween(Window.unboundedPreceding, -1)
    moved = ends.select("_span", (F.coalesce(F.sum("_runs").over(before), F.lit(0)) - F.sum("_less").over(spans_in_order)).alias("_before"))
    return runs.join(moved, "_span").withColumn("island", F.col("_run") + F.col("_before")).select(*df.columns, "island")


def both_speakers(df: DataFrame) -> DataFrame:
    """Every row once for each speaker."""
    return df.withColumn("speaker", F.explode(F.array(F.lit("Alice"), F.lit("Bob"))))


def project(df: DataFrame, columns_to_keep: list[str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """Only some columns, those that are there, under new names if given."""
    kept = [c for c in df.columns if columns_to_keep is None or c in columns_to_keep]
    return df.select(*kept).withColumnsRenamed(renamed or {})
