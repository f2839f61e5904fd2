"""A similarity join of short texts by edit share, through segments of each length class.

Two texts are alike if their edit distance is below share * (longer length + 1).
So a text of m characters, as the longer one, may be ``most(m)`` edits from the
other.  It is cut into most(m) + 1 even segments, one of which stands unchanged in
the other text, at most so many characters away that the edits before and after it
stay within the bound.  Segments are an index; the shorter text probes it, for each
length that the longer may have, with its substrings at those places.

Only different texts of a group meet, each once, and only those that have a key in
common; their distances are worked out on a band of the bound's width.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the texts that are indexed, and keys that one may have, at most; the keys grow with the cube of the length.
LONGEST, MOST_KEYS = 32, 20_000


def most_edits(length: int, share: float) -> int:
    """The largest distance that is alike, for the longer length."""
    return math.ceil(share * (length + 1)) - 1


def segments(length: int, share: float) -> list[tuple[int, int]]:
    """(start, size) of the even segments of a text; none if it has fewer characters than segments."""
    parts = most_edits(length, share) + 1
    if parts > max(length, 1):
        return []
    limits = [k * length // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(limits, limits[1:], strict=False)]


def cut_slots(length: int, share: float) -> list[tuple[int, int, int, int]]:
    """The index keys of a text as (length, segment, start, size); segment -1 where every text of a fitting length may be alike."""
    return [(length, k, *x) for k, x in enumerate(segments(length, share))] or [(length, -1, 0, 0)]


def probe_slots(length: int, share: float, longest: int) -> list[tuple[int, int, int, int]]:
    """The keys by which a text meets the longer ones, or those as long, that may be alike."""
    found = []
    for m in range(length, longest + 1):
        edits, more = most_edits(m, share), m - length
        if more > edits:
            continue
        if not segments(m, share):
            found.append((m, -1, 0, 0))
        for k, (start, size) in enumerate(segments(m, share)):
            # Moved by s: |s| edits before the segment, |more + s| after it.
            found += [(m, k, start + s, size) for s in range(-edits, edits + 1) if abs(s) + abs(more + s) <= edits and 0 <= start + s <= length - size]
    return found


def _keys(texts: DataFrame, slots: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """texts (group, content, ...) with each of their keys."""
    spark = texts.sparkSession
    rows = [(n, *slot) for n, own in slots.items() for slot in own]  # by length alone: LONGEST bounds them
    table = spark.createDataFrame(rows or [], "n int, m int, k int, start int, size int").groupBy("n").agg(F.collect_list(F.struct("m", "k", "start", "size")).alias("slots"))
    met = texts.join(F.broadcast(table), F.length("content") == F.col("n"))
    key = F.transform("slots", lambda s: F.xxhash64("group", s["m"], s["k"], s["size"], F.substring("content", s["start"] + 1, s["size"])))
    return met.select(*texts.columns, F.explode(F.array_distinct(key)).alias("key"))


def alike(a: Column, b: Column, share: float) -> Column:
    """Whether the distance of two texts is below share * (longer length + 1), on a band of that width."""
    most = F.ceil(F.lit(float(share)) * (F.greatest(F.length(a), F.length(b)) + 1)).cast("int") - 1
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def indexed_lengths(share: float) -> tuple[int, int]:
    """The longest text that is indexed, and the longest that this may be alike; -1 for none."""
    found = (-1, -1)
    for n in range(LONGEST + 1):
        reach, keys = n, 0
        while reach + 1 - most_edits(reach + 1, share) <= n and keys <= MOST_KEYS:
            reach += 1
            keys += (most_edits(reach, share) + 1) * (2 * most_edits(reach, share) + 1)
        if keys > MOST_KEYS:
            break
        found = (n, reach)
    return found


def first_alike(texts: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """(group, content, first): the least ``first`` of the other texts (group, content, first) that are alike.

    Both sides hold a text of a group once.  Texts that are too long for the index
    meet those of their group, by length.
    """
    if share >= 1:
        raise ValueError("every text is alike at a share of 1 or more")
    longest, reach = indexed_lengths(share)
    cuts = {n: cut_slots(n, share) for n in range(reach + 1)}
    probes = {n: probe_slots(n, share, reach) for n in range(longest + 1)}
    above = {n: [x for x in own if x[0] > n] for n, own in probes.items()}
    other = others.select("group", F.col("content").alias("other"), "first")
    named = lambda df: df.withColumnRenamed("other", "content")
    back = lambda df: df.select("key", F.col("content").alias("other"), F.col("group").alias("group2"), "first")
    short = F.length("content") <= longest
    # The text is the longer one (or as long), then the shorter one.
    met = _keys(texts.where(F.length("content") <= reach), cuts).join(back(_keys(named(other).where(short), probes)), "key")
    met = met.unionByName(_keys(texts.where(short), above).join(back(_keys(named(other).where(F.length("content") <= reach), cuts)), "key"))
    met = met.where("group = group2").select("group", "content", "other", "first")
    n, m = F.length("content"), F.length("other")
    both_long = (n > longest) & (m > longest)
    long = texts.where(F.length("content") > longest).join(other.where(F.length("other") > longest), "group").where(both_long).select("group", "content", "other", "first")
    return met.union(long).where(alike(F.col("content"), F.col("other"), share)).groupBy("group", "content").agg(F.min("first").alias("first"))
