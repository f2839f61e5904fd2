"""Near-duplicate documents by HyperMinHash sketches, banding and full verification.

1. One pass gives each document its set of word shingles (as 64-bit hashes), a
   128-bit digest of that set, and ``REGISTERS`` registers.  A register is the
   least value of one hash function over the set, compressed to the count of its
   leading zeros (6 bits) and the ``MANTISSA`` bits that follow.
2. Documents of equal sets fall together into the one of the least id, so large
   groups of copies cost one node.
3. Registers are banded by ``ROWS``; nodes that share a band meet in a bucket.
   Each member is paired with the ``PIVOTS`` most central members of its bucket
   (those that share the most bands with others), which is every pair in small
   buckets and a linear number in large ones.
4. Pairs pass if the share of equal registers, corrected for chance collisions
   of compressed values, is within ``MARGIN`` of the threshold; then their full
   sets are compared.
5. Buckets with more members than pivots may hide links that no pivot shows.
   For these, shingles that occur in one set only, and a bit mask of groups of
   shingles, give exact upper bounds of a similarity: a node with too many single
   shingles has no link at all, and of the rest only pairs from different
   components whose bound reaches the threshold are still compared, in blocks of
   ``BLOCK_NODES`` members, so that a large bucket is many tasks' work.  So no
   bucket is paired out in full.
6. Components of the links name each group by its least id.

What may be missed is random only: with 32 bands of 4 rows, two sets of
similarity 0.8 miss each other in every band with probability 5e-8, and their
estimate lies ``MARGIN`` standard errors too low with about 3e-7.

Defined results: null text, and text without words, has an empty set, is linked
with nothing and is kept.  Texts with fewer words than a shingle are one shingle
of all their words.  Very long texts count with all their shingles.  Rows of the
same id are one node and share their fate.  Rows with null id are linked with
nothing, their component is null, and they are kept.  Other columns play no part.
An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

REGISTERS, ROWS, MANTISSA = 128, 4, 10
PIVOTS = 4
#: Standard errors of the estimate at the threshold.
MARGIN = 5.0
#: Words of 64 bits of a set's mask.
MASK_WORDS = 32
#: Members of a bucket that meet the rest of it in one task; larger buckets are dealt out in such blocks.
BLOCK_NODES = 256
#: Ids that may be broadcast to pick texts for verification; beyond it, a merge join.
BROADCAST_IDS = 500_000

_WORD = common.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_rng = np.random.default_rng(1234)
_MULTIPLY = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, limits = common.text_buffer(column)
    low = common.LOWER[raw]
    starts, ends, rows = common.word_spans(low, limits, _WORD)
    h = common.word_hashes(low, starts, ends)
    n = len(h)
    mixed = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        mixed = common.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)] + np.uint64(k))
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(digest, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 32-bit values, in 16 bits."""
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    rest = np.where(zeros < 32, (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF), 0) >> np.uint64(32 - MANTISSA)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (n, REGISTERS) of sets that are not empty."""
    if not sets:
        return np.zeros((0, REGISTERS), np.uint16)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0] + [len(x) for x in sets[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    held = np.empty_like(values)
    for j in range(REGISTERS):
        np.multiply(values, _MULTIPLY[j], out=held)
        np.add(held, _ADD[j], out=held)
        least[j] = np.minimum.reduceat(held, first)
    return compress(least.T)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unlike minima are equal, for sets of n and m shingles."""
    edges = np.concatenate([0.5 ** np.arange(33), [0.0]])
    at = [1 - (1 - edges[None]) ** np.asarray(x, float)[:, None] for x in (n, m)]
    return ((at[0][:, :-1] - at[0][:, 1:]) * (at[1][:, :-1] - at[1][:, 1:])).sum(1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches, corrected for collisions."""
    c = chance(n, m)
    return ((a == b).mean(1) - c) / (1 - c)


def _digest(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            full = [k for k, x in enumerate(sets) if len(x)]
            registers = dict(zip(full, sketches([sets[k] for k in full]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([registers[k].tobytes() if k in registers else None for k in range(len(sets))], pa.binary()),
                ],
                ["id", "n", "digest", "sketch"],
            )

    return common.map_arrow(docs, run, f"id {kind}, n long, digest binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    kind = nodes.schema["id"].dataType.simpleString()
    count = REGISTERS // ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, count)
            keys = common.mix(common.mix(packed) + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), count))), pa.array(keys.ravel())], ["id", "key"])

    return common.map_arrow(nodes.select("id", "sketch"), run, f"id {kind}, key long")


def _promising(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity leaves room for the threshold."""
    kind = nodes.schema["id"].dataType.simpleString()
    least = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    one, two = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("sa", "sb")]
            n = [batch.column(x).to_numpy() for x in ("na", "nb")]
            good = pa.array(estimate(*s, *n) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(good) for x in ("a", "b")], ["a", "b"])

    # Sizes alone bound a similarity, too.
    joined = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    return common.map_arrow(joined.select("a", "b", "na", "nb", "sa", "sb"), run, f"a {kind}, b {kind}")


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, shingles) of the documents of some ids, each different set of an id once."""
    kind = docs.schema["id"].dataType.simpleString()
    small = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if small else ids.hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "shingles"])

    return common.map_arrow(chosen, run, f"id {kind}, n long, shingles binary").where("n > 0")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    kind = sets.schema["id"].dataType.simpleString()
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = int(np.isin(x, y, assume_unique=True).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(good, pa.bool_())) for x in ("a", "b")], ["a", "b"])

    joined = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
    return common.map_arrow(joined.select("a", "b", "sa", "sb"), run, f"a {kind}, b {kind}").distinct()


def _profiles(sets: DataFrame) -> DataFrame:
    """(id, set, n, mask): a bit for each of 64 * MASK_WORDS groups of shingles that a set has one of."""
    kind = sets.schema["id"].dataType.simpleString()
    bits = 64 * MASK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros((batch.num_rows, bits), bool)
            for k, x in enumerate(batch.column("shingles")):
                masks[k, np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(bits)] = True
            words = np.packbits(masks, axis=1).view(np.int64).ravel()
            mask = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * MASK_WORDS), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("set"), batch.column("n"), mask], ["id", "set", "n", "mask"])

    return common.map_arrow(sets, run, f"id {kind}, set long, n long, mask array<long>")


def _single_shingles(sets: DataFrame) -> DataFrame:
    """(id, set, u): how many shingles of a set occur in no other node's set."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = np.frombuffer(batch.column("shingles")[k].as_buffer(), np.int64)
                row = pa.array(np.full(len(values), k))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("set").take(row), pa.array(values)], ["id", "set", "shingle"])

    each = common.map_arrow(sets, run, f"id {kind}, set long, shingle long")
    alone = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other"), F.min("set").alias("set")).where("id = other")
    return alone.groupBy("id", "set").agg(F.count("*").alias("u"))


def _unseen(entries: DataFrame, pivots: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs of large buckets, of different components, that may reach the threshold by exact bounds.

    A set lacks at least its single shingles, and those of its groups of shingles
    that the other has none of, in the intersection.
    """
    sets = sets.withColumn("set", F.xxhash64("shingles"))
    known = _profiles(sets).join(_single_shingles(sets), ["id", "set"], "left").select("id", "n", "mask", F.coalesce("u", F.lit(0)).alias("u"))
    known = known.where(F.col("n") - F.col("u") >= F.lit(threshold) * F.col("n") - 1e-9)  # others have no link at all
    known = common.stage(known.join(found, known["id"] == found["node"], "left").select("id", "n", "u", "mask", F.coalesce("component", "id").alias("component")), "near-known")
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    members = entries.select("key", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")).join(known, "id")
    main = pivots.where("place = 1").select("key", F.col("id").alias("pivot")).join(known.select(F.col("id").alias("pivot"), F.col("component").alias("main")).distinct(), "pivot", "left").select("key", "main")
    rest = members.hint("merge").join(main, "key").where("main is null or component <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(x).alias(f"{x}2") for x in ("id", "n", "u", "mask", "component")])

    def lacking(one: str, other: str) -> Column:
        total = F.lit(0)
        for k in range(MASK_WORDS):
            total = total + F.bit_count(F.get(one, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(k)))))
        return total

    both = F.least(F.col("n") - F.greatest("u", lacking("mask", "mask2")), F.col("n2") - F.greatest("u2", lacking("mask2", "mask")))
    cheap = F.least(F.col("n") - F.col("u"), F.col("n2") - F.col("u2")) >= F.lit(threshold) * F.greatest(F.col("n") + F.col("u2"), F.col("n2") + F.col("u")) - 1e-9
    bound = both >= F.lit(threshold) * (F.col("n") + F.col("n2") - both) - 1e-9
    pairs = members.hint("merge").join(rest, (members["key"] == rest["key"]) & (members["block"] == rest["block"]) & (F.col("component") != F.col("component2")) & cheap & bound)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80, pivots: int = PIVOTS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    threshold = percent / 100
    each = common.stage(_digest(docs, words), "near-digests")
    usable = each.where("n > 0 and id is not null")
    # One node for each different set; its id is the least of its rows.
    groups = common.stage(usable.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-nodes")
    nodes = groups.select("id", "n", "sketch")
    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = common.stage(bands.hint("merge").join(shared, "key").select("key", "id", "size"), "near-entries")
    central = entries.groupBy("id").agg(F.sum("size").alias("central"))
    ranked = entries.hint("merge").join(central, "id")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), "id"))
    tops = common.stage(ranked.withColumn("place", place).where(F.col("place") <= pivots).select("key", "id", "place"), "near-pivots")
    paired = entries.hint("merge").join(tops.select("key", F.col("id").alias("pivot")), "key").where("id <> pivot")
    pairs = paired.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    pairs = common.stage(_promising(pairs, nodes, threshold), "near-pairs")
    large = entries.where(F.col("size") > pivots + 1)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    sets = common.stage(_sets_of(docs, common.stage(needed, "near-needed"), words).distinct(), "near-sets")
    links = common.stage(_confirmed(pairs, sets, percent), "near-links")
    found = common.stage(components(links), "near-components")
    if not large.isEmpty():
        own = sets.join(large.select("id").distinct(), "id", "left_semi")
        more = _promising(_unseen(large, tops, own, found, threshold), nodes, threshold)
        more = common.stage(_confirmed(more, sets, percent), "near-links")
        if not more.isEmpty():
            found = common.stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "near-components")
    common.forget(entries, tops, pairs, sets)
    # Rows that share an id are one node, whichever of their sets it has.
    named = groups.select("digest", F.col("id").alias("node")).join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = each.hint("merge").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with their columns: one id of each group, and rows without an id."""
    found = near_duplicates(docs, id_column, text, words, percent)
    (name,) = common.free_names(docs, 1)
    gone = common.stage(found.where("not kept").select(F.col(id_column).alias(name)).distinct(), "near-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    return docs.join(side, docs[id_column] == side[name], "left_anti")
