"""Ranked lexical search with hierarchical max trees, searched best first.

1. One pass over the documents counts the query's terms in each and keeps
   (document, its terms in all, query terms, occurrences) in a staged table; sums
   over it give the corpus's figures and each term's document frequency.
2. A task takes the documents that it reads in shards of at most ``SHARD_POSTINGS``
   postings.  For each term of a shard, a tree of document ranges, ``FAN`` to one
   and up to the whole shard, holds the greatest contribution of a document.
3. For each query, a node's bound is the sum of its terms' greatest contributions.
   The nodes of the highest bounds are opened, ``OPEN`` at a time, until the bounds
   left are below the worst of the best documents; equal bounds are opened too,
   for ties.  A document's bound is its score.
4. The best of the tasks are ranked, at first within groups of tasks.

Queries are taken in groups of at most ``GROUP_TERMS`` terms, so that neither the
driver nor a task holds them all.

Defined results: null texts and texts without terms count nowhere and are never
found; nor are documents of score 0, so that an item without terms, or whose terms
no document has, has no rows.  Rows of items that share an id are one item with
the terms of all; items with null id are one item, too.  Each row of documents is
a document, repeated or not; of equal scores, null ids come last.  Very long texts
count with all their terms.  Terms are told apart by 64 bits of hash.  Empty tables
give an empty result.  Other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
#: Postings of a shard, and documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: Ranges that a node of a tree is made of, as a power of two; nodes opened at once.
FAN_BITS, OPEN = 4, 64
FAN = 1 << FAN_BITS
#: Terms of the queries that are searched in one go.
GROUP_TERMS = 200_000
#: Tasks whose results are ranked together first.
TASKS = 256

_WORD = common.byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the number of terms before each row (n + 1)."""
    raw, limits = common.text_buffer(column)
    low = common.LOWER[raw]
    starts, ends, rows = common.word_spans(low, limits, _WORD)
    return common.word_hashes(low, starts, ends), rows


def _query_groups(items: DataFrame, id_column: str, text: str, most: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Groups of (item, its different terms as hashes), streamed to the driver one group at a time."""
    kind = items.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            hashes, rows = _terms(batch.column("text"))
            sets = [np.unique(hashes[a:b]).astype(np.int64) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], ["id", "terms"])

    each = common.map_arrow(items.select(F.col(id_column).alias("id"), F.col(text).alias("text")), run, f"id {kind}, terms array<long>")
    united = each.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    group, held = [], 0
    for row in united.toLocalIterator():
        if group and held + len(row["terms"]) > most:
            yield group
            group, held = [], 0
        group.append((row["id"], np.array(row["terms"], np.int64).view(np.uint64)))
        held += len(row["terms"])
    if group:
        yield group


def _postings(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, n, terms, times) of the documents with any term; terms are places in the sorted hashes ``known``."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            hashes, rows = _terms(batch.column("text"))
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[place] == hashes)
            row = np.searchsorted(rows, hit, side="right") - 1
            pairs, times = np.unique(row * len(known) + place[hit], return_counts=True)
            row, term = np.divmod(pairs, len(known))
            n = np.diff(rows)
            limits = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(limits, pa.array(x.astype(np.int32))) for x in (term, times)]
            found = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "times"])
            yield found.filter(pa.array(n > 0))

    return common.map_arrow(docs, run, f"id {kind}, n long, terms array<int>, times array<int>")


class Shard:
    """The max trees of some documents' postings: for each level, term and range the greatest contribution.

    All levels are one sorted array of keys; level 0 is the documents.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((doc, term))
        doc, term, value = doc[order], term[order], value[order]
        self.width = int(doc.max()) + 1
        self.n_terms, self.levels = n_terms, 0
        keys, values = [term * self.width + doc], [value]
        while self.width > 1 << (FAN_BITS * self.levels):
            self.levels += 1
            key = (self.levels * n_terms + term) * self.width + (doc >> (FAN_BITS * self.levels))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            keys.append(key[first])
            values.append(np.maximum.reduceat(value, first))
        self.keys, self.values = np.concatenate(keys), np.concatenate(values)

    def opened(self, level: np.ndarray, place: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels, places and summed bounds of the children of nodes."""
        below = level - 1
        first = place << FAN_BITS
        low = (below[:, None] * self.n_terms + terms[None]) * self.width + first[:, None]
        room = np.minimum(first + FAN, self.width) - first
        a = np.searchsorted(self.keys, low.ravel())
        b = np.searchsorted(self.keys, (low + room[:, None]).ravel())
        at = common.ragged(a, b - a)
        of = np.repeat(np.arange(len(a)), b - a)
        child = (of // len(terms)) * FAN + (self.keys[at] - low.ravel()[of])
        # Sums of integers below 2 ** 53 are exact in doubles.
        bounds = np.bincount(child, weights=(self.values[at] * weights[of % len(terms)]).astype(np.float64), minlength=len(level) * FAN).astype(np.int64)
        some = np.flatnonzero(bounds)
        return below[some // FAN], first[some // FAN] + some % FAN, bounds[some]

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: list, best: list[tuple], top: int) -> list[tuple]:
        """The best (-score, id is null, id) of those given and the shard's documents, best first."""
        least = -best[-1][0] if len(best) == top else 1
        heap = [(-(1 << 62), self.levels, 0)]
        while heap and -heap[0][0] >= least:
            if heap[0][1] == 0:  # a shard of one document
                heap = [(-(1 << 62), 1, 0)]
            nodes = [heapq.heappop(heap)]
            while heap and len(nodes) < OPEN and -heap[0][0] >= least:
                nodes.append(heapq.heappop(heap))
            level, place, bound = self.opened(np.array([x[1] for x in nodes]), np.array([x[2] for x in nodes]), terms, weights)
            good = bound >= least
            for at, where, score in zip(level[good].tolist(), place[good].tolist(), bound[good].tolist(), strict=True):
                if at:
                    heapq.heappush(heap, (-score, at, where))
                else:
                    best.append((-score, ids[where] is None, ids[where]))
            best = sorted(best, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:top]
            least = -best[-1][0] if len(best) == top else 1
        return best


def _searched(postings: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, n_all: int, top: int) -> DataFrame:
    """(item, id, score, task): the best documents of each task; item is a place in queries."""
    kind = postings.schema["id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Shard]]:
        held: list[tuple] = []

        def close() -> tuple[list, Shard]:
            sizes = np.concatenate([x[1] for x in held])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            times = np.concatenate([x[3] for x in held])
            m = 100 - 90 + (90 * np.concatenate([x[4] for x in held]) * n_docs) // n_all
            value = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
            return sum((x[0] for x in held), []), Shard(doc, np.concatenate([x[2] for x in held]), value, n_terms)

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                terms, times = batch.column("terms"), batch.column("times")
                sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
                held.append((batch.column("id").to_pylist(), sizes, terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()))
                if sum(len(x[2]) for x in held) >= SHARD_POSTINGS or sum(len(x[0]) for x in held) >= SHARD_DOCS:
                    if any(len(x[2]) for x in held):
                        yield close()
                    held = []
        if any(len(x[2]) for x in held):
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: list[list[tuple]] = [[] for _ in queries]
        for ids, shard in shards(batches):
            for k, (terms, weights) in enumerate(queries):
                if len(terms):
                    best[k] = shard.search(terms, weights, ids, best[k], top)
        out = [(k, x[2], -x[0]) for k, found in enumerate(best) for x in found]
        if out:
            item, doc, score = zip(*out, strict=True)
            task = pa.array(np.full(len(out), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64()), task], ["item", "id", "score", "task"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(postings.schema["id"].dataType)
    return common.map_arrow(postings, run, f"item int, id {kind}, score long, task int")


def ranked_search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text", top: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, ties by ascending id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    item_kind, kind = (x.schema[c].dataType.simpleString() for x, c in ((items, item_column), (docs, "id")))
    out = None
    for group in _query_groups(items, item_column, text, group_terms):
        known = np.unique(np.concatenate([terms for _, terms in group]))
        postings = common.stage(_postings(docs, known), "search-postings")
        n_docs, n_all = (int(x or 0) for x in postings.agg(F.count("*"), F.sum("n")).first())
        held = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # group_terms rows at most
        if not held:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) if t in held else 0 for t in range(len(known))], np.int64)
        places = [np.searchsorted(known, terms) for _, terms in group]
        places = [x[weights[x] > 0] for x in places]
        found = _searched(postings, [(x, weights[x]) for x in places], len(known), n_docs, n_all, top)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        for by in (["item", F.pmod("task", F.lit(TASKS))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(group)], f"item int, item_id {item_kind}")
        ranked = common.stage(found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_column), "rank", F.col("id").alias(id_column), "score"), "search-ranked")
        common.forget(postings)
        out = ranked if out is None else out.union(ranked)
    return out if out is not None else spark.createDataFrame([], f"{item_column} {item_kind}, rank int, {id_column} {kind}, score long")
