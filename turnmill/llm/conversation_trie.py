"""The prefix trie of conversations, by distributed MSD radix partitioning.

1. Turns (role, text) are dictionary-encoded; a conversation becomes an array of
   turn ids in the order of its turns, rebuilt from the first turns of the
   conversation that opens its hundred.
2. Equal sequences become one, with their number and the digest of their ids,
   so that a common conversation is one row from here on.
3. Radix rounds: a bucket holds the sequences of one prefix.  Its members'
   common beginning (that of the least and the greatest of them) is skipped at
   once; then the next turn id deals the bucket into buckets of the next round.
   Buckets of at most ``LOCAL_TURNS`` turns, or of one sequence, leave the rounds.
4. These are finished where they land, by multikey quicksort; its recursion
   emits a node for each group of equal ids.
5. Leaves and saved tokens of the buckets are summed up through the rounds, from
   the last to the first.

Defined results: rows without a conversation id belong to no conversation; null
roles and texts are empty; turns of the same number are ordered by role and
text, and repeated rows are turns of their own.  Texts count with all their code
points.  Turns and sequences are told apart by 128 bits of hash before they get
their ids.  The smallest member names a node; a sequence that ends inside
another's prefix is no child.  An empty table has no nodes, not even a root.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a bucket that one task may hold.
LOCAL_TURNS = 200_000
#: Conversations are rebuilt from the one that opens their block of so many ids, by fewer turns than SHARED.
BLOCK, SHARED = 100, 6
#: Rows that may be broadcast, after they have been counted; beyond it, a merge join.
BROADCAST_ROWS = 100_000
#: Bytes of joined ids in a row on their way to a digest.
CHUNK = 1 << 16

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOBODY = hashlib.sha256(b"").hexdigest()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): turn ids and code points of the texts of each conversation, in order."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    hashed = rows.select("conv_id", F.row_number().over(order).alias("at"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2"), F.length("text").alias("size"))
    hashed = common.stage(hashed, "trie-turns")
    words = common.stage(hashed.groupBy("h1", "h2").agg(F.first("size").alias("size")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = hashed.drop("size").join(words, ["h1", "h2"])
    turns = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("turns"))
    out = common.stage(turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes")), "trie-conversations")
    common.forget(hashed, words)
    return out


def rebuilt(coded: DataFrame) -> DataFrame:
    """Each conversation with the first h turns of the one that opens its block, then its own after its first h."""
    first = coded.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("opens"), *[F.slice(x, 1, SHARED - 1).alias(f"first_{x}") for x in ("ids", "sizes")])
    held = coded.withColumns({"opens": F.col("conv_id") - F.col("conv_id") % BLOCK, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")})

    def both(name: str) -> Column:
        opening = F.coalesce(F.slice(f"first_{name}", F.lit(1), F.col("h")), F.slice(name, 1, 0))
        return F.concat(opening, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return held.join(first, "opens", "left").select("conv_id", both("ids"), both("sizes"))


def _digests(members: DataFrame) -> DataFrame:
    """(first, ends): the digest of the ids (conv_id) of each class (first), ascending and joined by commas.

    Ids are joined to texts of CHUNK bytes where a sort by range has put them; only these meet in a task, which hashes them one by one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for first, conv in zip(batch.column("first").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (first != now or size >= CHUNK):
                    out.append((now, at, ",".join(held)))
                    held, size = [], 0
                if not held:
                    now, at = first, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
                if len(out) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["first", "at", "ids"])
                    out = []
        if held:
            out.append((now, at, ",".join(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["first", "at", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for first, ids in zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if first != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = first, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["first", "ends"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["first", "ends"])

    dealt = members.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id")
    texts = common.map_arrow(dealt, join, "first long, at long, ids string")
    return common.map_arrow(texts.repartition("first").sortWithinPartitions("first", "at"), digest, "first long, ends string")


def classes(sequences: DataFrame) -> DataFrame:
    """(first, n, ends, ids, sizes): each different sequence, its smallest conversation, how many have it, and the digest of their ids."""
    keyed = common.stage(sequences.withColumns({"k1": F.xxhash64("ids"), "k2": F.xxhash64(F.lit("second"), "ids")}), "trie-sequences")
    groups = common.stage(keyed.groupBy("k1", "k2").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")), "trie-groups")
    several = keyed.select("k1", "k2", "conv_id").join(groups.where("n > 1").drop("n"), ["k1", "k2"]).select("first", "conv_id")
    ends = _digests(several)
    named = groups.select("first", "n").join(ends, "first", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.col("first").cast("string"), 256)))
    out = common.stage(named.join(keyed.select(F.col("conv_id").alias("first"), "ids", "sizes"), "first"), "trie-classes")
    common.forget(keyed, groups)
    return out


def bucket_nodes(bucket: list[tuple], depth: int, parent: int) -> list[list]:
    """The nodes below depth of sequences (first, n, ends, ids, sizes) that are different and share ids[: depth + 1].

    Multikey quicksort: a group is parted by the id at its depth into less, equal and
    greater; the equal ones are a node and go on one turn deeper, under it.
    Each node: conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved_tokens, ends, place of the parent.
    """
    nodes: list[list] = []
    todo = [(bucket, depth, -1)]
    while todo:
        rows, at, above = todo.pop()
        if len(rows) == 1:
            first, n, ends, ids, sizes = rows[0]
            for k in range(at, len(ids)):
                nodes.append([first, k + 1, nodes[above][0] if above >= 0 else parent, n, 0, 0, (n - 1) * sizes[k], _NOBODY, above])
                above = len(nodes) - 1
            nodes[above][7] = ends
            continue
        middle = rows[len(rows) // 2][3]
        pivot = middle[at] if at < len(middle) else -1
        less, same, more = [], [], []
        for row in rows:
            found = row[3][at] if at < len(row[3]) else -1
            (less if found < pivot else more if found > pivot else same).append(row)
        todo += [(part, at, above) for part in (less, more) if part]
        if pivot < 0:  # different sequences: only one of them ends here
            nodes[above][7] = same[0][2]
            continue
        n = sum(row[1] for row in same)
        nodes.append([min(row[0] for row in same), at + 1, nodes[above][0] if above >= 0 else parent, n, 0, 0, (n - 1) * same[0][4][at], _NOBODY, above])
        todo.append((same, at + 1, len(nodes) - 1))
    for node in reversed(nodes):  # parents stand before their children
        node[5] = max(node[5], 1)
        if node[8] >= 0:
            above = nodes[node[8]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _finished(local: DataFrame) -> DataFrame:
    """The nodes of local buckets (round, node, reach, digit), with their round and whether they are the bucket's top."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.bool_()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [*names, "round", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []

        def close() -> None:
            if held:
                found.extend((*node[:8], now[0], node[8] < 0) for node in bucket_nodes(held, now[2], now[1]))

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["round"], row["node"], row["reach"], row["digit"])
                if key != now:
                    close()
                    now, held = key, []
                held.append((row["first"], row["n"], row["ends"], row["ids"], row["sizes"]))
                if len(found) >= 20_000:
                    yield batch_of(found)
                    found = []
        close()
        if found:
            yield batch_of(found)

    key = ["round", "node", "reach", "digit"]
    dealt = local.repartition(*key).sortWithinPartitions(*key)
    return common.map_arrow(dealt, run, f"{_NODE}, round int, top boolean")


def _round(members: DataFrame, local_turns: int, number: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One radix round over members (parent, node, depth, first, n, ends, ids, sizes) of large buckets.

    Returns the buckets with how far their members agree, the ends there, what becomes local, and the members of the next round.
    """
    spans = members.groupBy("parent", "node", "depth").agg(F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"), F.sum("n").alias("n_convs"))
    differ = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    reach = F.when(differ > 0, differ - 1).otherwise(F.size("low.ids")).cast("int")
    spans = spans.withColumn("reach", reach).select("parent", "node", "depth", "reach", "n_convs", F.slice("low.sizes", F.lit(1), F.col("reach")).alias("sizes"))
    spans = common.stage(spans, "trie-spans")
    rows = members.drop("parent", "depth").join(_small(spans.select("node", "reach")), "node")
    ends = rows.where(F.size("ids") == F.col("reach")).select("node", "ends")
    kids = rows.where(F.size("ids") > F.col("reach")).withColumn("digit", F.get("ids", F.col("reach")))
    counted = kids.groupBy("node", "digit").agg(F.min("first").alias("child"), F.count("*").alias("k"), F.sum(F.size("ids") - F.col("reach")).alias("turns"))
    large = _small(common.stage(counted.where((F.col("k") > 1) & (F.col("turns") > local_turns)).select("node", "digit", "child"), "trie-large"))
    local = common.stage(kids.join(large, ["node", "digit"], "left_anti").withColumn("round", F.lit(number)), "trie-local")
    onward = kids.join(large, ["node", "digit"]).select(F.col("node").alias("parent"), F.col("child").alias("node"), (F.col("reach") + 1).alias("depth"), "first", "n", "ends", "ids", "sizes")
    return spans, ends, local, common.stage(onward, "trie-members")


def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, the root included."""
    spark = conversations.sparkSession
    known = classes(rebuilt(encoded_turns(conversations)))
    top = known.agg(F.min("first")).first()[0]
    if top is None:
        return spark.createDataFrame([], _NODE)
    members = known.select(F.lit(None).cast("long").alias("parent"), F.lit(top).cast("long").alias("node"), F.lit(0).alias("depth"), "first", "n", "ends", "ids", "sizes")
    rounds = []
    while not members.isEmpty():
        spans, ends, local, members = _round(members, local_turns, len(rounds))
        rounds.append((spans, common.stage(ends, "trie-ends"), local))
    local = rounds[0][2]
    for _, _, more in rounds[1:]:
        local = local.union(more)
    done = common.stage(_finished(local), "trie-nodes")
    out = done.select(*[x.split()[0] for x in _NODE.split(", ")])
    below = None
    for number in range(len(rounds) - 1, -1, -1):
        spans, ends, _ = rounds[number]
        children = done.where(F.col("top") & (F.col("round") == number)).select(F.col("parent_conv_id").alias("node"), "n_leaves", "saved_tokens")
        children = children if below is None else children.union(below)
        sums = children.groupBy("node").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        each = spans.join(sums, "node", "left").join(ends, "node", "left").withColumn("at", F.explode(F.sequence("depth", "reach")))
        last = F.col("at") == F.col("reach")
        own = F.when(F.col("at") > 0, (F.col("n_convs") - 1) * F.get("sizes", F.col("at") - 1)).otherwise(0)
        upward = Window.partitionBy("node").orderBy(F.desc("at"))
        chain = each.select(
            F.col("node").alias("conv_id"),
            F.col("at").cast("long").alias("depth"),
            F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
            "n_convs",
            F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + F.sum(own).over(upward)).cast("long").alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(_NOBODY))).otherwise(_NOBODY).alias("ends_sha256"),
            (F.col("at") == F.col("depth")).alias("top"),
        )
        chain = common.stage(chain, "trie-chain")
        out = out.union(chain.drop("top"))
        below = chain.where("top").select(F.col("parent_conv_id").alias("node"), "n_leaves", "saved_tokens")
    return out
