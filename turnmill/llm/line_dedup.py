"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines of at least ``MIN_CHARS`` characters within ``EDITS`` edits of each other
are linked; shorter ones only equal each other.  A line of length l is cut into
EDITS + 1 even segments.  If two lines are within EDITS edits, some segment of the
shorter one stands unchanged in the longer one, at a place that the difference
of lengths and the segment's number narrow down to a few.  So every different
line is indexed by its segments (key: number, size, content) and probes the
index with those few substrings for each length it may meet; probes that fall
together for several lengths are one key.  A key's rows are dealt once: an
aggregate finds the keys that are indexed, and what meets them is joined to it.

Keys that lines share are few.  Keys of up to ``WHOLE_KEY`` lines are paired out.
In larger ones each member is paired with the key's ``PIVOTS`` most central lines,
a linear number.  Pairs pass if their lengths and the letter counts of the
whole lines and of their halves allow so few edits, and are then verified by a
bit-parallel edit distance on a band of 2 * EDITS + 1 diagonals, after their
common beginning and end.

Large keys are mostly what lines of one template share.  Their lines, where the
pivots left several components, meet again by short pieces: of any EDITS + 1
pieces of a line one stands unchanged in each line within EDITS edits, at most so
far away, so that each line is indexed by its EDITS + 1 rarest pieces and probes
the index with all.  A probe meets a piece only if that indexes a line of another
component and of a length that fits, and is made once.  Pieces that many lines are indexed by come
last, and only pairs of components that are still different meet in them, in
blocks of bounded size.  So no link between two classes is lost, and no large key is paired out.

Links join lines into classes.  A class with at least ``MIN_COPIES`` lines, over
all documents, is a repeat: its first line (by document id, then line) stays,
the others go.  Smaller classes stay as they are.

Defined results: null text has no lines; lines of white space only have no class
and always stay.  Rows with null id come after all others.  Repeated rows (same
id and text) share every decision, so that a first line stays in each of them.
Very long lines are joined like any other.  Lines are told apart by 128 bits of
hash.  An empty table gives an empty one.  Other columns are passed through
``dedup_lines`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

EDITS = 2
MIN_CHARS = 16
MIN_COPIES = 2
#: Central lines that each member of a large key is paired with.
PIVOTS = 4
#: Lines of a key that is paired out: a line of a larger one makes about as many probes for pieces as it would meet lines.
WHOLE_KEY = 64
#: Characters of the pieces by which lines of large keys meet, at least, and how many pieces a long line has, at most.
PIECE, PIECES = 4, 12
#: Lines of a piece that meet the others at once; larger ones are dealt out in such blocks.
BLOCK_LINES = 512
#: Rows that may be broadcast, after they have been counted; beyond it, a merge join.
BROADCAST_ROWS = 200_000


def line_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, text_key, line_no, line, h1, h2) of every line."""
    own = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return own.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _has_text(line: str) -> Column:
    return (F.ascii(line) > 32) | F.col(line).rlike(r"[^\s]")  # the first character mostly tells


def key_slots(edits: int) -> list[list[tuple[int, int, int, bool]]]:
    """For each remainder of a length by edits + 1, its keys: segment, start and size against the even ones, and whether it is a segment of the line's own.

    The others are substrings that may equal a segment of a line up to ``edits`` shorter, or as long.
    """
    parts = edits + 1
    out = []
    for remainder in range(parts):
        found: dict[tuple[int, int, int], bool] = {}
        for shorter in range(edits + 1):
            fewer, rest = divmod(remainder - shorter, parts)
            for k in range(parts):
                later = max(0, k - (parts - rest))  # longer segments come last
                for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1):
                    key = (k, fewer * k + later + shift, fewer + (k >= parts - rest))
                    found[key] = found.get(key, False) or (shorter == 0 and shift == 0)
        out.append([(*key, own) for key, own in sorted(found.items())])
    return out


def segment_keys(line: str, edits: int) -> list[tuple[Column, Column]]:
    """The keys of a line (null beyond its last one), each with whether it belongs to the index."""
    slots = key_slots(edits)
    length = F.length(line)
    base, remainder = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    out = []
    for j in range(max(map(len, slots))):
        pick = lambda n: F.get(F.array(*[F.lit(x[j][n] if j < len(x) else None) for x in slots]), remainder)  # noqa: B023, E731
        k, start, size = pick(0), base * pick(0) + pick(1), base + pick(2)
        inside = k.isNotNull() & (size > 0) & (start >= 0) & (start + size <= length)
        out.append((F.when(inside, F.xxhash64(k, size, F.substring(line, start + 1, size))), pick(3)))
    return out


def edits_within(a: Column, b: Column, most: int) -> Column:
    """Whether two strings are within ``most`` edits, for lengths that differ by ``most`` at most.

    Bit-parallel over a diagonal band: bit k of a vector stands for the row that
    is k - most below the diagonal.  Down the diagonal the band's last row gives
    the distance; once that row has left the string, the distance goes along it.
    """
    band = 2 * most + 1
    full = (1 << band) - 1
    long = lambda v: F.lit(v).cast("long")
    bit_not = lambda v: v.bitwiseXOR(long(full))
    n_rows, n_columns = F.length(a), F.length(b)

    def step(state: Column, at: Column, rows: Column) -> Column:
        match = long(0)
        for k in range(band):
            match = match + F.when(F.get(rows, at["j"] + (k - most)) == at["char"], long(1 << k)).otherwise(long(0))
        return F.struct(state["d"].alias("d"), state["vp"].alias("vp"), state["vn"].alias("vn"), match.alias("x"), at["j"].alias("j"))

    def diagonal(state: Column) -> Column:
        vp, vn, x = state["vp"], state["vn"], state["x"]
        d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(long(full))
        return F.struct(state["d"].alias("d"), vp.alias("vp"), vn.alias("vn"), d0.alias("d0"), state["j"].alias("j"))

    def finish(state: Column) -> Column:
        vp, vn, d0, j = state["vp"], state["vn"], state["d0"], state["j"]
        hp = vn.bitwiseOR(bit_not(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        past = j - (n_rows - most)  # steps since the band's last row left the string; the row's bit moves up by one each
        bit = F.call_function("shiftright", long(1 << (2 * most)), F.greatest(past + 1, F.lit(0)))
        along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
        down = F.when(d0.bitwiseAND(long(1 << (2 * most))) == 0, 1).otherwise(0)
        d = state["d"] + F.when(past < 0, down).otherwise(along)
        half = F.shiftright(d0, 1)
        return F.struct(d.cast("int").alias("d"), hn.bitwiseOR(bit_not(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"))

    start = F.struct(F.least(F.lit(most), n_rows).alias("d"), long(full & ~((1 << most) - 1)).alias("vp"), long(0).alias("vn"))
    chars = F.struct(F.split(a, "").alias("rows"), F.transform(F.split(b, ""), lambda c, j: F.struct(c.alias("char"), j.alias("j"))).alias("columns"))
    distance = _bind(chars, lambda s: F.aggregate(s["columns"], start, lambda acc, at: _bind(_bind(step(acc, at, s["rows"]), diagonal), finish), lambda acc: acc["d"]))
    return F.when((n_rows > 0) & (n_columns > 0), distance <= most).otherwise(F.greatest(n_rows, n_columns) <= most)


def _bind(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _same_start(a: Column, b: Column) -> Column:
    """How many characters two different strings begin with alike, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((step <= most - n) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n))


def _after(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def different_parts(a: Column, b: Column) -> Column:
    """(a, b) without their common beginning and end, reversed, which changes no edit distance."""
    cut = lambda x, y: _bind(F.struct(x.alias("a"), y.alias("b"), _same_start(x, y).alias("n")), lambda s: F.struct(_after(s["a"], s["n"]).alias("a"), _after(s["b"], s["n"]).alias("b")))
    return _bind(cut(a, b), lambda s: cut(F.reverse(s["a"]), F.reverse(s["b"])))


# Characters that signatures count, each set as one; and codes of counts modulo 8 whose bits differ as often as the counts are apart.
LETTERS = ["e0", "t1", "a2", "o3", "i4", "n5", "s6", "h7", "r8", "d9", "l", "c", "u", "m", "w", " "]
AROUND = [0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000]
SIGNATURES = ["whole", "first", "second"]


def with_signatures(lines: DataFrame) -> DataFrame:
    """lines with codes of the letter counts of each line and of its halves."""
    half = F.substring("line", F.lit(1), F.floor(F.length("line") / 2).cast("int"))
    count = lambda text, letters: F.length(text) - F.length(F.translate(text, letters, ""))
    counted = lines.withColumn("half", half).withColumns({"in_line": F.array(*[count(F.col("line"), x) for x in LETTERS]), "in_half": F.array(*[count(F.col("half"), x) for x in LETTERS])})
    places = F.sequence(F.lit(0), F.lit(len(LETTERS) - 1))
    around = F.array(*map(F.lit, AROUND))
    code = lambda value: F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.get(around, value(k) % 8).cast("long"), 4 * k)))
    at = lambda name: lambda k: F.get(F.col(name), k)
    return counted.withColumns({"whole": code(at("in_line")), "first": code(at("in_half")), "second": code(lambda k: at("in_line")(k) - at("in_half")(k))}).drop("half", "in_line", "in_half")


def may_link(edits: int) -> Column:
    """Exact bounds for rows with lengths and signatures of two lines (the other's end in 2): an edit moves a count by two at most, in the line and in each half."""
    near = F.abs(F.col("length") - F.col("length2")) <= edits
    for name in SIGNATURES:
        near = near & (F.bit_count(F.col(name).bitwiseXOR(F.col(f"{name}2"))) <= 2 * edits)
    return near


def shared_keys(usable: DataFrame, edits: int) -> DataFrame:
    """(key, h1, own, pivot) of the lines that meet an index line (the pivot, the least) in a key, without the pivots themselves."""
    slots = [f"key{j}" for j in range(max(map(len, key_slots(edits))))]
    keys = [key for key, _ in segment_keys("line", edits)]
    # Equal lines are one before anything is dealt by key.
    lines = usable.select("h1", F.length("line").alias("length"), *[k.alias(x) for x, k in zip(slots, keys, strict=True)]).groupBy("h1").agg(F.max("length").alias("length"), *[F.max(x).alias(x) for x in slots])
    own = F.get(F.array(*[F.array(*[F.lit(x[3]) for x in some]) for some in key_slots(edits)]), F.col("length") % (edits + 1))
    each = lines.select("h1", own.alias("owns"), F.posexplode(F.array(*slots)).alias("slot", "key")).where("key is not null").select("key", "h1", F.get("owns", F.col("slot")).alias("own"))
    # Summed before they are dealt; the join can split a key that many lines have.
    pivots = each.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("h1"))).alias("pivot"), F.count("*").alias("size")).where("pivot is not null and size > 1")
    return each.hint("merge").join(pivots.select("key", "pivot"), "key").where("h1 <> pivot")


def piece_size(length: Column, edits: int) -> Column:
    """A line's pieces are longer the longer it is, so that few lines have one by chance."""
    return F.least(F.greatest(F.lit(PIECE), F.floor(length / PIECES)), F.floor(length / (edits + 1))).cast("int")


def rarest_pieces(lines: DataFrame, edits: int) -> DataFrame:
    """(piece, node): the edits + 1 pieces of each line (node, line, length) that fewest lines have."""
    size = piece_size(F.col("length"), edits)
    places = F.sequence(F.lit(0), F.floor(F.col("length") / size).cast("int") - 1)
    each = lines.where(size > 0).select("node", F.posexplode(F.transform(places, lambda k: F.xxhash64(size, k, F.substring("line", k * size + 1, size)))).alias("at", "piece"))
    counted = each.hint("merge").join(each.groupBy("piece").agg(F.count("*").alias("lines")), "piece")
    order = Window.partitionBy("node").orderBy("lines", "at")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= edits + 1).select("piece", "node")


def piece_probes(lines: DataFrame, edits: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(piece, node2): the substrings of lines that may be pieces of lines up to some edits shorter, or as long; other columns of the lines end in 2, too.

    A piece is moved by s where |s| + |difference of lengths - s| edits or fewer add or remove characters.
    """
    length = F.col("length")
    sizes = F.array_distinct(F.array(*[piece_size(length - k, edits) for k in range(edits + 1)]))
    shifts = F.array(*map(F.lit, range(-(edits // 2), edits + 1)))

    def at(size: Column, k: Column, start: Column) -> Column:
        return F.when((start >= 0) & (start + size <= length), F.xxhash64(size, k, F.substring("line", start + 1, size)))

    def places(size: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(length / size).cast("int") - 1), lambda k: F.transform(shifts, lambda s: at(size, k, k * size + s))))

    found = F.flatten(F.transform(F.filter(sizes, lambda x: x > 0), places))
    return lines.select(F.explode(F.array_distinct(F.array_compact(found))).alias("piece"), *[F.col(x).alias(f"{x}2") for x in ("node", *also)])


def piece_facts(picks: DataFrame) -> DataFrame:
    """Of each piece in picks (piece, length, component): the lines it indexes, and the bounds of their lengths and components."""
    bounds = [f(x).alias(name) for x, f, name in (("length", F.min, "shortest"), ("length", F.max, "longest"), ("component", F.min, "least"), ("component", F.max, "most"))]
    return picks.groupBy("piece").agg(F.count("*").alias("size"), *bounds)


def open_probes(probes: DataFrame, facts: DataFrame, edits: int) -> DataFrame:
    """The probes (piece, length2, component2) of pieces that index a line of another component, and one that is as long or up to some edits shorter."""
    other = (F.col("least") != F.col("component2")) | (F.col("most") != F.col("component2"))
    fits = (F.col("shortest") <= F.col("length2")) & (F.col("longest") >= F.col("length2") - edits)
    same = facts.withColumnRenamed("piece", "facts_piece")
    return probes.hint("merge").join(same, (F.col("piece") == F.col("facts_piece")) & other & fits).select(*probes.columns, "size")


def similar_lines(rows: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Lines (node, h1, h2, n, first) that meet others in a key, and links (a, b) of nodes that join those within some edits into components."""
    usable = rows.where((F.length("line") >= min_chars) & _has_text("line"))
    met = common.stage(shared_keys(usable, edits), "line-met")
    members = met.select("key", "h1", "own").union(met.select("key", F.col("pivot").alias("h1"), F.lit(True).alias("own"))).distinct()
    needed = common.stage(members.select("h1").distinct(), "line-needed")
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed.hint("merge")
    chosen = usable.join(side, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"), F.count("*").alias("n"), F.min(place()).alias("first_place"))
    texts = common.stage(with_signatures(chosen.withColumns({"node": F.monotonically_increasing_id(), "length": F.length("line")})), "line-texts")
    known = texts.select("h1", "node", "length", *SIGNATURES)
    entries = common.stage(members.hint("merge").join(known, "h1").drop("h1"), "line-entries")
    common.forget(met, needed)
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"))
    entries = entries.hint("merge").join(sizes.where("size > 1"), "key")
    central = entries.groupBy("node").agg(F.sum("size").alias("central"))
    order = Window.partitionBy("key").orderBy(F.desc("central"), "node")
    whole = F.col("size") <= WHOLE_KEY
    tops = entries.where(~whole).hint("merge").join(central, "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots).drop("place", "central")
    tops = tops.unionByName(entries.where(whole)).drop("size")

    def meeting(one: DataFrame, other: DataFrame, on: list[str], differ: Column) -> DataFrame:
        other = other.select(*on, *[F.col(x).alias(f"{x}2") for x in other.columns if x not in on])
        met = one.hint("merge").join(other, on).where(differ & may_link(edits))
        return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
        both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
        # Few bytes may be much work: more tasks than bytes alone would give.
        both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        close = _bind(different_parts(F.col("line_a"), F.col("line_b")), lambda s: edits_within(s["a"], s["b"], edits))
        return common.stage(both.where(close).select("a", "b"), "line-links")

    differ = (F.col("node") < F.col("node2")) | (~whole & (F.col("node") > F.col("node2")))
    links = verified(meeting(entries, tops, ["key"], differ & (F.col("own") | F.col("own2"))))
    large = entries.where(~whole & (F.col("size") > pivots + 1))
    if large.isEmpty():
        return texts, links
    found = common.stage(components(links), "line-components")
    parts = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = parts.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    open_lines = common.stage(parts.join(several, "key", "left_semi").select("node").distinct(), "line-open")
    if open_lines.isEmpty():
        return texts, links
    open_lines = common.stage(texts.join(open_lines, "node", "left_semi").select("node", "line", "length", *SIGNATURES), "line-open-texts")
    picked = common.stage(rarest_pieces(open_lines, edits), "line-pieces")
    asked = None
    for common_piece in (False, True):
        found = common.stage(components(links), "line-components")
        named = open_lines.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = named.select("node", "length", "component", *SIGNATURES)
        picks = picked.hint("merge").join(known, "node")
        other = known.select(F.col("node").alias("node2"), *[F.col(x).alias(f"{x}2") for x in ("component", *SIGNATURES)])
        if asked is None:  # those that meet no other component now never will: components only grow together
            probes = piece_probes(named, edits, ("length", "component"))
            asked = common.stage(open_probes(probes, piece_facts(picks), edits).drop("component2"), "line-asked")
        these = asked.where((F.col("size") > BLOCK_LINES) == common_piece)
        if common_piece and these.isEmpty():
            break
        these = these.hint("merge").join(other, "node2")
        # Each line meets all blocks of the lines that a piece indexes; the pieces of few lines have one.
        blocks = F.ceil(F.col("size") / BLOCK_LINES).cast("int")
        if common_piece:
            facts = common.stage(piece_facts(picks).where(F.col("size") > BLOCK_LINES), "line-piece-facts")
            sides = picks.hint("merge").join(facts.select("piece", "size"), "piece").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).drop("size")
            these = open_probes(these.drop("size"), facts, edits).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        else:
            sides, these = picks.withColumn("block", F.lit(0)), these.withColumn("block", F.lit(0))
        # The line that a piece indexes is the shorter one, if they differ.
        met = sides.hint("merge").join(these.drop("size"), ["piece", "block"]).where((F.col("component") != F.col("component2")) & (F.col("length") <= F.col("length2")) & may_link(edits))
        links = common.stage(links.union(verified(met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())), "line-links")
    return texts, links


def place() -> Column:
    """Where a line stands among all: rows with null id come last."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "line_no")


def line_decisions(rows: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Of each line (h1, h2) that repeats or is linked: the first line of its class, the class's lines, and the class's different texts."""
    repeats = rows.where(_has_text("line")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place()).alias("first_place")).where("n > 1")
    texts, links = similar_lines(rows, edits, min_chars)
    found = common.stage(components(links), "line-components")
    linked = texts.hint("merge").join(found, "node").select("h1", "h2", "n", "first_place", "component")
    alone = repeats.hint("merge").join(linked.select("h1", "h2"), ["h1", "h2"], "left_anti")
    # A class of one text is named by its hashes, any other by its component.
    known = common.stage(alone.withColumn("component", F.lit(None).cast("long")).select(linked.columns).union(linked), "line-known")
    name = [F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2")).alias("c2")]
    classes = known.groupBy(*name).agg(F.sum("n").alias("class_lines"), F.min("first_place").alias("class_first"), F.count("*").alias("class_texts"))
    same = known.select("h1", "h2", *name).withColumnsRenamed({"c1": "k1", "c2": "k2"}).hint("merge").join(classes, (F.col("k1") == F.col("c1")) & F.col("k2").eqNullSafe(F.col("c2")))
    return same.select("h1", "h2", "class_lines", "class_first", "class_texts")


def line_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, min_copies: int = MIN_COPIES) -> DataFrame:
    """Of every line: id, line_no, the id and line_no of its class's first line, the class's lines and different texts, and whether it stays."""
    rows = line_rows(docs, id_column, text)
    decided = common.stage(line_decisions(rows, edits, min_chars), "line-decisions")
    out = rows.select("id", "text_key", "line_no", "h1", "h2", _has_text("line").alias("some")).hint("merge").join(decided, ["h1", "h2"], "left")
    first = F.col("class_first")
    is_first = F.col("id").eqNullSafe(first["id"]) & (F.col("text_key") == first["text_key"]) & (F.col("line_no") == first["line_no"])
    alone = first.isNull()
    own = lambda value, other: F.when(F.col("some"), F.when(alone, value).otherwise(other))
    return out.select(
        F.col("id").alias(id_column),
        "text_key",
        "line_no",
        own(F.col("id"), first["id"]).alias("class_id"),
        own(F.col("line_no"), first["line_no"]).alias("class_line_no"),
        own(F.lit(1).cast("long"), F.col("class_lines")).alias("class_lines"),
        own(F.lit(1).cast("long"), F.col("class_texts")).alias("class_texts"),
        (alone | (F.col("class_lines") < min_copies) | is_first).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, min_copies: int = MIN_COPIES, drop_emptied: bool = False) -> DataFrame:
    """docs without the lines that repeat; the columns stay.

    Texts that keep no line with text become what white space they have, or go if drop_emptied: they repeat others in full.
    """
    row_id, row_key, key, gone_lines, all_lines, rest_text = common.free_names(docs, 6)
    gone = line_classes(docs, id_column, text, edits, min_chars, min_copies).where("not kept")
    per_text = gone.groupBy(F.col(id_column).alias(row_id), F.col("text_key").alias(row_key)).agg(F.collect_set("line_no").alias(gone_lines))
    per_text = common.stage(per_text, "line-gone")
    lines_gone = per_text.agg(F.sum(F.size(gone_lines))).first()[0] or 0  # counted before it may be broadcast
    side = F.broadcast(per_text) if lines_gone <= 10 * BROADCAST_ROWS else per_text.hint("merge")
    joined = docs.withColumn(key, F.xxhash64(F.col(text))).join(side, F.col(id_column).eqNullSafe(F.col(row_id)) & (F.col(key) == F.col(row_key)), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_lines))
    rest = F.array_join(F.transform(stay, lambda k: F.get(F.col(all_lines), k)), "\n")
    cut = joined.withColumn(all_lines, lines).withColumn(rest_text, F.when(F.col(gone_lines).isNull(), F.col(text)).otherwise(rest))
    if drop_emptied:
        cut = cut.where(F.col(gone_lines).isNull() | _has_text(rest_text))
    return cut.select(*[F.col(rest_text).alias(c) if c == text else F.col(c) for c in docs.columns])
