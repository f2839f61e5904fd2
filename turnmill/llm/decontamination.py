"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents of one scan task (about ``SHARD_BYTES`` of
text).  Its words become symbols: the words that benchmark windows use have a
code each, every run of other words (and every document's end) is one *other*
symbol.  Over this string we build a suffix array, its Burrows-Wheeler
transform in a wavelet matrix, and sampled suffix positions.  All benchmark
windows are searched backward at once; occurrences are located by walking the
LF mapping to a sampled suffix, and merged into removal spans.

There is no shuffle: the benchmark travels to the shards in blocks of bounded
size (``BLOCK_BYTES``) and of at most ``MOST_WORDS`` different words, one pass
over the documents for each block, and a pass adds its spans to those of the
passes before.

Defined results: null text has no words and is never contaminated.  Documents
of any length are handled whole.  Repeated rows are judged alike, each for
itself.  A benchmark row with null or wordless text has no window; one with a
null id marks words but is never listed among the items.  Rows with the same
item id are one item.  An empty benchmark leaves everything clean, and an empty
table gives an empty one.  Other columns, whatever their names, pass through
``remove_contamination`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a window.
WINDOW = 10
#: Bytes of text of a shard; longer documents are a shard of their own.
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Different words of a pass: symbols, with two of their own, are packed in 16 bits.
MOST_WORDS = (1 << 16) - 3
#: Every how manyth text position keeps its suffix position.
SAMPLE = 8

#: Words are runs of 0-9, a-z (after lower-casing) and everything outside ASCII.
WORD_BYTES = common.byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


class Wavelet:
    """A wavelet matrix over symbols below 2**bits, with prefix counts as its rank directory."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        row = symbols
        for level in range(bits - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            high = bit.astype(bool)
            row = np.concatenate([row[~high], row[high]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length ``at`` ends among the symbols equal to ``symbol``, in the last row."""
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            got = ones[at]
            at = np.where((symbol >> level) & 1, zeros + got, at - got)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``."""
        return self.follow(symbol, at) - self.follow(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            got = ones[at]
            bit = ones[at + 1] - got
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + got, at - got)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling; only suffixes still tied are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(3, symbols.dtype)]).astype(np.uint64)
    key = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
    order = np.argsort(key)
    first = np.ones(n, bool)
    first[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    step = 4
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        at = order[open_at]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = head[open_at] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        order[open_at] = at[again]
        key = key[again]
        new = np.ones(len(open_at), bool)
        new[1:] = key[1:] != key[:-1]
        first[open_at] |= new
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order[open_at]] = head[open_at]
        step *= 2


class FMIndex:
    """Counts and locates patterns in a string of symbols >= 1; 0 is added as its end."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = Wavelet(text[order - 1], max(1, int(n_symbols - 1).bit_length()))
        self.base = self.tree.follow(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        kept = order % SAMPLE == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """LF: the row, or limit of rows, after writing ``symbol`` in front."""
        return self.before[symbol] + self.tree.follow(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of the patterns that occur: their numbers, firsts, and limits."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            low, high = self.step(symbol, low), self.step(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to sampled suffixes."""
        out = np.empty(len(rows), np.int64)
        todo, at, walked = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.kept[at + 1] > self.kept[at]
            out[todo[hit]] = self.samples[self.kept[at[hit]]] + walked
            todo, at = todo[~hit], at[~hit]
            at = self.step(self.tree.access(at), at)
            walked += 1
        return out


def item_words(items: list[tuple[str | None, str | None]]) -> list[tuple[str | None, np.ndarray]]:
    """Names and word hashes of (name, text) items."""
    raw, limits = common.text_buffer(pa.array([text for _, text in items], pa.string()))
    raw = common.LOWER[raw]
    starts, ends, rows = common.word_spans(raw, limits, WORD_BYTES)
    hashes = common.word_hashes(raw, starts, ends)
    return [(name, hashes[rows[k] : rows[k + 1]]) for k, (name, _) in enumerate(items)]


def fitting(items: list[tuple[str | None, np.ndarray]], window: int, most: int) -> list[list[tuple[str | None, np.ndarray]]]:
    """The items in groups of at most ``most`` different words each, halved until they fit.

    A single item is cut so that each of its windows lies in one of the halves.
    """
    if not items or len(np.unique(np.concatenate([own for _, own in items]))) <= most:
        return [items]
    if len(items) > 1:
        halves = items[: len(items) // 2], items[len(items) // 2 :]
    else:
        ((name, own),) = items
        cut = (len(own) - window + 1) // 2
        if cut < 1:
            raise ValueError("a single window has too many different words")
        halves = [(name, own[: cut + window - 1])], [(name, own[cut:])]
    return [x for half in halves for x in fitting(half, window, most)]


class Phrases:
    """The windows of a block of benchmark items (name, word hashes), as codes of their words."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.words = np.unique(np.concatenate([own for _, own in items])) if items else np.zeros(0, np.uint64)
        by_length: dict[int, dict[bytes, set]] = {}
        for name, hashes in items:
            own = np.searchsorted(self.words, hashes).astype(np.int64) + 2
            size = min(window, len(own))
            for at in range(len(own) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(own[at : at + size].tobytes(), set()).add(name)
        self.groups = [
            (size, np.frombuffer(b"".join(found), np.int64).reshape(-1, size), [sorted(x - {None}) for x in found.values()])
            for size, found in sorted(by_length.items())
        ]

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Of all occurrences in a shard: the first word, the number of words, the window, and the windows' items.

        hashes: of the words of all documents; rows: the number of words before each document.
        """
        none = (np.zeros(0, np.int64),) * 3
        if not self.groups or not len(hashes):
            return *none, []
        at = np.searchsorted(self.words, hashes)
        codes = np.where(self.words[np.minimum(at, len(self.words) - 1)] == hashes, at + 2, 1)
        begins = np.zeros(len(codes), bool)
        begins[rows[:-1][rows[:-1] < len(codes)]] = True
        # A break stands before each document, and one symbol for each run of other words.
        keep = codes > 1
        keep[1:] |= codes[:-1] > 1
        keep[0] = True
        keep |= begins
        source = np.flatnonzero(keep)
        ahead = begins[source] & (codes[source] > 1)
        spot = np.arange(len(source)) + np.cumsum(ahead)
        text = np.ones(len(source) + int(ahead.sum()), np.int64)
        text[spot] = codes[source]
        word_at = np.full(len(text), -1, np.int64)
        word_at[spot] = source
        index = FMIndex(text, len(self.words) + 2)
        words, sizes, windows, names = [], [], [], []
        for size, patterns, items in self.groups:
            which, low, high = index.search(patterns)
            counts = high - low
            place = index.locate(common.ragged(low, counts))
            words.append(word_at[place])
            sizes.append(np.full(len(place), size, np.int64))
            windows.append(np.repeat(which, counts) + len(names))
            names += items
        return np.concatenate(words), np.concatenate(sizes), np.concatenate(windows), names


def _marked(n: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words some span covers."""
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + size, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def _runs(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each covered run; runs end with their document."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[rows] = True
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | cut[1:-1]
    closes[:-1] &= ~mask[1:] | cut[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def _pass(phrases: Phrases, text: str, added: list[str], schema: pa.Schema, clean: bool):
    """One pass over the documents: fills the added columns (words, spans and items); on the last pass may cut the spans out."""
    count_column, span_column, item_column = added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, SHARD_BYTES):
            raw, limits = common.text_buffer(batch.column(text))
            low = common.LOWER[raw]
            starts, ends, rows = common.word_spans(low, limits, WORD_BYTES)
            first, size, window, names = phrases.find(common.word_hashes(low, starts, ends), rows)
            n = batch.num_rows
            doc = np.searchsorted(rows, first, side="right") - 1
            old = batch.column(span_column)
            if old.null_count < n:
                old_rows = np.repeat(np.arange(n), np.diff(old.offsets.to_numpy()))
                was = old.flatten()
                old_first = was.field("first").to_numpy() + rows[old_rows]
                old_size = was.field("last").to_numpy() + rows[old_rows] - old_first + 1
                marks = _marked(len(starts), np.concatenate([first, old_first]), np.concatenate([size, old_size]))
            else:
                marks = _marked(len(starts), first, size)
            run_first, run_last = _runs(marks, rows)
            run_doc = np.searchsorted(rows, run_first, side="right") - 1
            items: list[set] = [set(x or ()) for x in batch.column(item_column).to_pylist()]
            for d, w in np.unique(np.stack([doc, window], 1), axis=0) if len(doc) else ():
                items[d].update(names[w])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(run_doc, minlength=n))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(run_first - rows[run_doc]), pa.array(run_last - rows[run_doc])], ["first", "last"]))
            made = {count_column: pa.array(np.diff(rows)), span_column: spans, item_column: pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if clean:
                made[text] = _without(batch.column(text), raw, limits, starts[run_first], ends[run_last], run_doc)
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def _without(column: pa.Array, raw: np.ndarray, limits: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The texts without the byte spans [begin, end) of their documents; untouched texts stay as they are."""
    texts = column.to_pylist()
    whole = raw.tobytes()
    at = 0
    while at < len(doc):
        d, to = doc[at], at
        parts, since = [], int(limits[d])
        while to < len(doc) and doc[to] == d:
            parts.append(whole[since : begin[to]])
            since = int(end[to])
            to += 1
        parts.append(whole[since : limits[d + 1]])
        texts[d] = b"".join(parts).decode("utf-8", "replace")
        at = to
    return pa.array(texts, column.type)


def _scan(docs: DataFrame, bench: DataFrame, text: str, item: str, item_text: str, window: int, block_bytes: int, clean: bool) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and the names of these: number of words, spans, items."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bench = bench.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    added = common.free_names(docs, 3)
    out = docs.withColumns(dict(zip(added, [F.lit(0).cast("long"), F.lit(None).cast(SPANS), F.lit(None).cast("array<string>")], strict=True)))
    groups = []
    for k in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        own = item_words([(r["item"], r["text"]) for r in part.collect()])  # at most a block
        groups += fitting(own, window, MOST_WORDS)
    for k, group in enumerate(groups):
        out = common.map_arrow(out, _pass(Phrases(group, window), text, added, to_arrow_schema(out.schema), clean and k == len(groups) - 1), out.schema)
    return out, added


def find_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, removal spans (first and last word, merged) and the item ids found, sorted as strings.

    The added columns are ``n_words``, ``spans`` and ``items``; they take the place of columns of docs with these names.
    """
    docs = docs.drop("n_words", "spans", "items")
    out, added = _scan(docs, bench, text, item, item_text, window, block_bytes, False)
    return out.withColumnsRenamed(dict(zip(added, ["n_words", "spans", "items"], strict=True)))


def remove_contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words of every occurring window cut out of their texts; the columns stay."""
    out, added = _scan(docs, bench, text, item, item_text, window, block_bytes, True)
    return out.drop(*added)


def contamination_report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document, the counts of its words, hit words and items, and a digest of the items."""
    found = find_contamination(docs.select("doc_id", "text"), bench)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
