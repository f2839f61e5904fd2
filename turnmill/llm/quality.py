"""Quality scores by a Bradley-Terry model of preference pairs.

Features of a text (shares of symbols, capitals and digits, variety of words,
word pairs and lines, repeats, lengths) are standardised and joined by their
squares.  From labelled documents we draw pairs of one preferred (label 1) and
one other (label 0), and learn weights w by logistic loss on the difference of
their features: P(a over b) = sigmoid(w . (x_a - x_b)).  A document's raw score
is w . x; the score maps it to 0..1 so that the quantile of the sample's raw
scores at its share of label 0 lies at ``THRESHOLD``.

Training takes at most ``SAMPLE_ROWS`` labelled documents, those with the lowest
hash of their id; scoring covers every whole text in one pass without shuffle.

Defined results: null text is scored as an empty one.  Labels of one id are
joined by their least.  If the sample lacks a label, every score is
``THRESHOLD`` and nothing is rejected.  Repeated rows have equal scores and teach
once.  Equal raw scores tie at equal scores.  Very long texts are scored whole.
An empty table gives an empty one.  Other columns, whatever their names, pass
through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.7
SAMPLE_ROWS = 20_000
PAIRS = 100_000
HELD_OUT = 2

_WORD = common.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_LINE = common.byte_table(b"\x0a")
#: Kinds of bytes: 1 symbols that prose rarely uses, 2 capitals, 3 digits, 4 other punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b"!#$%&*+/<=>@\\^_`{|}~", np.uint8)] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[np.frombuffer(b".,;:?'\"()[]-", np.uint8)] = 4
N_FEATURES = 14


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(keys[a:b])) for a, b in zip(rows[:-1], rows[1:], strict=True)], np.float64)


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    raw, limits = common.text_buffer(column)
    starts, ends, rows = common.word_spans(raw, limits, _WORD)
    words = common.word_hashes(raw, starts, ends)
    line_starts, line_ends, line_rows = common.word_spans(raw, limits, _LINE)
    lines = common.word_hashes(raw, line_starts, line_ends)
    size, n_words, n_lines = (np.diff(x).astype(np.float64) for x in (limits, rows, line_rows))
    some, some_words, some_lines = (np.maximum(x, 1) for x in (size, n_words, n_lines))
    kinds = _KIND[raw]
    pairs = common.mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    pairs = np.append(pairs, np.zeros(len(words) - len(pairs), np.uint64))
    within = np.maximum(rows[1:] - 1, rows[:-1])  # word pairs end before a document's last word
    pair_counts = np.maximum(within - rows[:-1], 1)
    same = np.append(words[1:] == words[:-1], False) if len(words) else np.zeros(0, bool)
    same_sums = np.concatenate([[0], np.cumsum(same)])
    distinct_pairs = np.array([len(np.unique(pairs[a:b])) for a, b in zip(rows[:-1], within, strict=True)], np.float64)
    columns = [
        np.log1p(size),
        *(_sums(kinds == k, limits) / some for k in (1, 2, 3, 4)),
        _distinct(words, rows) / some_words,
        np.log1p(_distinct(words, rows)) - 0.8 * np.log1p(n_words),
        distinct_pairs / pair_counts,
        (same_sums[within] - same_sums[rows[:-1]]) / pair_counts,
        _distinct(lines, line_rows) / some_lines,
        np.minimum(_sums(ends - starts, rows) / some_words, 40),
        np.log1p(size / some_lines),
        np.log1p(n_words),
        _sums(kinds[starts] == 1, rows) / some_words,
    ]
    return np.stack(columns, 1)


class BradleyTerry:
    """Weights of standardised features and their squares, and the place and scale of scores."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, at: float, scale: float):
        self.mean, self.spread, self.weights, self.at, self.scale = mean, spread, weights, at, scale

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([z, z * z], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (self._expand(x) @ self.weights - self.at) / self.scale
        return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 7) -> BradleyTerry:
        if not len(x) or label.min() == label.max():
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, 1.0)
        model = cls(x.mean(0), x.std(0) + 1e-6, np.zeros(2 * x.shape[1]), 0.0, 1.0)
        z = model._expand(x)
        rng = np.random.default_rng(seed)
        better, worse = (rng.choice(np.flatnonzero(label == k), pairs) for k in (1, 0))
        w = model.weights
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            part = rng.integers(0, pairs, 2048)
            difference = z[better[part]] - z[worse[part]]
            p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
            g = -(difference * p[:, None]).mean(0) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        raw = z @ w
        return cls(model.mean, model.spread, w, float(np.quantile(raw, (label == 0).mean())), float(raw.std() / 2 + 1e-9))


def is_held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of an id as text has a remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == remainder, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        x = features(batch.column("text"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), values], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """Fit on documents (doc_id, text) that labels (doc_id, quality) mark and that are not held out."""
    marked = labels.where("quality in (0, 1)").where(~is_held_out(F.col("doc_id"), 4, HELD_OUT)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = marked.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the bound of what is broadcast and collected
    # One text of each id: the least, so that repeated rows change nothing.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
    rows = common.map_arrow(joined, _features_of, "label int, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_FEATURES))
    order = np.lexsort([*x.T, rows["label"]])  # the same model whatever the order of rows
    return BradleyTerry.fit(x[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, model: BradleyTerry, text: str = "text", score_column: str = "score") -> DataFrame:
    """docs with a score of every text, in the place of any column of that name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(score_column)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            found = pa.array(model.score(features(batch.column(text))))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, found], arrow, strict=True)], schema=arrow)

    return common.map_arrow(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", is_held_out(F.col("doc_id"), 4, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold; the columns stay."""
    (name,) = common.free_names(docs, 1)
    return score(docs, train(docs, labels), score_column=name).where(F.col(name) >= THRESHOLD).drop(name)
