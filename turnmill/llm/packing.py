"""Sequence packing by power-of-two decomposition.

A document of n ids (its end id included) is cut into pieces whose lengths are
the powers of two that make up n, none above ``max_length``, larger ones first.
Pieces of equal length form a bucket (column ``bucket``: its power of two), and
each has its place there (``bucket_place``, gapless for each task).  Each piece is a
sequence of its own: no sequence crosses documents and none needs padding.
Batches are drawn from one bucket at a time, from the folders that
``write_buckets`` makes.  Packing is a single pass without shuffle.

Defined results: null text counts as empty, so that its only id is the end id.
Repeated rows give their own pieces.  Very long texts are cut like any other.
Sequence ids are unique, and the same when a task runs again: they number the
pieces of a partition.  Other columns of the input are ignored, whatever their
names.  An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .tokens import Encoder

MAX_LENGTH = 4096
#: The id after each document.
END_ID = 2


def binary_pieces(totals: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of the pieces of documents with so many ids."""
    top = max_length.bit_length() - 1
    lengths = 1 << np.arange(top, -1, -1)
    counts = (totals[:, None] // lengths) & 1
    counts[:, 0] = totals // max_length
    doc, power = np.nonzero(counts)
    times = counts[doc, power]
    doc, size = np.repeat(doc, times), np.repeat(lengths[power], times)
    ends = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(totals)])[doc]
    return doc, ends - size - first, size


def places(size: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next places in their buckets, and the buckets, of pieces of some lengths; used counts on."""
    bucket = np.log2(size).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=len(used))
    place = np.empty(len(size), np.int64)
    place[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(used, counts)
    used += counts
    return place, bucket


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces, with their ids, to a folder for each bucket."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its ids if asked for.

    tokenizer_path: a vocabulary file that is there on every executor; by default that of the public package.
    max_length: a power of two.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    docs = docs.select(id_column, text)
    fields = [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket_place")]
    schema = T.StructType([docs.schema[id_column], *fields, T.StructField("bucket", T.IntegerType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, False)
        sequence = TaskContext.get().partitionId() << 40
        used = np.full(max_length.bit_length(), sequence, np.int64)
        for batch in common.slices(batches, text):
            ids, limits = encoder.encode(batch.column(1))
            n = batch.num_rows
            with_end = np.insert(ids, limits[1:], end_id).astype("<u4")
            totals = np.diff(limits) + 1
            doc, start, size = binary_pieces(totals, max_length)
            ends = np.cumsum(size)
            view = memoryview(with_end).cast("B")
            sums = np.fromiter((zlib.crc32(view[4 * (b - s) : 4 * b]) for b, s in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(doc))
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, size, sums, totals[doc], sequence + np.arange(len(doc)), np.zeros(len(doc), np.int64))), *map(pa.array, places(size, used))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(with_end.astype(np.int32))))
            sequence += len(doc)
            assert len(totals) == n
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return common.map_arrow(docs, run, schema)
