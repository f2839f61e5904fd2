"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian ids, documents end to end, each
followed by a separator id.  The scan cuts files into blocks, finds the
separators of a block by a vector search, and stitches blocks by a prefix scan:
a first pass gives each block's number of separators and its last one, a
running sum and a running last value give each block the documents and the last
separator before it, and a second pass emits every document in the block that
holds its separator.  Any number of tasks can work on one file.

Defined results: an empty document has 0 tokens; ids after the last separator
of a file form a last document with ``ended`` false; a file without ids has no
documents.  For ``count_tokens``, null text counts as empty, and repeated rows
and rows with a null or repeated id each have a document of their own.  Very long texts
count whole: a document may span any number of blocks.  There is no order
among documents, so none tie.  Other columns play no part, whatever their
names.  An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

#: Ids of a block.
BLOCK_IDS = 8 << 20
#: The separator of files that we write; with plain encoding no text holds it.
SEPARATOR = 49407

_BLOCK = "file string, block long, first long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Write a token file of 16-bit ids for each task; the rows (file, ordinal, document id) say which document is where.

    A task that runs again writes another file, and only the files named in the result count.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, ordinal = Encoder.of(tokenizer_path, True), None, 0
        try:
            for batch in common.slices(batches, "text"):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.ids"
                    out = common.create(name)
                ids, limits = encoder.encode(batch.column(1))
                out.write(np.insert(ids, limits[1:], separator).astype("<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return common.map_arrow(docs, run, f"file string, ordinal long, id {kind}")


def _separators(row: dict, separator: int, width: int) -> np.ndarray:
    found = common.read_range(row["file"], row["first"] * width, row["n_ids"] * width)
    return np.flatnonzero(np.frombuffer(found, f"<u{width}") == separator) + row["first"]


def scan_token_files(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents (file, ordinal, start, n_tokens, ended) of files (file, n_bytes).

    width: bytes of an id.
    """
    total = F.expr(f"n_bytes div {width}")
    count = F.ceil(total / F.lit(block_ids))
    blocks = (
        files.where(total > 0)
        .select("file", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
        .select("file", "block", (F.col("block") * block_ids).alias("first"), F.least(F.lit(block_ids).cast("long"), F.col("total") - F.col("block") * block_ids).alias("n_ids"), ((F.col("block") + 1) * block_ids >= F.col("total")).alias("is_last"))
        .repartition("file", "block")
    )

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [_separators(r, separator, width) for r in rows]
            extra = [pa.array([len(x) for x in found], pa.int64()), pa.array([int(x[-1]) if len(x) else None for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n_separators", "last_separator"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = _separators(r, separator, width)
                before = -1 if r["last_before"] is None else r["last_before"]
                end = r["first"] + r["n_ids"]
                ended = np.ones(len(at), bool)
                if r["is_last"] and end - 1 != (at[-1] if len(at) else before):
                    at, ended = np.append(at, end), np.append(ended, False)
                start = np.concatenate([[before], at[:-1]])[: len(at)] + 1
                ordinal = (r["docs_before"] or 0) + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(at), pa.string()), *map(pa.array, (ordinal, start, at - start, ended))], ["file", "ordinal", "start", "n_tokens", "ended"])

    sums = common.stage(common.map_arrow(blocks, summary, f"{_BLOCK}, is_last boolean, n_separators long, last_separator long"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = sums.withColumns({"docs_before": F.sum("n_separators").over(before), "last_before": F.max("last_separator").over(before)})
    return common.map_arrow(stitched.repartition("file", "block"), documents, "file string, ordinal long, start long, n_tokens long, ended boolean")


def file_sizes(files: DataFrame) -> DataFrame:
    """(file, n_bytes) of the files of a column ``file``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([common.size_of(x) for x in batch.column(0).to_pylist()], pa.int64())], ["file", "n_bytes"])

    return common.map_arrow(files.select("file").distinct(), run, "file string, n_bytes long")


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, start, n_tokens) of every document, through token files in the shared folder."""
    folder = common.scratch(docs.sparkSession, "tokens")
    placed = common.stage(write_token_files(docs, folder, id_column, text, tokenizer_path), "token-places")
    found = scan_token_files(file_sizes(placed))
    # Both sides grow with the documents; their compressed size must not make one look small enough to broadcast.
    return placed.hint("merge").join(found, ["file", "ordinal"]).select(F.col("id").alias(id_column), "start", "n_tokens")
