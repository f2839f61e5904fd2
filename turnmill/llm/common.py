"""Shared helpers of the training-data operators.

Working tables and archives go to the folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is absent (tests) a folder
of our own is set.  Nothing here uses a machine-local path on a cluster.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from turnmill.shipping import ship

#: Bytes of text handled at once inside an Arrow function.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and its Python workers, at most; one row may be larger.
ARROW_BYTES = 4 << 20
#: Bytes of a row group of staged tables, which each writing task holds in memory.
ROW_GROUP_BYTES = 16 << 20

#: Spark's setting that shuffle files go when their query has ended, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="turnmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/turnmill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.  Nothing runs this plan again, so its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[id(out)] = (weakref.ref(out, lambda _, key=id(out): _staged.pop(key, None)), path)
    return out


def forget(*staged: DataFrame) -> None:
    """Delete staged tables that no later job reads: what was made of them has been written since."""
    for df in staged:
        if id(df) in _staged:
            jvm, path = df.sparkSession._jvm, _staged.pop(id(df))[1]
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: The paths of staged tables, by the identity of their frames.
_staged: dict[int, tuple[weakref.ref, str]] = {}


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names for columns of our own that no column of a table has, in any case."""
    taken, out, k = {x.lower() for x in df.columns}, [], 0
    while len(out) < n:
        if f"_own{k}" not in taken:
            out.append(f"_own{k}")
        k += 1
    return out


def release() -> None:
    """Give freed memory back: workers wait for the next task, whatever the last one held."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _releasing(run):
    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return ran


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, with this package at hand on the workers and batches of bounded bytes."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(_releasing(run), schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of a text column, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and row limits (n + 1); null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    limits = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, limits - limits[0]


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, limits: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of words before each row (n + 1).

    Every byte above 0x7F counts as ``table`` says, so for tables that keep them
    all, words are those of the characters.
    """
    inside = table[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    starts_of_rows = limits[:-1][limits[:-1] < len(raw)]
    opens[starts_of_rows] = inside[starts_of_rows]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = limits[1:][limits[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, limits)


_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(int(_MULT), -1, 1 << 64)
        factors = np.empty((2, m), np.uint64)
        factors[0], factors[1], factors[:, 0] = _MULT, np.uint64(inverse), 1
        _powers[:] = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over table values of its bytes, mixed.

    Works through blocks of words, so that its memory does not grow with the text.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        power, inverse = _powers_to(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[raw[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of ragged runs, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return skip + np.arange(total)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file in the shared folder, open for writing."""
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def size_of(uri: str) -> int:
    system, path = _filesystem(uri)
    return system.get_file_info(path).size


def read_range(uri: str, offset: int, size: int) -> bytes:
    """Bytes of a file from an offset."""
    system, path = _filesystem(uri)
    with system.open_input_file(path) as source:
        return source.read_at(size, offset)


def listing(uri: str) -> dict[str, int]:
    """Files of a folder and their sizes; none if the folder is not there."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f"{uri}/{x.base_name}": x.size for x in found if x.type == fs.FileType.File}
