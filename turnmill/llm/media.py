"""Media columns: payloads as 8-bit images in archive directories, read through a Spark data source.

Storing writes each payload as an 8-bit grey PNG of 64 columns (lossless), as
members of one tar file for each task, with an index file of member offsets
beside it.  ``ArchiveSource`` plans byte ranges over the tar files of a
directory, so that many tasks can read one archive; a task finds its part of the
index by bisection, and streams the members that begin in its range as Arrow
batches of bounded size.  Neighbours are read at once and cut apart by their
offsets; a member that does not match the index is read again on its own.

Defined results: null text is an empty payload.  A payload gets bytes 0 up to a
positive multiple of 64, so an empty one has 64.  Repeated rows are members of
their own, and ties have nothing to decide.  A very long text is one member and
one batch.  An empty table makes no archive.  Other columns play no part,
whatever their names.  A tar file without its index is of a task that did not end, and is
passed over.  A member that cannot be read after all attempts ends the task, or
gives a row with its error if ``on_error`` is ``row``.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnmill.shipping import ship

from . import common

WIDTH = 64
#: Bytes of an archive that a task reads.
SPLIT_BYTES = 16 << 20
#: Bytes of members in an Arrow batch.
BATCH_BYTES = 4 << 20
ATTEMPTS = 4

_MAGIC = b"\x89PNG\r\n\x1a\n"
_MEMBER = np.dtype([("offset", "<i8"), ("size", "<i8"), ("crc32", "<i8")])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """A grey image whose samples are the payload, padded; its unpadded size is kept as text."""
    rows = max(1, -(-len(payload) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    lines[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"payload bytes\0%d" % len(payload)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows, 64) and the payload's size before padding."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, found = 8, {}
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a chunk does not match its checksum")
        found[kind] = found.get(kind, b"") + data
        at += 12 + size
    width, rows = struct.unpack(">II", found[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not of this writer")
    return np.ascontiguousarray(lines[:, 1:]), int(found[b"tEXt"].partition(b"\0")[2])


def feature(samples: np.ndarray) -> str:
    """Rows, mean and variance in thousandths, and an 8 x 8 average hash, all in whole numbers."""
    rows = len(samples)
    n = rows * WIDTH
    cells = samples.reshape(rows, 8, WIDTH // 8).sum(2, dtype=np.int64)
    band = np.arange(rows) * 8 // rows
    sums, counts = np.zeros((8, 8), np.int64), np.bincount(band, minlength=8) * (WIDTH // 8)
    np.add.at(sums, band, cells)
    total, squares = int(cells.sum()), int(np.dot(samples.ravel().astype(np.int64), samples.ravel().astype(np.int64)))
    bits = (sums * n > total * counts[:, None]).ravel()
    return f"{rows}x{WIDTH};mean={1000 * total // n};var={1000 * (n * squares - total * total) // (n * n)};ahash={np.packbits(bits).tobytes().hex()}"


class _Archive:
    """A tar file being written, and its index."""

    def __init__(self, name: str):
        self.name, self.out, self.at, self.members = name, common.create(name), 0, []

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        offset = self.at + len(head)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        self.at = offset + len(data) + -len(data) % 512
        self.members.append((offset, len(data), zlib.crc32(data)))
        return offset

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        with common.create(f"{self.name}.index") as index:
            index.write(np.array(self.members, _MEMBER).tobytes())


def store_media(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every text as a member of an archive; the rows (file, offset, document id) say which is where."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in common.slices(batches, "text"):
            archive = archive or _Archive(f"{folder}/{uuid.uuid4().hex}.tar")
            raw, limits = common.text_buffer(batch.column(1))
            whole = raw.tobytes()
            offsets = [archive.add(f"{len(archive.members)}.png", encode_png(whole[limits[k] : limits[k + 1]])) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([archive.name] * batch.num_rows), pa.array(offsets), batch.column(0)], ["file", "offset", "id"])
        if archive is not None:
            archive.close()

    return common.map_arrow(docs, run, f"file string, offset long, id {kind}")


class _Range(InputPartition):
    def __init__(self, file: str, first: int, limit: int):
        self.file, self.first, self.limit = file, first, limit


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.on_error = options.get("on_error", "raise")

    def partitions(self) -> list[InputPartition]:
        sizes = common.listing(self.path)
        files = {f: n for f, n in sizes.items() if f.endswith(".tar") and f"{f}.index" in sizes}
        return [_Range(f, a, a + self.split) for f, n in sorted(files.items()) for a in range(0, n, self.split)] or [_Range("", 0, 0)]

    def member(self, file: str, member: np.void) -> tuple[bytes | None, str | None]:
        """A member's bytes, read again after a failure, or the last error."""
        for k in range(self.attempts):
            try:
                data = common.read_range(file, int(member["offset"]), int(member["size"]))
                if len(data) != member["size"] or zlib.crc32(data) != member["crc32"]:
                    raise OSError("its bytes do not match the index")
                return data, None
            except (OSError, EOFError) as e:
                error = f"{file} at {member['offset']}: {e}"
                if k + 1 < self.attempts:
                    time.sleep(0.05 * 2**k)
        if self.on_error == "raise":
            raise OSError(error)
        return None, error

    @staticmethod
    def index_part(file: str, first: int, limit: int, block: int = 4096) -> np.ndarray:
        """The members that begin in a range, by bisection over blocks of the index, which is in order."""
        name, width = f"{file}.index", _MEMBER.itemsize
        n = common.size_of(name) // width
        entry = lambda k: int(np.frombuffer(common.read_range(name, k * width, width), _MEMBER)["offset"][0])
        low, high = 0, -(-n // block)  # the block before the first that begins at or behind the range's start
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if entry(middle * block) < first else (low, middle)
        found = []
        for k in range(max(low - 1, 0) * block, n, block):
            part = np.frombuffer(common.read_range(name, k * width, min(block, n - k) * width), _MEMBER)
            found.append(part[(part["offset"] >= first) & (part["offset"] < limit)])
            if part["offset"][-1] >= limit:
                break
        return np.concatenate(found) if found else np.zeros(0, _MEMBER)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        own = self.index_part(partition.file, partition.first, partition.limit)
        at = 0
        while at < len(own):
            begin = int(own["offset"][at])
            to = max(at + 1, int(np.searchsorted(own["offset"] + own["size"], begin + BATCH_BYTES, side="right")))
            end = int(own["offset"][to - 1] + own["size"][to - 1])
            try:
                whole = memoryview(common.read_range(partition.file, begin, end - begin))
            except OSError:
                whole = memoryview(b"")
            rows = []
            for m in own[at:to]:
                data = bytes(whole[int(m["offset"]) - begin :][: int(m["size"])])
                error = None
                if len(data) != m["size"] or zlib.crc32(data) != m["crc32"]:
                    data, error = self.member(partition.file, m)
                rows.append((partition.file, int(m["offset"]), data, error))
            yield self._batch(rows)
            at = to

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("turnmill_archive").load(directory)``; options split_bytes, attempts, on_error."""

    @classmethod
    def name(cls) -> str:
        return "turnmill_archive"

    def schema(self) -> str:
        return "file string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members (file, offset, media, error) of all archives of a directory."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("turnmill_archive").options(**options).load(folder)


_FEATURES = "file string, offset long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of stored media: decode, then digests of payload and stored form."""
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for file, offset, media in zip(*(batch.column(x).to_pylist() for x in ("file", "offset", "media")), strict=True):
            samples, size = decode_png(media)
            payload = samples.tobytes()
            rows.append((file, offset, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names)


def media_features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, read the archives back, and give each document's digests and feature."""
    spark = docs.sparkSession
    folder = common.scratch(spark, "media")
    placed = common.stage(store_media(docs, folder, id_column, text), "media-places")
    found = common.map_arrow(read_archives(spark, folder).select("file", "offset", "media"), describe, _FEATURES)
    # Both sides grow with the documents; their compressed size must not make one look small enough to broadcast.
    return placed.hint("merge").join(found, ["file", "offset"]).drop("file", "offset").withColumnRenamed("id", id_column)
