"""WARC archives: write records and their index, then read selected records by coalesced byte ranges.

A task writes one ``.warc.gz`` file with a gzip member for each record, and
returns the index of what it wrote: file, offset, length, URL and digest.  Of
pages with the same payload of at least ``MIN_REVISIT`` bytes, the one with the
smallest id is a response, the others are revisit records that refer to it.
Reading takes any selection of index rows, groups them by file and stretch of
``RANGE_BYTES``, sorts by offset, merges neighbours into ranges, and parses the
members of each range.

Defined results: null html is an empty payload, null URLs are written as
``about:blank``.  Among equal payloads with a null page id and others, the
smallest id that is not null is the response; if all are null, all are
responses.  Rows that repeat the response's id are responses too.  A task that
runs again writes another file, and only files that the index names are read.
A very long payload is a record, and a range, of its own.  An empty table makes
an empty index.  Columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Bytes that a read takes at most, unless one record is longer.
RANGE_BYTES = 8 << 20
#: Bytes between records that are read along rather than skipped.
GAP_BYTES = 64 << 10
#: Repeated digests that may be broadcast, after they have been counted; beyond it, a merge join in so many parts of each digest.
BROADCAST_DIGESTS = 100_000
DIGEST_PARTS = 32
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to (null for responses).

    Only digests are grouped; payloads stay where they were read if the repeated
    digests, once counted, are few enough to travel to them, and are else dealt
    by digest and a part of their own hash, so that a payload that many pages
    share goes to many tasks.
    """
    body = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", body.alias("html")).withColumn("digest", F.sha2(F.col("html"), 256))
    firsts = pages.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    firsts = common.stage(firsts, "warc-firsts")
    is_revisit = (F.octet_length("html") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    if firsts.count() <= BROADCAST_DIGESTS:
        met = pages.join(F.broadcast(firsts), "digest", "left")
    else:
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(DIGEST_PARTS)).cast("int")
        spread = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DIGEST_PARTS - 1))))
        met = pages.withColumn("part", part("page_id")).hint("merge").join(spread, ["digest", "part"], "left")
    return met.select("page_id", "url", "html", "digest", F.when(is_revisit, F.col("first_id")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page {page_id}'.encode()).hexdigest())}>"


def make_record(page_id, url: str | None, body: bytes, digest: str, refers_to) -> bytes:
    """The bytes of a response or revisit record."""
    target = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse_record(record: bytes) -> dict:
    """Type, payload (responses only), payload size and digest, and the page referred to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = _headers(head)
    block = rest[: int(named["content-length"])]
    if len(block) != int(named["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not have the length that it states")
    http, _, body = block.partition(b"\r\n\r\n")
    stated = named["warc-payload-digest"].removeprefix("sha256:")
    if named["warc-type"] == "response":
        digest = hashlib.sha256(body).hexdigest()
        if digest != stated:
            raise ValueError("a payload does not match its digest")
        return {"record_type": "response", "payload": body, "payload_bytes": len(body), "payload_digest": digest, "refers_to": None}
    return {"record_type": "revisit", "payload": None, "payload_bytes": int(_headers(http)["content-length"]), "payload_digest": stated, "refers_to": named["x-refers-to-page"]}


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write records for rows (page_id, url, html, digest, refers_to); returns their index."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        try:
            for batch in common.slices(batches, "html"):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = common.create(name)
                raw, limits = common.text_buffer(batch.column("html"))
                whole, offsets, sizes = raw.tobytes(), [], []
                rest = [batch.column(x).to_pylist() for x in ("page_id", "url", "digest", "refers_to")]
                for k, (page_id, url, digest, refers_to) in enumerate(zip(*rest, strict=True)):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(make_record(page_id, url, whole[limits[k] : limits[k + 1]], digest, refers_to)) + packer.flush()
                    out.write(member)
                    offsets.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(offsets), pa.array(sizes), batch.column("url"), batch.column("digest"), batch.column("page_id")], ["file", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    return common.map_arrow(pages, run, f"file string, offset long, length long, url string, digest string, page_id {kind}")


def ranges(rows: Iterator[dict], most: int = RANGE_BYTES, gap: int = GAP_BYTES) -> Iterator[list[dict]]:
    """Neighbours among rows sorted by file and offset, each list to be read at once."""
    held: list[dict] = []
    for r in rows:
        if held and (r["file"] != held[0]["file"] or r["offset"] + r["length"] - held[0]["offset"] > most or r["offset"] > held[-1]["offset"] + held[-1]["length"] + gap):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def read_warc(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that rows of an index name; with_payload adds ``payload`` (null for revisits)."""
    kind = index.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [None, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ranges(r for batch in batches for r in batch.to_pylist()):
            first = held[0]["offset"]
            data = memoryview(common.read_range(held[0]["file"], first, held[-1]["offset"] + held[-1]["length"] - first))
            rows = []
            for r in held:
                found = parse_record(zlib.decompress(data[r["offset"] - first :][: r["length"]], 31))
                if found["payload_digest"] != r["digest"]:
                    raise ValueError(f"{r['file']} at {r['offset']} is not the record of the index")
                rows.append(r | found)
            columns = [pa.array([x[n] for x in rows], own_kind if n == "page_id" else t) for n, t in zip(names, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type

    own_kind = to_arrow_type(index.schema["page_id"].dataType)
    stretch = F.expr(f"offset div {RANGE_BYTES}")
    index = index.select("file", "offset", "length", "url", "digest", "page_id").repartition("file", stretch).sortWithinPartitions("file", "offset")
    schema = f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    return common.map_arrow(index, run, schema).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder; returns the stored index."""
    folder = common.scratch(pages.sparkSession, "warc")
    return common.stage(write_warc(record_types(pages), folder), "warc-index")
