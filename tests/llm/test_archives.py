import gzip
import hashlib
import zlib

import pytest

from turnmill.llm import common, media, warc

TEXTS = [None, "", "a", "x" * 63, "y" * 64, "z" * 65, "é" * 70, "long " * 20000, "a", "\0\n"]


def test_png_round_trip():
    for text in TEXTS:
        data = (text or "").encode()
        samples, n = media.decode_png(media.encode_png(data))
        got = samples.tobytes()
        assert n == len(data) and got[:n] == data and not any(got[n:]) and len(got) % 64 == 0 and 0 < len(got) < n + 64 + (n == 0)
    broken = bytearray(media.encode_png(b"abc"))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_media_features(spark):
    rows = [(k, t, "m") for k, t in enumerate(TEXTS)] + [(None, "null id", "m"), (2, "a", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string").repartition(3)
    out = media.media_features(df).collect()
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(r[0] or -1 for r in rows)
    by = {r["doc_id"]: r for r in out}
    for key, text, _ in rows:
        data = (text or "").encode()
        full = data + b"\0" * (-len(data) % 64 if data else 64)
        r, png = by[key], media.encode_png(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
    assert by[2]["feature"] == by[8]["feature"] != by[7]["feature"]
    assert media.media_features(df.limit(0)).collect() == []


def test_ranges_and_retries(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    archive = media._Archive(f"{folder}/a.tar")
    at = [archive.add(f"{k}", bytes([k]) * 700) for k in range(9)]
    archive.close()
    common.create(f"{folder}/unfinished.tar").close()
    got = media.read_archives(spark, folder, split_bytes=1500).collect()
    assert [(r["offset"], r["media"]) for r in sorted(got, key=lambda r: r["offset"])] == [(a, bytes([k]) * 700) for k, a in enumerate(at)]
    import tarfile

    assert [m.size for m in tarfile.open(tmp_path / "a.tar")] == [700] * 9
    reader, real, calls = media.ArchiveReader({"path": folder}), common.read_range, []

    def flaky(uri, offset, size):
        calls.append(offset)
        if not uri.endswith("index") and calls.count(offset) < 3:
            raise OSError("try again")
        return real(uri, offset, size)

    monkeypatch.setattr(common, "read_range", flaky)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 9
    (tmp_path / "a.tar").write_bytes(b"\xff" * 9000)
    lost = media.ArchiveReader({"path": folder, "attempts": "1", "on_error": "row"})
    assert all(r["media"] is None and r["error"] for p in lost.partitions() for b in lost.read(p) for r in b.to_pylist())
    strict = media.ArchiveReader({"path": folder, "attempts": "1"})
    with pytest.raises(OSError):
        [list(strict.read(p)) for p in strict.partitions()]


def brute_warc(rows):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(ids, default=None)
        revisit = len(body) >= 100 and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_warc(spark):
    big, exact = "é<p>" * 40, "x" * 100
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (None, "u", big), (3, None, big), (1, "u", None), (2, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", exact), (8, "u", exact), (10, "http://é/", "\r\n\r\nWARC/1.1\r\n" * 30000)]
    rows += [(k, f"u{k}", f"page {k} " * 50) for k in range(20, 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    index = warc.archive_pages(df)
    got = warc.read_warc(index, with_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_warc(rows)
    texts = {p: (h or "").encode() for p, _, h in rows}
    assert all(r["payload"] == texts[r["page_id"]] for r in got if r["record_type"] == "response")
    some = warc.read_warc(index.where("page_id in (5, 30)")).collect()
    assert {r["page_id"] for r in some} == {5, 30}
    name = index.first()["file"].removeprefix("file://")
    assert gzip.open(name).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_warc(warc.archive_pages(df.limit(0))).collect() == []


def test_range_merging():
    rows = [{"file": f, "offset": o, "length": n} for f, o, n in [("a", 0, 10), ("a", 10, 10), ("a", 25, 10), ("a", 200, 10), ("b", 0, 500), ("b", 500, 1)]]
    assert [len(x) for x in warc.ranges(iter(rows), most=100, gap=5)] == [3, 1, 1, 1]
