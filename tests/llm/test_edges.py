"""Each operator on nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from turnmill.llm import decontamination, language, line_dedup, media, near_dedup, packing, quality, secret_scan, token_counts, tokens, warc

LONG = " ".join(f"w{k * 7919 % 100003}" for k in range(100_000))  # about 0.7 MB on one line, no word twice
TEXTS = ["the cat sat on the mat and looked at the dog for a long while\nsecond line of the text here", "", None, " \n\t\n ", "ein kurzer Text", LONG, LONG + " and one more", "x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(k, t, "en", "s", 0 if t is None else len(t)) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s", len(TEXTS[0])), (None, "a row without an id but with words", None, None, None), (None, None, None, None, None)]
#: Names that operators use for columns of their own.
CLASHING = ["id", "text_key", "line_no", "line", "h1", "h2", "key", "node", "a", "b", "n", "first", "size", "component_id", "kept", "score", "predicted", "label", "quality", "held_out", "candidate", "start", "length", "offset", "sequence_id", "bucket", "payload", "file", "digest", "item", "spans", "n_hit", "class_id", "url", "tokens", "document", "_own0", "_OWN1", "_id", "_spans", "_quality", "_gone"]


@pytest.fixture(scope="module")
def learned(spark):
    """Models of a few rows; what they say is tested elsewhere."""
    rows = [(k, f"number {k} the words of this text are english", "en") if k % 2 else (k, f"zahl {k} die worte von diesem text sind deutsch", "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    return language.train(docs), quality.train(docs, labels)


def operators(learned):
    """Name: (function of docs and benchmark, columns of a digest that does not depend on how rows are dealt)."""
    language_model, quality_model = learned
    return {
        "lines": (lambda d, b: line_dedup.line_classes(d), None),
        "near": (lambda d, b: near_dedup.near_duplicates(d, words=4, percent=80), None),
        "language": (lambda d, b: language.predict(d, language_model), ["doc_id", "lang_pred", "score"]),
        "secrets": (lambda d, b: secret_scan.scan_secrets(d), None),
        "packing": (lambda d, b: packing.pack(d), ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]),
        "quality": (lambda d, b: quality.score(d, quality_model).select("doc_id", "score"), None),
        "decontamination": (lambda d, b: decontamination.contamination_report(d, b), None),
        "media": (lambda d, b: media.media_features(d), None),
        "tokens": (lambda d, b: token_counts.count_tokens(d), ["doc_id", "n_tokens"]),
    }


NAMES = ["lines", "near", "language", "secrets", "packing", "quality", "decontamination", "media", "tokens"]


def rows_of(df, columns):
    columns = sorted(columns or df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def widened(df, but=()):
    return df.withColumns({c: F.lit("theirs") for c in CLASHING if c not in df.columns and c not in but})


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_empty_tables(spark, learned, name):
    run, columns = operators(learned)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    bench = spark.createDataFrame([("i", "the cat sat on the mat and looked at the dog"), (None, "ein kurzer Text"), ("n", None), ("e", "")], "item_id string, text string")
    plain = rows_of(run(docs, bench), columns)
    assert rows_of(run(widened(docs, but=("score", "predicted") if name == "quality" else ()), bench), columns) == plain
    assert plain or name == "secrets"
    assert run(docs.limit(0), bench).count() == 0


def test_clashing_columns_pass_through_stages(spark):
    docs = widened(spark.createDataFrame(ROWS[:5] + ROWS[8:], SCHEMA))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert all(r["_gone"] == r["_spans"] == r["line"] == "theirs" for r in out.collect())


def test_long_texts_are_whole(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + " and one more"), (3, LONG[::-1])], "doc_id long, text string")
    words = lambda t: t.lower().split()
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((1, words(LONG)), (2, words(LONG + " and one more")), (3, words(LONG[::-1])))}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, words=4, percent=80).collect()}
    assert near == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (len(sets[3]), 3)}
    lines = {r["doc_id"]: r["class_id"] for r in line_dedup.line_classes(docs).collect()}
    assert lines == {1: 1, 2: 2, 3: 3}  # more than two edits apart
    end = " ".join(LONG.split()[-10:])
    bench = spark.createDataFrame([("end", end)], "item_id string, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination_report(docs, bench).collect()}
    assert hits == {1: 10, 2: 10, 3: 0}
    key = "AKIA" + "Q7" * 8
    scanned = spark.createDataFrame([(1, LONG + f"\naws key {key}\n")], "doc_id long, text string")
    assert any(key in r["candidate"] and r["start"] > len(LONG) for r in secret_scan.scan_secrets(scanned).collect())
    stored = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    for i, t in ((1, LONG), (3, LONG[::-1])):
        body = t.encode() + bytes(-len(t.encode()) % 64)
        assert (stored[i]["n_bytes"], stored[i]["payload_bytes"], stored[i]["payload_sha256"], stored[i]["tail_crc32"]) == (len(t.encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))


def test_counts_of_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "two words"), (1, "two words"), (2, None), (3, LONG)], "doc_id long, text string")
    count = lambda t: len(Tokenizer.from_file(tokens.default_path()).encode(t, add_special_tokens=False).ids)
    got = token_counts.count_tokens(docs)
    assert rows_of(got, ["doc_id", "n_tokens"]) == sorted([(1, count("two words"))] * 2 + [(2, 0), (3, count(LONG))], key=repr)


def test_large_payloads_and_clashing_pages(spark):
    html = "<p>" + "x y z " * (warc.RANGE_BYTES // 5) + "</p>"  # longer than a range
    rows = [(3, "http://a/3", html), (1, "http://a/1", html), (2, None, None), (None, None, "short"), (4, "http://a/4", "short"), (5, "http://a/5", html[:-1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if p == 3 else "response", 1 if p == 3 else None) for p, _, h in rows), key=repr)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for table in (pages, widened(pages)):
        found = warc.read_warc(warc.archive_pages(table)).select(columns).collect()
        assert sorted((tuple(r) for r in found), key=repr) == want
    assert warc.read_warc(warc.archive_pages(pages.limit(0))).count() == 0
    assert re.fullmatch("[0-9a-f]{64}", want[0][2]) and isinstance(pages.schema, T.StructType)
