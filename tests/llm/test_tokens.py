import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from turnmill.llm import common, packing, token_counts, tokens

ODD = [None, "", "   ", "áb é. ́x", "It's 'sure' we're.'s x'll", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|>", "É.É, ß×ß÷é a×.b", "日本語 text、です。", "x" * 5000, "ab12.5%%%–x…", "a b c\x1cd\x85e", "ΑΣ.Α ΑΣ", "İI ſ K", "🙂🙂 a.🙂 .🙂!b", "‍b.̀c", "#hash# id"]


def texts():
    rnd = random.Random(2)
    parts = ["a", "Tion", "é", "É", ".", ",", "'", "'s", "12", "%%%", " ", "\n", "\t", "ü", "×", "…", "–", "<|", "|>", "日", "́", "_", "a.b", " "]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(800)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_tokenizers(plain):
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = plain
    column = pa.array(texts())
    ids, limits = tokens.Encoder(None, plain).encode(column.slice(1))
    for k, text in enumerate(texts()[1:]):
        assert ids[limits[k] : limits[k + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    e = tokens.Encoder(None, False)
    t = Tokenizer.from_file(tokens.default_path())
    for text in ("one two three", "four five six seven", "one eight. nine"):
        assert e.encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(tokens.default_path())
    rows = [(k, x, 7) for k, x in enumerate(texts()[:120])] + [(None, "null id here", 7), (3, "twice", 7), (3, "twice", 7), (500, "tion " * 9000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long").repartition(3)
    out = packing.pack(df, with_ids=True).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    by = {}
    for r in out:
        assert r["length"] <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    for key, text, _ in rows:
        if key == 3:
            continue
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[key], key=lambda r: r["start"])
        assert sum((r["ids"] for r in pieces), []) == want
        assert all(r["doc_tokens"] == len(want) for r in pieces) and pieces[0]["start"] == 0
    assert packing.pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, max_length=100)


def test_token_counts(spark):
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    rows = [(k, x) for k, x in enumerate(texts()[:200])] + [(None, "null id"), (700, "tion " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in rows}
    assert token_counts.count_tokens(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 3, 64, 10_000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rnd = random.Random(block)
    want, files = [], []
    for f, tail in enumerate([0, 5, 0, 0]):
        lengths = [] if f == 2 else [rnd.choice([0, 0, 1, 2, 7, 40]) for _ in range(30)]
        ids = sum(([1] * n + [9] for n in lengths), []) + [1] * tail
        path = f"file://{tmp_path}/{f}.ids"
        (tmp_path / f"{f}.ids").write_bytes(np.array(ids, "<u4").tobytes())
        files.append((path, 4 * len(ids)))
        at = 0
        for k, n in enumerate(lengths + [tail] * bool(tail)):
            want.append((path, k, at, n, not (tail and k == len(lengths))))
            at += n + 1
    df = spark.createDataFrame(files, "file string, n_bytes long")
    if block == 1:
        df = df.where(df.file.endswith("1.ids"))
        want = [w for w in want if w[0].endswith("1.ids")]
    got = token_counts.scan_token_files(df, separator=9, width=4, block_ids=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_common_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "b" * 10, "c", "d"])], ["t"])
    assert [b.num_rows for b in common.slices([batch], "t", 4)] == [2, 1, 2]
