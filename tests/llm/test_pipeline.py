import re

import corpus_pipeline
from tokenizers import Tokenizer

from turnmill.llm import decontamination, line_dedup, packing, quality, tokens

from .test_decontamination import WORD, words
from .test_line_dedup import distance
from .test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


def by_lines(docs):
    """Brute force of the line stage, with a cheap bound before each edit distance."""
    lines = sorted({x for t in docs.values() for x in t.split("\n") if x.strip()})
    label = {x: x for x in lines}
    for p, x in enumerate(lines):
        for y in lines[:p]:
            if min(len(x), len(y)) >= line_dedup.MIN_CHARS and abs(len(x) - len(y)) <= 2 and sum(a != b for a, b in zip(sorted(x), sorted(y))) < len(x) and sum(abs(x.count(c) - y.count(c)) for c in set(x) | set(y)) <= 4 and distance(x, y) <= 2:
                old, new = label[x], label[y]
                label = {k: new if v == old else v for k, v in label.items()}
    where = {}
    for i in sorted(docs):
        for k, x in enumerate(docs[i].split("\n")):
            if x.strip():
                where.setdefault(label[x], []).append((i, k))
    out = {}
    for i, t in docs.items():
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip() or len(where[label[x]]) < line_dedup.MIN_COPIES or where[label[x]][0] == (i, k)]
        if any(x.strip() for x in kept) or not t.strip():
            out[i] = "\n".join(kept)
    return out


def without_windows(text, bench):
    spans = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    w, hit = words(text), set()
    for b in bench:
        x = words(b)
        n = min(decontamination.WINDOW, len(x))
        for win in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == win:
                    hit |= set(range(i, i + n))
    out, at, k = [], 0, 0
    while k < len(w):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(text[at : spans[k][0]])
            at, k = spans[end][1], end
        k += 1
    return "".join(out) + text[at:]


def test_whole_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    good = {r["doc_id"]: r["text"] for r in quality.keep_good(docs, labels).collect()}
    assert 0.5 * docs.count() < len(good) < docs.count()
    lined = by_lines(good)
    kept = {r[0] for r in brute_near(sorted(lined.items()), 5, 80) if r[3]}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    final = {i: without_windows(lined[i], bench) for i in kept}
    t = Tokenizer.from_file(tokens.default_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in final.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == want and all(r["length"] <= packing.MAX_LENGTH for r in got)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "some clean words of text here", "en", "s", 29), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and (k == 0 or out.count() == 2)
        assert stage(spark, docs.limit(0), SF).count() == 0
