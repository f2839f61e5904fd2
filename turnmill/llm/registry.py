"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_classes

    return line_classes(_table(spark, sf_dir, "documents")).drop("text_key")


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_warc

    found = read_warc(archive_pages(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secret_scan import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.withColumn("candidate_sha256", F.sha2("candidate", 256)).drop("candidate")


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_archives": op2_warc_archives,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_sequence_packing": op6_sequence_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_media_columns": op9_media_columns,
    "op10_token_counts": op10_token_counts,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
    "pipeline": pipeline,
}

_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM k WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM k LEFT JOIN f USING (payload_digest)
"""

def _similarity_sql(words: int, percent: int, more: str = "") -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {words}], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {words - 1}, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id{more}
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


_OP12_SQL = r"""
WITH d AS (
  SELECT rid, doc_id, w FROM (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0
), size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_all) AS m FROM d, size),
scores AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), words AS (SELECT r, x, row_number() OVER (ORDER BY r, x) AS id, length(x) AS size FROM (SELECT DISTINCT r, x FROM t)),
own AS (SELECT c, list(id ORDER BY p) AS s FROM t JOIN words USING (r, x) GROUP BY c),
bytes AS (SELECT c, s, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT)) AS b FROM own),
hashed AS (
  SELECT c, s, xor(list_reduce(list_concat([4294967295], b), lambda crc, z: list_reduce(list_concat([xor(crc, z)], range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM bytes
), re AS (
  SELECT a.c, list_concat(list_slice(coalesce(b.s, []), 1, a.h), list_slice(a.s, a.h + 1, len(a.s))) AS s
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 100
), nodes AS (
  SELECT list_slice(s, 1, d) AS path, d, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d) AS ends
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM re) GROUP BY ALL
), kids AS (SELECT list_slice(path, 1, d - 1) AS path, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
each AS (
  SELECT n.path, n.d, n.conv_id, n.n, n.ends, coalesce(k, 0) AS k, coalesce((n.n - 1) * w.size, 0) AS saved
  FROM nodes n LEFT JOIN kids ON kids.path = n.path AND kids.d = n.d LEFT JOIN words w ON w.id = n.path[n.d] AND n.d > 0
), sums AS (
  SELECT a.path, a.d, count(*) FILTER (b.k = 0) AS n_leaves, sum(b.saved) AS saved
  FROM each a JOIN each b ON b.d >= a.d AND list_slice(b.path, 1, a.d) = a.path GROUP BY ALL
)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(e.n AS BIGINT) AS n_convs, CAST(e.k AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM each e JOIN sums s ON s.path = e.path AND s.d = e.d LEFT JOIN nodes p ON e.d > 0 AND p.path = list_slice(e.path, 1, e.d - 1) AND p.d = e.d - 1
"""

ORACLES: dict[str, str] = {
    "op2_warc_archives": _OP2_SQL,
    "op3_minhash_near_dedup": _similarity_sql(4, 80, ", d.doc_id = component_id AS kept"),
    "op8_benchmark_decontamination": _OP8_SQL,
    "op11_ngram_jaccard_join": _similarity_sql(3, 90),
    "op12_ranked_lexical_search": _OP12_SQL,
    "op13_conversation_prefix_trie": _OP13_SQL,
}
