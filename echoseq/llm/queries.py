"""Driver queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, licenses, minhash, mixing, packing, records, substring, topk, toxicity, warc
from .common import read


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so a document's UTF-8 bytes are its recording: unsigned 8-bit PCM."""
    docs = read(spark, sf_dir, "documents")
    return chroma.recordings(spark, docs.select("doc_id", F.col("text").cast("binary").alias("audio")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no paths, so each document gets one in a tree of source, language and number; some are licence files."""
    docs = read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    top, sub = F.concat_ws("/", "source", "lang"), F.concat(F.lit("/d"), F.floor(d / 100).cast("string"))
    path = F.when(d % 50 == 0, F.concat(top, F.lit("/LICENSE."), d.cast("string"))).when(d % 10 == 0, F.concat(top, sub, F.lit("/COPYING."), d.cast("string"))).otherwise(F.concat(top, sub, F.lit("/f"), d.cast("string"), F.lit(".txt")))
    return licenses.scan(spark, docs.select("doc_id", path.alias("path"), "text"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(spark, read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, read(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, read(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(spark, read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, read(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_chroma, op2_minhash, op3_licenses, op4_substring, op5_topk, op6_toxicity, op7_packing, op8_records, op9_warc, op10_mixing)}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op2_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op4_substring": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS pos FROM x JOIN rep USING (win)),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w WHERE len(ws) > 0),
k AS (SELECT t.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY t.pos) FILTER (WHERE c.pos IS NULL), '') AS kept
      FROM t LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.pos = t.pos GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100""",
}
