"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import bpe, hnsw, media, minhash, packing, pii, quality, suffix, warc, wrappers

#: The key of the pseudonyms; a deployment passes its own secret.
KEY = "chronoline-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op2_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.train(docs, _table(spark, sf_dir, "labels").where(quality.learnable(F.col("doc_id"))))
    return quality.score(docs, rules).select("doc_id", (~quality.learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_table(spark, sf_dir, "documents"))
    both = stored.select(F.struct("doc_id", "n_bytes").alias("row"), "media")
    return media.carve(both, "row").select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_feistel_pii, op2_hnsw_near_duplicates, op3_rule_quality, op4_tensored_minhash, op5_wrapper_text, op6_warc_index, op7_media_sniffing, op8_residual_packing, op9_byte_bpe, op10_suffix_dedup)}

ORACLE_SQL = {
    "op2_hnsw_near_duplicates": """
        WITH RECURSIVE v AS (
          SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN cnt ON cnt.a = vec_id""",
    "op4_tensored_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
    "op6_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
        t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to FROM t""",
}
