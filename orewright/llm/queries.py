"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .centroids import centroid_clusters, lloyd_sql
from .common import table
from .embeddings import near_duplicates
from .html import extract
from .lines import REPORT_SQL, line_report
from .packing import pack
from .ppm import ppm_scores
from .quality import quality_scores
from .resample import RESAMPLE_SQL, importance_ranks
from .secrets import secret_report, secrets_sql
from .simhash import simhash_groups
from .substring import substring_dedup
from .topk import top_k


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents")).select("doc.doc_id", "score", "keep")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def vocabulary_path() -> str:
    """The vocabulary file that the queries use: $BPE_VOCABULARY, or the one of the installed public tokenizers."""
    if path := os.environ.get("BPE_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select(*packed.columns[:-1], F.sha2("text", 256).alias("text_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


TOP_K_SQL = """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM s q JOIN s c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

SUBSTRING_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM d),
     w AS (SELECT *, CASE WHEN i + 13 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS run FROM x),
     late AS (SELECT *, coalesce(run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id, false) AS gone FROM w),
     g AS (SELECT doc_id, word, i, max(CAST(gone AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS covered FROM late)
SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (covered) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT covered), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""

NEAR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND (a.e = b.e OR list_cosine_similarity(a.e, b.e) >= 0.98)),
     reach AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.v, reach.low FROM reach JOIN l ON l.u = reach.node WHERE reach.low < l.v),
     n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT node AS vec_id, coalesce(any_value(n_links), 0) AS n_links, min(low) AS component_id, min(low) = node AS kept FROM reach LEFT JOIN n ON u = node GROUP BY node
"""

QUERIES = {
    "op7_ppm_scoring": op7_ppm_scoring,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op10_exact_top_k": op10_exact_top_k,
    "op5_html_extraction": op5_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op8_length_packing": op8_length_packing,
    "op9_line_dedup": op9_line_dedup,
    "op1_bpe": op1_bpe,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scan": op12_secret_scan,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op10_exact_top_k": TOP_K_SQL,
    "op9_line_dedup": REPORT_SQL,
    "op4_substring_dedup": SUBSTRING_SQL,
    "op6_embedding_near_dedup": NEAR_SQL,
    "op11_importance_resampling": RESAMPLE_SQL,
    "op12_secret_scan": secrets_sql(),
    "op13_centroid_clustering": lloyd_sql(),
}
