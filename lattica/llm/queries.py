"""The ten operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import compression, decontaminate, embedding_dedup, html_text, language, mixing, pii, simhash, substring_dedup
from lattica.llm.common import load


def fold(n: int, doc_id: Column | None = None) -> Column:
    """crc32 of doc_id as text, mod n; a null id is in fold -1."""
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % n, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs, fold(5) > 0)
    return language.predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = compression.fit(docs, load(spark, sf_dir, "labels"), "toxic", fold(3) != 1, compression.Toxicity)
    return compression.score(docs, model, 0.7).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(load(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).drop("rk")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(load(spark, sf_dir, "documents")).drop("rk", "root", "head")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(load(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = compression.fit(docs, load(spark, sf_dir, "labels"), "quality", fold(5) > 0, compression.Quality)
    return compression.score(docs, model, 0.3).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("rk")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_language_id, op2_toxicity, op3_substring_dedup, op4_embedding_dedup, op5_pii_surrogates, op6_source_mixing, op7_simhash_dedup, op8_html_extraction, op9_quality, op10_decontamination)
    return {f.__name__: f for f in made}


OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > first),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) k WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = k.doc_id AND h.p = k.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
#: An exact pairwise join and the closure of its links by recursion.
OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (sqrt(a.n) * sqrt(b.n)) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.a = l.a),
c AS (SELECT a, min(root) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN k ON v.vec_id = k.a
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3,
        "op4_embedding_dedup": OP4,
        "op6_source_mixing": mixing.ORACLE,
        "op10_decontamination": decontaminate.ORACLE,
    }
