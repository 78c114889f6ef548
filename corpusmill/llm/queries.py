"""The operators' queries over the tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import ann, digest, langid, mixing, neardup, packing, quality, secretscan, tokenfile, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbours(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_best_fit_packing, op4_near_duplicates, op5_url_filter, op6_quality, op7_nearest_neighbours, op8_fingerprints, op9_token_files, op10_mixing)
}

#: Word 4-shingle sets, exact similarity and components by recursion; what the others compute is beyond SQL.
ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
grams AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words),
sized AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM grams),
flat AS (SELECT doc_id, unnest(g) AS s FROM grams),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS at FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT reach.node, edges.y FROM reach JOIN edges ON edges.x = reach.at)
SELECT d.doc_id, any_value(s.n)::BIGINT AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM documents d JOIN sized s ON s.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id""",
}
