"""Documents to packed training sequences: identify, de-duplicate, redact, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import langid, mixing, neardup, packing, secretscan
from corpusmill.llm.common import fresh, materialise, remove, scope, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay, repeated rows and null ids too; null texts and texts without letters go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more. Repeated rows are one group; wordless texts all stay."""
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a mark."""
    return secretscan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it, up to twice; rows are told apart by a key of their own, so ids may repeat or be null."""
    (row,) = fresh(docs.columns, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    return mixing.apply_mix(rows, mixing.plan(rows, key=row), row).select(*docs.columns)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences; a repeated document is packed as often."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix_sources), ("packing", best_fit_pack)]

#: Odd sketches, knapsack choice and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; what a stage leaves there goes when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", kept=True)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
