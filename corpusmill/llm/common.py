"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.scratch import remove, shared_dir

_scopes: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at its end; what is built on them must be written by then."""
    path = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    _scopes.append(path)
    try:
        yield
    finally:
        _scopes.remove(path)
        remove(spark, path)


def written(df: DataFrame, name: str, kept: bool = False) -> tuple[DataFrame, str]:
    """df, written as Parquet to the shared folder and read back, and its path; kept: outside of any scope."""
    spark = df.sparkSession
    path = f"{_scopes[-1] if _scopes and not kept else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    return written(df, name)[0]


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
