"""The engine's functions by name, for Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import cleaning
from corpusmill.operators.extraction import METRICS

INTEGERS = {x.split(" ")[0] for x in METRICS.split(", ") if x.endswith(" int")}


def code_metrics(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    """The 22 measures of a piece of code; nulls for null code or an unknown language."""
    from corpusmill.functions.code_metrics import compute_metrics

    names = [x.split(" ")[0] for x in METRICS.split(", ")]
    rows = [compute_metrics(c, x) if c is not None else {} for c, x in zip(code, language)]
    return pd.DataFrame({n: pd.array([r.get(n) for r in rows], dtype="Int32" if n in INTEGERS else "Float64") for n in names})


def clean_snippet(raw: pd.Series, language: pd.Series, granularity: pd.Series) -> pd.Series:
    return pd.Series([cleaning.clean_snippet(r, x, g) for r, x, g in zip(raw, language, granularity)], dtype="object")


class Definitions:
    """Table function: kind, name, first and last line of each definition of a text."""

    def eval(self, text: str, language: str):
        from corpusmill.functions.definitions import find_definitions

        if text is None:
            return
        src, found = find_definitions(text, language)
        for d in found:
            yield d.kind, d.name, d.parent, src.line(src.tokens[d.first].start), src.line(src.tokens[d.last].end - 1)


def register(spark: SparkSession) -> None:
    """code_metrics(code, language), clean_snippet(raw, language, granularity), code_definitions(text, language)."""
    spark.udf.register("code_metrics", F.pandas_udf(code_metrics, f"struct<{', '.join(x.replace(' ', ': ') for x in METRICS.split(', '))}>"))
    spark.udf.register("clean_snippet", F.pandas_udf(clean_snippet, "string"))
    spark.udtf.register("code_definitions", F.udtf(Definitions, returnType="kind string, name string, parent string, start_line int, end_line int"))
