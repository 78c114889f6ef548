"""From files to function and class rows.

The walk of one file is Python, in Arrow batches over the scan; everything after
it is DataFrame work: counts, caps in file order, refill, stamps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources import files

METRICS = "loc int, sloc int, lloc int, comments int, multi int, blank int, comment_ratio double, cyclomatic_complexity int, max_nesting_depth int, h1 int, h2 int, N1 int, N2 int, vocabulary int, halstead_length int, calculated_length double, volume double, difficulty double, effort double, time double, bugs double, maintainability_index double"
SHARED = "docstring string, source_code string, used_imports array<string>, start_line int, end_line int, decorators array<string>"
FUNCTION = "parameters array<string>, return_annotation string, signature string, is_method boolean, parent_class string"
CLASS = "parent_classes array<string>, skeleton string, method_names array<string>, method_count int, has_constructor boolean"
TREE = "ast_depth int, ast_num_nodes int, ast_node_types map<string,int>, ast string"
RECORD = f"repo string, file_path string, language string, kind string, position int, name string, {SHARED}, {FUNCTION}, {CLASS}, {TREE}, {METRICS}, error string"
#: Rows, and signs of the files they come from, that a walk holds before it hands them on.
ROWS, SIGNS = 500, 1_000_000


def _names(ddl: str) -> list[str]:
    return [part.split(" ")[0] for part in ddl.split(", ")]


def walked(batches: Iterator[pd.DataFrame], language: str, include_ast: bool, kinds: set[str]) -> Iterator[pd.DataFrame]:
    """Rows of RECORD, in pieces whose size follows neither the batch's nor a file's: they are many times the files.

    text may be UTF-8 bytes: a string can take four times their room, and so only one file is decoded at a time.
    """
    from corpusmill.functions.records import extract

    names = _names(RECORD)
    table = lambda rows: pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
    for batch in batches:
        rows, signs = [], 0
        for repo, path, text in zip(batch["repo"], batch["path"], batch["text"]):
            text = text if isinstance(text, str) else str(text, "utf-8")
            signs += len(text)
            base = {"repo": repo, "file_path": path, "language": language}
            try:
                rows += [base | {"position": i} | r for i, r in enumerate(extract(text, language, include_ast)) if r["kind"] in kinds]
            except Exception as e:  # one bad file costs only its own rows
                rows.append(base | {"error": f"{type(e).__name__}: {e}"[:500]})
            full = signs >= SIGNS
            while rows and (full or len(rows) >= ROWS):
                yield table(rows[:ROWS])
                del rows[:ROWS]
            signs = signs if rows else 0
        if rows:
            yield table(rows)


def definitions(tree: DataFrame, language: str, include_ast: bool = False, granularities: Sequence[str] = ("function", "class")) -> DataFrame:
    """A row for each function and class of the eligible files; position is its place in the file.

    A file that cannot be walked gives one row with kind null and its error.
    """
    if language not in files.EXTENSIONS:
        raise ValueError(f"Unsupported language: {language}")
    kinds = set(granularities)
    source = tree.filter(files.eligible(F.col("path"), language)).select("repo", "path", files.decoded(F.col("content")).cast("binary").alias("text")).filter("text IS NOT NULL")
    return source.mapInPandas(lambda batches: walked(batches, language, include_ast, kinds), RECORD)


def functions(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'function'").drop("kind", "error", *_names(CLASS)).withColumnRenamed("name", "func_name")


def classes(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'class'").drop("kind", "error", *_names(FUNCTION)).withColumnRenamed("name", "class_name")


def content_counts(tree: DataFrame, language: str, granularities: Sequence[str] = ("function", "class")) -> DataFrame:
    """repo, functions, classes: what the first pass counts; a granularity not asked for is 0."""

    @F.pandas_udf("struct<f: int, c: int>")
    def both(texts: pd.Series) -> pd.DataFrame:
        from corpusmill.functions.records import definition_counts

        out = []
        for t in texts:
            try:
                out.append(definition_counts(t, language))
            except Exception:  # a file that cannot be walked counts nothing
                out.append((0, 0))
        return pd.DataFrame(out, columns=["f", "c"])

    text = tree.filter(files.eligible(F.col("path"), language)).select("repo", files.decoded(F.col("content")).alias("text")).filter("text IS NOT NULL")
    counted = text.select("repo", both("text").alias("n")).groupBy("repo").agg(F.sum("n.f").alias("functions"), F.sum("n.c").alias("classes"))
    zero = lambda c, g: F.coalesce(c, F.lit(0)).cast("long") if g in granularities else F.lit(0).cast("long")
    return tree.select("repo").distinct().join(counted, "repo", "left").select("repo", zero(F.col("functions"), "function").alias("functions"), zero(F.col("classes"), "class").alias("classes"))


def capped(rows: DataFrame, caps: DataFrame, cap: str = "cap_rows") -> DataFrame:
    """Each repository's first rows in file order, up to its cap (no cap: all), with ``pos`` from 1."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(files.order_key(F.col("file_path")), "position"))
    return rows.withColumn("pos", place).join(caps.select("repo", cap), "repo", "left").filter(F.col(cap).isNull() | (F.col("pos") <= F.col(cap)))


def repo_loc(tree: DataFrame, language: str) -> DataFrame:
    """repo, loc, comment_lines over the files of the language: code lines, and lines that only comments cover."""

    @F.pandas_udf("struct<loc: int, comment: int>")
    def both(texts: pd.Series) -> pd.DataFrame:
        from corpusmill.functions.lexer import lex

        out = []
        for t in texts:
            src = lex(t, language)
            code = {n for x in src.tokens for n in range(src.line(x.start), src.line(max(x.start, x.end - 1)) + 1)}
            noted = {n for a, b, _ in src.comments for n in range(src.line(a), src.line(max(a, b - 1)) + 1)}
            out.append((len(code), len(noted - code)))
        return pd.DataFrame(out, columns=["loc", "comment"])

    text = tree.filter(files.eligible(F.col("path"), language)).select("repo", files.decoded(F.col("content")).alias("text")).filter("text IS NOT NULL")
    return text.select("repo", both("text").alias("n")).groupBy("repo").agg(F.sum("n.loc").cast("int").alias("loc"), F.sum("n.comment").cast("int").alias("comment_lines"))


def node_histogram(rows: DataFrame) -> DataFrame:
    """Syntax nodes by type over all rows."""
    return rows.select(F.explode("ast_node_types").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))
