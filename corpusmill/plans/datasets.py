"""Training data from human and generated code: balance, convert, generate, clean, assemble, split.

Jobs that write skip an output that exists, so that a driver loop that stopped
goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import sinks
from corpusmill.operators import allocation, cleaning

#: Names and signature length that mark a row as garbage; shortest code that passes the check.
GARBAGE_NAMES, SHORTEST_SIGNATURE, SHORTEST_CODE = ("unknown", "main"), 10, 10
FUNCTION_COLUMNS = {"repo": "repository_name", "file_path": "func_path_in_repository", "func_name": "func_name", "source_code": "complete_extracted_code", "signature": "func_signature"}
CLASS_COLUMNS = {"repo": "repository_name", "file_path": "file_path", "class_name": "class_name", "source_code": "human_written_code", "skeleton": "class_skeleton"}


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def without_garbage(rows: DataFrame, name: str, signature: str, bad_repos: Sequence[str] = ()) -> DataFrame:
    """Rows of other repositories, with a real name and a signature that is not too short."""
    return rows.filter(~F.col("repo").isin(*bad_repos) & ~plain(F.col(name)).isin(*GARBAGE_NAMES) & (F.length(signature) >= SHORTEST_SIGNATURE))


def converted(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(a).alias(b) for a, b in columns.items()])


def balanced(rows: DataFrame, per_repo: int, total: int, key: str, seed: str = "42") -> DataFrame:
    return allocation.two_level_cap(rows, "repo", per_repo, total, key, seed)


def qa_counts(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many rows' code is missing, blank or short."""
    c = F.col(column)
    bare = plain(c)
    return rows.agg(F.count_if(c.isNull()).alias("missing"), F.count_if(bare == "").alias("blank"), F.count_if((bare != "") & (F.length(bare) < SHORTEST_CODE)).alias("short"))


def qa(rows: DataFrame, column: str) -> dict[str, int]:
    """Rows whose code is missing, blank or short; all must be 0 to pass."""
    return qa_counts(rows, column).first().asDict()


def balance_and_convert(functions: DataFrame, classes: DataFrame, per_repo: int, total: int, key: str, bad_repos: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One language's function and class tables: filtered, balanced, renamed."""
    fs = balanced(without_garbage(functions, "func_name", "signature", bad_repos), per_repo, total, key)
    cs = balanced(without_garbage(classes, "class_name", "skeleton", bad_repos), per_repo, total, key)
    return {"function": converted(fs, FUNCTION_COLUMNS), "class": converted(cs, CLASS_COLUMNS)}


def training_rows(rows: DataFrame, code: str, label: int, language: str | Column, granularity: str, model: str | Column, repository: str | None = None) -> DataFrame:
    """The unified schema; rows without code are left out."""
    live = rows.filter(F.col(code).isNotNull() & (plain(F.col(code)) != ""))
    return live.select(F.col(code).alias("code"), F.lit(label).alias("label"), (F.lit(language) if isinstance(language, str) else language).alias("language"), F.lit(granularity).alias("granularity"), F.lit(model).alias("model") if isinstance(model, str) else model.alias("model"), (F.col(repository) if repository else F.lit(None).cast("string")).alias("repository"))


def assembled(parts: Iterable[DataFrame], seed: str = "42") -> DataFrame:
    """All parts as one table with a split, 80/10/10 within language, granularity and label."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    keyed = out.withColumn("_key", F.md5(F.concat_ws("|", "code", "model", "repository").cast("binary")))
    return allocation.stratified_split(keyed, ["language", "granularity", "label"], "_key", seed).drop("_key")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_jobs(spark: SparkSession, jobs: Iterable[tuple[str, Callable[[], DataFrame]]], say: Callable[[str], None] = lambda _: None) -> dict[str, list[str]]:
    """Write each job's rows as CSV to its path; outputs that exist are skipped, failures are counted and do not stop the rest."""
    out: dict[str, list[str]] = {"written": [], "skipped": [], "failed": []}
    for path, make in jobs:
        if exists(spark, f"{path}/_SUCCESS"):
            out["skipped"].append(path)
            continue
        try:
            sinks.write_csv(make(), path)
            out["written"].append(path)
        except Exception as e:  # one job's failure must not cost the others
            say(f"{path}: {e}")
            out["failed"].append(path)
    return out


def cleaned_table(rows: DataFrame, raw: str, language: str, granularity: str) -> DataFrame:
    """rows with generated_code_cleaned; Python loses what stands before the first definition."""
    return rows.withColumn("generated_code_cleaned", cleaning.cleaned(F.col(raw), language, granularity))
