"""Source trees: one row a file, which files count, and their order.

A tree relation has repo, path (relative, ``/`` between parts) and content
(bytes). All rules are column expressions, so Spark's reader skips the content
of files that the path alone rules out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions, directories and file names that decide what counts.
EXTENSIONS = {
    "Python": [".py"],
    "Java": [".java"],
    "JavaScript": [".js", ".jsx"],
    "C++": [".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"],
}
SKIP_DIRS = ["vendor", "vendored", "third_party", "third-party", "site-packages", "node_modules", "dist", "build", "venv", ".venv", ".tox", ".eggs"]
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs"]
TEST_PREFIXES = ["test_", "Test"]
TEST_SUFFIXES = ["_test.py", "Test.java", ".test.js", ".spec.js", ".test.ts", ".spec.ts", "_test.cpp", "_test.cc"]


def read_tree(spark: SparkSession, root: str, repo_parts: int = 2) -> DataFrame:
    """repo, path, content of all files below root; a repo's name is its first repo_parts directories."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    parts = F.split(F.substr(clean, F.lit(len(_plain(root)) + 2)), "/")
    return rows.select(F.array_join(F.slice(parts, 1, repo_parts), "/").alias("repo"), F.array_join(F.slice(parts, F.lit(repo_parts + 1), F.size(parts)), "/").alias("path"), "content")


def _plain(root: str) -> str:
    import re

    return re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    return F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1)


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, unless only dots stand before it."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def is_test_file(path: Column) -> Column:
    name = file_name(path)
    found = F.lit(False)
    for x in TEST_PREFIXES:
        found = found | F.startswith(name, F.lit(x))
    for x in TEST_SUFFIXES:
        found = found | F.endswith(name, F.lit(x))
    return found


def vendored_script(path: Column) -> Column:
    low = F.lower(path)
    return F.endswith(low, F.lit(".min.js")) | F.contains(low, F.lit("node_modules"))


def _first_pruned(path: Column) -> Column:
    """The outermost directory that a walk does not enter; null if none."""
    return F.get(F.filter(directories(path), lambda d: d.isin(*SKIP_DIRS, *TEST_DIRS)), F.lit(0))


def has_extension(path: Column, language: str) -> Column:
    return extension(path).isin(*EXTENSIONS[language])


def eligible(path: Column, language: str) -> Column:
    """Whether a file is read, by its path alone."""
    keep = has_extension(path, language) & _first_pruned(path).isNull() & ~is_test_file(path)
    return keep & ~vendored_script(path) if language == "JavaScript" else keep


def skipped(path: Column, language: str) -> Column:
    """Whether a file of the language lies below a skipped directory (not below a test directory outside of it)."""
    return has_extension(path, language) & F.coalesce(_first_pruned(path).isin(*SKIP_DIRS), F.lit(False))


def skipped_counts(tree: DataFrame, language: str) -> DataFrame:
    return tree.groupBy("repo").agg(F.count_if(skipped(F.col("path"), language)).alias("skipped_files"))


def order_key(path: Column) -> Column:
    """Sorts a directory's files before its subdirectories, names by code point."""
    p = parts(path)
    return F.transform(p, lambda x, i: F.struct((i < F.size(p) - 1).alias("below"), x.alias("name")))


def decoded(content: Column) -> Column:
    """UTF-8 text; malformed bytes become the replacement sign."""
    return F.make_valid_utf8(content.cast("string"))
