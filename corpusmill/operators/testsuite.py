"""Whether a repository has a test suite, from its tree alone: four signals and a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.files import decoded, directories, extension, file_name

# Names and patterns of the four signals.
TEST_DIRS = ["test", "tests", "test_suite", "testing", "__tests__", "__test__", "spec", "specs", "unit_tests", "integration_tests", "functional_tests", "e2e"]
TEST_ONLY_DIRS = ["__tests__", "__test__"]
NOT_WALKED = [".git", "venv", ".venv", "env", "node_modules", "__pycache__", "site-packages", "vendor", "vendored", "third_party", "third-party", "external", "build", "dist", ".tox", ".eggs", ".mypy_cache", ".pytest_cache"]
TEST_FILES = {
    "Python": [r"^test_.*\.py$", r"_test\.py$"],
    "Java": [r"Test\.java$", r"Tests\.java$", r"TestCase\.java$", r"IT\.java$"],
    "JavaScript": [r"\.test\.js$", r"\.spec\.js$", r"\.test\.ts$", r"\.spec\.ts$"],
    "C++": [r"^test_.*\.(cpp|cc|cxx)$", r"_test\.(cpp|cc|cxx)$", r"[Tt]est\.(cpp|cc|cxx)$", r"[Ss]pec\.(cpp|cc|cxx)$"],
}
SOURCE_EXTENSIONS = {
    "Python": [".py"],
    "Java": [".java"],
    "JavaScript": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"],
    "C++": [".cpp", ".cc", ".cxx", ".h", ".hpp"],
}
CONFIG_FILES = {
    "Python": ["pytest.ini", "setup.cfg", "tox.ini", "pyproject.toml", ".pytest.ini", "conftest.py"],
    "Java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "JavaScript": ["jest.config.js", "jest.config.ts", "jest.config.json", "karma.conf.js", "mocha.opts", ".mocharc.js", ".mocharc.yml"],
    "C++": ["CMakeLists.txt", "CTestTestfile.cmake", "googletest.cmake", "Makefile", "meson.build"],
}
INI_SECTION = r"(?m)^\s*\[\s*(?:tool:pytest|pytest)\s*\]"
TOML_SECTION = r"(?m)^\s*\[\s*tool\.pytest(?:\.ini_options)?\s*\]"
BUILD_WORDS = ["pytest", "unittest", "testng", "junit", "jest"]
CI_WORDS = ["pytest", "unittest", "nose", "tox", "mvn test", "gradle test", "junit", "jest", "mocha", "karma", "jasmine", "npm test", "yarn test", "ctest", "gtest", "googletest", "catch2", "run tests", "run_tests"]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_test_config(name: Column, text: Column) -> Column:
    """Whether a file with a config file's name configures a test runner."""
    ini = name.isin("pytest.ini", ".pytest.ini", "setup.cfg", "tox.ini")
    return F.when(name == "pyproject.toml", text.rlike(TOML_SECTION)).when(ini, text.rlike(INI_SECTION)).when(name.isin("pom.xml", "build.gradle"), _any([F.contains(text, F.lit(w)) for w in BUILD_WORDS])).otherwise(True)


def runs_tests(text: Column) -> Column:
    low = F.lower(text)
    return _any([F.contains(low, F.lit(w)) for w in CI_WORDS])


def confidence(signals: Column) -> Column:
    return F.when(signals >= 3, "high").when(signals == 2, "medium").when(signals == 1, "low").otherwise("none")


def detect(tree: DataFrame, language: str) -> DataFrame:
    """A row for each repository with its signals; only config and CI files' contents are looked at."""
    path, dirs, name = F.col("path"), directories(F.col("path")), file_name(F.col("path"))
    walked = ~F.exists(dirs, lambda d: d.isin(*NOT_WALKED) | F.startswith(d, F.lit(".")) & (d != ".github"))
    in_test_only = F.exists(dirs, lambda d: F.lower(d).isin(*TEST_ONLY_DIRS))
    is_test = _any([name.rlike(p) for p in TEST_FILES.get(language, [])]) | in_test_only & extension(path).isin(*SOURCE_EXTENSIONS.get(language, []))
    homes = F.transform(F.filter(F.transform(dirs, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: F.lower(x["d"]).isin(*TEST_DIRS)), lambda x: F.array_join(F.slice(dirs, F.lit(1), x["i"] + 1), "/"))
    config = name.isin(*CONFIG_FILES.get(language, []))
    ci = name.rlike(r"\.ya?ml$") & F.array_contains(dirs, ".github")
    text = F.when(config | ci, decoded(F.col("content")))
    empty = F.array().cast("array<string>")
    rows = tree.select("repo", walked.alias("walked"), is_test.alias("is_test"), F.when(is_test, homes).otherwise(empty).alias("homes"), F.when(config & is_test_config(name, text), name).alias("config"), (ci & runs_tests(text)).alias("ci"))
    per = rows.withColumns({c: F.when(F.col("walked"), F.col(c)) for c in ("is_test", "homes", "config", "ci")}).groupBy("repo").agg(
        F.count_if("is_test").cast("int").alias("test_file_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("homes", empty))))).alias("test_directories_found"),
        F.sort_array(F.collect_list("config")).alias("test_config_files_found"),
        F.coalesce(F.bool_or("ci"), F.lit(False)).alias("has_ci_test_invocation"),
    )
    per = per.withColumns({"has_test_directory": F.size("test_directories_found") > 0, "has_test_files": F.col("test_file_count") > 0, "has_test_config": F.size("test_config_files_found") > 0})
    signals = sum((F.col(c).cast("int") for c in ("has_test_directory", "has_test_files", "has_test_config", "has_ci_test_invocation")), F.lit(0))
    return per.select("repo", (signals >= 2).alias("test_suite_present"), confidence(signals).alias("confidence"), "has_test_directory", "has_test_files", "has_test_config", "has_ci_test_invocation", "test_file_count", "test_directories_found", "test_config_files_found")
