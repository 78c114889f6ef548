"""Training data jobs and functions by name."""

from corpusmill import sinks
from corpusmill.functions.register import register
from corpusmill.plans import datasets


def test_balance_convert_and_check(spark):
    fs = spark.createDataFrame([(f"r{i % 3}", f"f{i}.py", "main" if i == 0 else f"f{i}", f"def f{i}():\n    return {i}", f"def f{i}(): pass", i) for i in range(30)], "repo string, file_path string, func_name string, source_code string, signature string, k int")
    cs = fs.withColumnsRenamed({"func_name": "class_name", "signature": "skeleton"})
    out = datasets.balance_and_convert(fs, cs, 4, 7, "k", ["r2"])
    assert out["function"].count() == 7 and out["function"].columns == list(datasets.FUNCTION_COLUMNS.values())
    assert {r[0] for r in out["class"].select("repository_name").collect()} == {"r0", "r1"}
    assert datasets.qa(out["function"], "complete_extracted_code") == {"missing": 0, "blank": 0, "short": 0}
    bad = spark.createDataFrame([(None,), ("  \n",), ("x",), ("a long enough text",)], "c string")
    assert datasets.qa(bad, "c") == {"missing": 1, "blank": 1, "short": 1}
    rows = datasets.training_rows(out["function"], "complete_extracted_code", 0, "Python", "function", "human", "repository_name")
    both = datasets.assembled([rows, datasets.training_rows(bad, "c", 1, "Python", "function", "m")])
    assert both.count() == 9 and {r[0] for r in both.select("split").distinct().collect()} <= {"train", "val", "test"}


def test_jobs_skip_what_exists(spark, tmp_path):
    df = spark.createDataFrame([("```\ndef f(): pass\n```",)], "raw string")
    jobs = [(str(tmp_path / "a"), lambda: datasets.cleaned_table(df, "raw", "Python", "function")), (str(tmp_path / "b"), lambda: df.select("missing"))]
    assert [len(v) for v in datasets.run_jobs(spark, jobs).values()] == [1, 0, 1]
    assert [len(v) for v in datasets.run_jobs(spark, jobs).values()] == [0, 1, 1]
    assert sinks.read_csv(spark, str(tmp_path / "a")).first()["generated_code_cleaned"] == "def f(): pass"


def test_functions_by_name(spark):
    register(spark)
    r = spark.sql("SELECT code_metrics('def f(a):\\n    return a and 1\\n', 'Python') AS m, code_metrics(NULL, 'Java') AS n, clean_snippet('class A {}', 'Java', 'class') AS c").first()
    assert r["m"]["cyclomatic_complexity"] == 2 and r["n"]["loc"] is None and r["c"] == "class A {}"
    found = spark.sql("SELECT * FROM code_definitions('class A { void m() { } }', 'Java')").collect()
    assert [(x["kind"], x["name"], x["parent"]) for x in found] == [("class", "A", None), ("function", "m", "A")]
