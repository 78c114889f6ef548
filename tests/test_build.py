"""Trees of small files through scan, walks, manifests, test detection, build and command line."""

import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.__main__ import main
from corpusmill.config import Config, cap_or_none, default_end
from corpusmill.functions.records import extract, minified
from corpusmill.operators import cleaning, extraction, manifests, scoring, testsuite
from corpusmill.plans import build
from corpusmill.sources import files, remote
from corpusmill import sinks

PY = "import os\n\ndef {a}(x):\n    return os.path.join(x, '{a}')\n\n\nclass K{a}:\n    def m(self):\n        return 1\n"


def tree(spark, rows):
    return spark.createDataFrame([(r, p, bytearray(t if isinstance(t, bytes) else t.encode())) for r, p, t in rows], "repo string, path string, content binary")


def test_eligible_files(spark):
    keep = ["a.py", "src/env/b.py", ".hidden/c.py", "external/d.py", "testing/e.py", "x.y.py"]
    drop = ["tests/a.py", "a/build/b.py", "test_x.py", "TestApp.py", "pkg/x_test.py", "a.txt", ".py", "a/.venv/b.py", "a.PY"]
    got = spark.createDataFrame([(p,) for p in keep + drop], "path string").filter(files.eligible(F.col("path"), "Python"))
    assert sorted(r[0] for r in got.collect()) == sorted(keep)
    js = spark.createDataFrame([("a.min.js",), ("a/node_modules_x/b.js",), ("a.jsx",), ("b.mjs",), ("c.ts",), ("d.test.js",)], "path string")
    assert [r[0] for r in js.filter(files.eligible(F.col("path"), "JavaScript")).collect()] == ["a.jsx"]
    rows = tree(spark, [("r", "build/tests/a.py", ""), ("r", "tests/build/a.py", ""), ("r", "vendor/x.txt", ""), ("q", "a.py", "")])
    assert {r[0]: r[1] for r in files.skipped_counts(rows, "Python").collect()} == {"r": 1, "q": 0}
    order = ["z.py", "a/b.py", "a/c/d.py", "b/a.py"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in reversed(order)], "path string").orderBy(files.order_key(F.col("path"))).collect()] == order
    assert minified("x" * 1001) and minified("x" * 301 + "\n" + "y" * 301) and not minified("") and not minified("x\n" * 5)


def test_read_tree_and_bad_bytes(spark, tmp_path):
    p = tmp_path / "own" / "er" / "pkg"
    p.mkdir(parents=True)
    (p / "a.py").write_bytes(b"def f():\n    return '\xff'\n")
    rows = files.read_tree(spark, str(tmp_path))
    got = extraction.functions(extraction.definitions(rows, "Python")).collect()
    assert [(r["repo"], r["file_path"], r["func_name"], "\ufffd" in r["source_code"]) for r in got] == [("own/er", "pkg/a.py", "f", True)]


def test_definitions_counts_and_caps(spark):
    rows = tree(spark, [("r", f"{a}.py", PY.format(a=a)) for a in "abc"] + [("q", "lib/z.py", PY.format(a="z")), ("q", "empty.py", "")])
    found = extraction.definitions(rows, "Python").cache()
    assert found.filter("error IS NOT NULL").count() == 0
    counts = {r["repo"]: (r["functions"], r["classes"]) for r in extraction.content_counts(rows, "Python").collect()}
    assert counts == {"r": (6, 3), "q": (2, 1)}
    assert {r["repo"]: (r["functions"], r["classes"]) for r in extraction.content_counts(rows, "Python", ["class"]).collect()} == {"r": (0, 3), "q": (0, 1)}
    fs = extraction.functions(found)
    first = fs.filter("func_name = 'a'").first()
    assert first["used_imports"] == ["import os"] and first["parameters"] == ["x"] and not first["is_method"] and first["cyclomatic_complexity"] == 1
    caps = spark.createDataFrame([("r", 3)], "repo string, cap_rows long")
    assert sorted((r["repo"], r["func_name"]) for r in extraction.capped(fs, caps).collect()) == [("q", "m"), ("q", "z"), ("r", "a"), ("r", "b"), ("r", "m")]
    assert {r["repo"]: r["loc"] for r in extraction.repo_loc(rows, "Python").collect()}["q"] == 6
    assert extraction.node_histogram(found).filter("type = 'name'").first()["n"] > 10
    with pytest.raises(ValueError):
        extraction.definitions(rows, "Cobol")
    assert extract("", "Java") == []


def test_dependencies(spark):
    rows = tree(spark, [
        ("p", "requirements.txt", "# no\nrequests[security]>=2.0 # why\n-r other.txt\nnumpy\n\n"),
        ("p", "requirements/dev.txt", "pytest==8\n"),
        ("p", "pyproject.toml", '[project]\ndependencies = ["httpx[http2]>=0.27", "rich"]\n[project.optional-dependencies]\nx = ["black"]\n[tool.poetry.dependencies]\npython = "^3"\nattrs = {version = "1.0"}\n[tool.poetry.dev-dependencies]\nmypy = "*"\n'),
        ("p", "setup.cfg", "[options]\ninstall_requires =\n    flask>=1\n    click\n"),
        ("b", "pyproject.toml", 'broken = \ndependencies = ["a[x]>=1", "b"]\n'),
    ])
    got = [(r["repo"], r["name"], r["version"], r["kind"]) for r in manifests.dependencies(rows, "Python").orderBy("repo", "position").collect()]
    assert got[:2] == [("b", "a", ">=1", "main"), ("b", "b", None, "main")]
    assert got[2:] == [("p", "requests", ">=2.0", "main"), ("p", "numpy", None, "main"), ("p", "pytest", "==8", "main"), ("p", "httpx", ">=0.27", "main"), ("p", "rich", None, "main"), ("p", "black", None, "optional"), ("p", "attrs", "1.0", "main"), ("p", "mypy", "*", "dev"), ("p", "flask", ">=1", "main"), ("p", "click", None, "main")]
    js = tree(spark, [("j", "package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": "*"}}'), ("k", "package.json", "{")])
    assert [(r["name"], r["kind"]) for r in manifests.dependencies(js, "JavaScript").orderBy("position").collect()] == [("a", "main"), ("b", "dev"), ("c", "optional")]
    pom = "<dependency><groupId>g</groupId><artifactId>a</artifactId><version> 1 </version><scope>Test</scope></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency>"
    java = tree(spark, [("m", "pom.xml", pom), ("m", "sub/pom.xml", pom), ("n", "y/pom.xml", pom), ("n", "x/pom.xml", "<x/>")])
    assert [(r["repo"], r["name"], r["version"], r["kind"]) for r in manifests.dependencies(java, "Java").orderBy("repo", "position").collect()] == [("m", "g:a", "1", "dev"), ("m", "h:b", None, "main")]
    cpp = tree(spark, [("c", "conanfile.txt", "[requires]\nfmt/9.1\n# x/1\n[options]\ny/2\n"), ("c", "vcpkg.json", '{"dependencies": ["zlib", {"name": "q", "version": "3"}]}'), ("c", "CMakeLists.txt", "find_package(Threads)\nFIND_PACKAGE( Boost 1.7)")])
    got = manifests.dependencies(cpp, "C++")
    assert [(r["name"], r["version"]) for r in got.orderBy("position").collect()] == [("fmt", "9.1"), ("zlib", None), ("q", "3"), ("Boost", None)]
    assert sorted((r["name"], r["version"]) for r in manifests.dependency_edges(got).collect())[0] == ("Boost", "latest")


def test_test_suites(spark):
    rows = tree(spark, [
        ("full", "tests/unit/test_a.py", ""), ("full", "pyproject.toml", "[tool.pytest.ini_options]\n"), ("full", ".github/workflows/ci.yml", "run: PyTest -q"), ("full", "src/a.py", ""),
        ("none", "tests/data.py", ""), ("none", "setup.cfg", "pytest"), ("none", "venv/test_b.py", ""), ("none", ".hidden/test_c.py", ""),
        ("low", "test_b.py", ""),
    ])
    got = {r["repo"]: r for r in testsuite.detect(rows, "Python").collect()}
    assert (got["full"]["confidence"], got["full"]["test_directories_found"], got["full"]["test_config_files_found"], got["full"]["test_file_count"]) == ("high", ["tests"], ["pyproject.toml"], 1)
    assert got["full"]["test_suite_present"] and not got["low"]["test_suite_present"]
    assert (got["none"]["confidence"], got["low"]["confidence"]) == ("none", "low")
    js = tree(spark, [("j", "src/__tests__/foo.js", ""), ("j", "jest.config.js", "")])
    assert testsuite.detect(js, "JavaScript").first()["test_directories_found"] == ["src/__tests__"]


def test_cleaning(spark):
    assert cleaning.clean_snippet("Sure!\n```python\nimport os\n\n@dec\ndef f():\n    return 1\n\nprint(f())\n```", "Python", "function") == "@dec\ndef f():\n    return 1"
    assert cleaning.clean_snippet("x = 1\ny = (", "Python", "function") == "x = 1"
    assert cleaning.clean_snippet("Here is:\n\npublic class A { void m() {} }", "Java", "function") == "void m() {}"
    assert cleaning.clean_snippet("class A { public: int x; };", "C++", "class") == "class A { public: int x; }"
    assert cleaning.clean_snippet("  ", "Python", "class") is None and cleaning.clean_snippet("no code (", "Java", "class") is None
    assert cleaning.first_python_node("Answer follows:\n def\nclass B:\n    x = 1\n", "class") == "class B:\n    x = 1"
    df = spark.createDataFrame([("```\nfunction f() {}\n```",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.cleaned(F.col("t"), "JavaScript", "function")).collect()] == ["function f() {}", None]
    got = cleaning.generated(df.select(F.coalesce("t", F.lit("")).alias("t")), "t", lambda texts: [t.upper() or None for t in texts])
    assert got.filter("generated_code IS NULL").count() == 1


def test_scores(spark):
    rows = spark.createDataFrame([(f"for x in range({i}): total += x" if i % 2 else f"while queue: node = queue.pop({i})", i % 2) for i in range(60)], "code string, label int")
    model = scoring.train_scorer(rows, "code", "label")
    got = scoring.apply_scorer(model, rows.unionByName(spark.createDataFrame([("  ", 0), (None, 1), ("x " * 600, 1)], rows.schema)), "code").collect()
    assert all((r["llm_score"] > 0.5) == (r["label"] == 1) for r in got[:60])
    assert got[60]["llm_score"] is None and got[61]["llm_score"] is None and got[62]["llm_score_truncated"]
    batches = scoring.score_rows(rows.limit(3).unionByName(spark.createDataFrame([(" ", 0)], rows.schema)), "code", lambda: (lambda t: [0, *t.encode(), 2], lambda ids: [len(x) / 100 for x in ids]))
    assert [(r["llm_score"], r["llm_score_truncated"]) for r in batches.collect()] == [(round((len(r["code"]) + 2) / 100, 4), False) for r in rows.limit(3).collect()] + [(None, None)]
    assert scoring.cut(list(range(600)), "end")[0][-1] == "end" and len(scoring.cut(list(range(600)), 2)[0]) == 512 and not scoring.cut([1] * 512, 2)[1]
    assert scoring.length_order([3, 5, 5, 1]) == [1, 2, 0, 3]


def repos(spark):
    return spark.createDataFrame([("o/big", 50, 3, date(2024, 2, 1), "MIT", "Python"), ("o/small", 40, None, date(2024, 3, 1), None, "Python"), ("o/gone", 30, 9, date(2024, 4, 1), "MIT", "Python"), ("o/java", 90, 9, date(2024, 4, 1), "MIT", "Java"), ("o/old", 90, 9, date(2020, 4, 1), "MIT", "Python"), ("o/few", 90, 1, date(2024, 4, 1), "MIT", "Python")], "full_name string, stars int, contributors int, created date, license_spdx string, language string")


def sources(spark):
    return tree(spark, [("o/big", f"{a}.py", PY.format(a=a)) for a in "abcd"] + [("o/small", "z.py", PY.format(a="z")), ("o/small", "tests/test_z.py", "def test(): pass"), ("o/small", "pytest.ini", "[pytest]"), ("o/few", "n.py", PY.format(a="n")), ("o/big", "build/x.py", "")])


@pytest.mark.parametrize("cap,want", [(4, {"o/big": 3, "o/small": 1}), (None, {"o/big": 8, "o/small": 2})])
def test_build(spark, tmp_path, cap, want):
    config = Config("Python", date(2024, 1, 1), date(2024, 12, 31), min_contributors=2, max_functions=cap, export_format="both", output_dir=str(tmp_path / "out"))
    summary = build.run(repos(spark), sources(spark), config)
    assert summary["failed_repos"] == ["o/gone"] and summary["total_repos_discovered"] == 3
    assert {r["repo"]: r["functions"] for r in summary["repo_stats"]} == want
    assert [(r["license"], r["confidence"]) for r in summary["repo_stats"]] == [("MIT", "none"), ("Unknown", "high")]
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["summary"]["total_functions"] == sum(want.values()) and manifest["extraction"]["files_skipped"] == 1
    assert "github_token" not in manifest["config"]
    back = sinks.read_jsonl(spark, summary["output_paths"]["functions_jsonl"])
    assert back.count() == sum(want.values()) and "return_annotation" in back.columns
    assert spark.read.parquet(summary["output_paths"]["functions_parquet"]).count() == back.count()
    sinks.archive(list(summary["output_paths"].values()), str(tmp_path / "all.zip"))


def test_build_drops_copies(spark, tmp_path):
    config = Config("Python", date(2024, 1, 1), date(2024, 12, 31), min_contributors=2, deduplicate=True, output_dir=str(tmp_path / "out"))
    summary = build.run(repos(spark), sources(spark), config)
    assert summary["total_classes"] < 5 and summary["repo_stats"][0]["classes"] >= 1


def test_config_and_command_line(tmp_path, capsys):
    good = {"language": "C++", "start_date": "2024-01-01", "end_date": "2024-02-01"}
    assert Config.parse(good).shown()["end_date"] == "2024-02-01"
    for wrong in ({"end_date": "2023-01-01"}, {"language": "Go"}, {"max_repos": 0}, {"granularity": []}, {"dedup_threshold": 1.5}, {"min_stars": -1}, {"typo": 1}, {"start_date": "x"}, {"min_contributors": 0}):
        with pytest.raises(ValueError):
            Config.parse(good | wrong)
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert main(["validate-config", str(path)]) == 0
    path.write_text(json.dumps(good | {"typo": 1}))
    assert main(["validate-config", str(path)]) == 1 and "typo" in capsys.readouterr().err
    assert cap_or_none(0) is None and default_end(date(2024, 3, 31)) == date(2024, 3, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", ["x"], None), (2, "d", [], "e")], "i int, t string, l array<string>, n string")
    sinks.write_csv(df.drop("l"), str(tmp_path / "c"))
    assert sorted(r["t"] for r in sinks.read_csv(spark, str(tmp_path / "c")).collect()) == ["a,\"b\"\nc", "d"]
    sinks.write_parquet(df, str(tmp_path / "p"), lists_as_json=True)
    assert {r["l"] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {'["x"]', "[]"}
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    pairs = spark.createDataFrame([("s", 2, "f", "a", "b"), ("s", 1, "g", "c", "d")], "section string, o int, title string, l string, r string")
    assert sinks.side_by_side(pairs, "section", "title", "l", "r", "o").first()["report"].startswith("--- g\n[left]\nc")


def test_remote_calls():
    E = remote.RemoteError
    assert remote.limit_of(E(429)).kind == "secondary" and remote.limit_of(E(403, "x", {"Retry-After": "7"})).retry_after == 7
    assert remote.limit_of(E(403, "API rate limit", {"X-RateLimit-Reset": "100"})).reset.timestamp() == 100
    assert remote.limit_of(E(401)) is None and remote.limit_of(E(404)) is None and remote.limit_of(ValueError()) is None
    assert remote.is_transient(E(502)) and remote.is_transient(E()) and remote.is_transient(TimeoutError()) and not remote.is_transient(E(404))
    assert remote.fails_fast(E(403, "", {"x-ratelimit-remaining": "0"})) and not remote.fails_fast(E(429))
    assert remote.retry_after({"retry-after": "-3"}) == 0 and remote.retry_after({"retry-after": "soon"}) is None
    slept, trouble = [], iter([E(403, "rate limit"), E(429, "", {"retry-after": "3"})])
    given = []

    def pages():
        for i in range(6):
            if i in (2, 4) and i not in given:
                given.append(i)
                raise next(trouble)
            yield i

    w = remote.Waiter(True, sleep=slept.append)
    assert list(w.iterate(pages)) == list(range(6)) and slept == [60, 3] and w.stats() == {"count": 2, "seconds": 63.0}

    def never():
        raise E(429)

    w = remote.Waiter(True, sleep=slept.append)
    with pytest.raises(E):
        w.call(never)
    assert w.waits == remote.MAX_WAITS
    pauses = []
    with pytest.raises(E):
        remote.retried(lambda: (_ for _ in ()).throw(E(500)), pauses.append)
    assert pauses == [0.5, 1.0]
    assert remote.pace(5, 100, slept.append) == 1.0 and remote.pace(50, 100) == 0.0 and remote.pace(None, 1) == 0.0
    assert [remote.duration(x) for x in (45, 125, 3725, 0.2)] == ["45s", "2m 05s", "1h 02m 05s", "1s"]
    with pytest.raises(remote.QuotaError):
        remote.check_quota(3, None, remote.Waiter(), False)
    assert (remote.contributor_pages(0), remote.contributor_pages(101), remote.estimate_repos(60)) == (1, 2, 12)
    assert remote.without_secret("a tok b", "tok") == "a *** b"


def test_paged_stream(spark, tmp_path):
    from corpusmill.streaming import paging

    (tmp_path / "in").mkdir()
    page = lambda n: (tmp_path / "in" / f"page-{n}.json").write_text(json.dumps([{"full_name": f"o/{n}-{i}", "stars": i, "created": "2024-01-01T00:00:00Z"} for i in range(3)]))
    page(0), page(1)
    paging.register(spark)
    assert spark.read.format("paged_repos").option("path", str(tmp_path / "in")).load().count() == 6

    def drain():
        q = spark.readStream.format("paged_repos").option("path", str(tmp_path / "in")).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).start()
        q.processAllAvailable()
        q.stop()

    drain()
    page(2)
    drain()
    names = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("full_name").collect()]
    assert len(names) == 9 and len(set(names)) == 9


@pytest.mark.parametrize("language, code", [("C++", "int f(int a) { return a; }\n"), ("JavaScript", "function f(a) { return a; }\n")])
def test_walks_hand_rows_on_in_small_pieces(language, code):
    batch = pd.DataFrame({"repo": "r", "path": [f"n{i}" for i in range(1200)], "text": code})
    pieces = list(extraction.walked(iter([batch]), language, False, {"function"}))
    assert [len(p) for p in pieces] == [500, 500, 200]
    assert pd.concat(pieces)["file_path"].tolist() == batch["path"].tolist()
    long = pd.DataFrame({"repo": "r", "path": ["a", "b", "c"], "text": code + ("// " + "x" * 77 + "\n") * 12_500})
    assert [len(p) for p in extraction.walked(iter([long]), language, False, {"function"})] == [1, 1, 1]


def test_walk_hands_on_one_files_rows_in_small_pieces_and_reads_bytes():
    code = "".join(f"function f{i}(a) {{ return '\u00e9\U0001f600'; }}\n" for i in range(1200))
    batch = pd.DataFrame({"repo": "r", "path": ["a.js", "b.js", "c.js"], "text": [code, "// nothing\n", "function g() { }\n"]})
    pieces = list(extraction.walked(iter([batch]), "JavaScript", False, {"function"}))
    assert [len(p) for p in pieces] == [500, 500, 201]
    rows = pd.concat(pieces, ignore_index=True)
    assert rows["name"].tolist() == [f"f{i}" for i in range(1200)] + ["g"] and rows["position"].tolist() == [*range(1200), 0]
    as_bytes = batch.assign(text=[x.encode() for x in batch["text"]])
    pd.testing.assert_frame_equal(pd.concat(extraction.walked(iter([as_bytes]), "JavaScript", False, {"function"}), ignore_index=True), rows)
    assert list(extraction.walked(iter([batch[1:2]]), "JavaScript", False, {"function"})) == []


def test_walk_of_texts_of_all_widths(spark):
    texts = {"plain.js": b"function f(a) { return 'x'; }", "wide.js": "function f(a) { return '\u00e9 \u4e2d \U0001f600'; }".encode(), "broken.js": b"function f(a) { return '\xff\xed\xa0\x80'; }", "empty.js": b""}
    tree = spark.createDataFrame([("r", k, bytearray(v)) for k, v in texts.items()] + [("r", "null.js", None)], "repo string, path string, content binary")
    got = {r.file_path: (r.source_code, r.error) for r in extraction.definitions(tree, "JavaScript").collect()}
    assert got == {k: (v.decode("utf-8", "replace"), None) for k, v in texts.items() if v}
    assert extraction.definitions(tree.filter("path = 'empty.js'"), "JavaScript").count() == 0
