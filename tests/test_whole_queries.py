"""Queries that keep whole texts and all rows, by hand counts."""

from corpusmill.plans import catalogue


def test_texts_with_equal_beginnings_differ(spark, tmp_path):
    start = "the same beginning of more than forty characters, then "
    docs = [(1, start + "one", "a"), (2, start + "two", "a"), (3, start + "one", "b"), (4, None, "src1"), (5, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, start + "two"), (4, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1,), (2,), (3,), (5,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("contamination_semi") == [(2,), (4,)]
    assert run("lookup_first") == [(1, 1), (2, 2), (3, 1)]


def test_every_page_has_a_position(spark, tmp_path):
    paths = [f"{d}/{i:03}.html" if d else f"{i:03}.html" for i in range(50) for d in ("", "b", "b/c", "a")]
    spark.createDataFrame([(i, f"https://h.org/{p}") for i, p in enumerate(paths)], "page_id long, url string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    want = sorted(range(200), key=lambda i: ([(k < paths[i].count("/"), x) for k, x in enumerate(paths[i].split("/"))], i))
    got = {r["page_id"]: r["pos"] for r in catalogue.QUERIES["file_order"](spark, str(tmp_path)).collect()}
    assert got == {i: k + 1 for k, i in enumerate(want)}
