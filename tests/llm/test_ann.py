"""Recall of the nearest-neighbour windows against brute force, on tables that they do not cover."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.llm import ann


def recalls(spark, e):
    """Recall at 20 of each query."""
    found = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    out = {}
    for q, ids in found.items():
        s = e @ e[q]
        s[q] = -np.inf
        out[q] = len(ids & set(np.argsort(-s)[:20].tolist())) / 20
    return out


def test_a_jittered_cluster_is_met_whole(spark):
    rng = np.random.default_rng(9)
    e = rng.standard_normal((2000, 64))
    e[:666] = rng.standard_normal(64) + 1e-3 * rng.standard_normal((666, 64))
    got = recalls(spark, e)
    assert len(got) == 100
    assert np.mean([r for q, r in got.items() if q < 666]) > 0.99
    assert np.mean([r for q, r in got.items() if q >= 666]) > 0.95


def test_windows_narrow_without_a_step(spark):
    rng = np.random.default_rng(7)
    e = rng.standard_normal((4400, 64))
    assert np.mean(list(recalls(spark, e[:2001]).values())) == 1.0
    assert np.mean(list(recalls(spark, e).values())) > 0.99


def test_recall_through_the_narrowest_windows(spark):
    assert np.mean(list(recalls(spark, np.random.default_rng(7).standard_normal((2400, 64))).values())) > 0.92


def searched(spark, monkeypatch, rows, **options):
    """Found ids and scores by query, the index that served, and the shuffled rows and products made."""
    kept, made = [], {"products": 0}
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **k: kept.append(fit(*a, **k)) or kept[-1])
    found = {}
    for r in ann.search(rows, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    index = kept[0]
    made["share"] = len(index.curves) * min(1.0, (2 * index.width + 1) / index.cells)
    return {q: sorted(v) for q, v in found.items()}, index, made


def frame(spark, e):
    n = len(e)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), e.shape[1]).cast(pa.list_(pa.float64()))
    ones = pa.array(np.ones(n, np.int32))
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists, "query_id": ones, "rank": ones, "tile": ones, "score": pa.array(["x"] * n)}))


def mean_recall(e, found):
    out = []
    for q, rows in found.items():
        s = e @ e[q]
        s[q] = -np.inf
        out.append(len({v for _, v, _ in rows} & set(np.argsort(-s)[:20].tolist())) / 20)
        assert np.allclose([x for _, _, x in rows], s[[v for _, v, _ in rows]], atol=1e-12)
    return np.mean(out)


@pytest.mark.parametrize("n", [400, 5000, 50_000])
def test_clustered_vectors_are_found_through_narrow_windows(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((max(4, n // 200), 32)) * 1.5
    e = centres[rng.integers(0, len(centres), n)] + 0.1 * rng.standard_normal((n, 32))
    found, index, made = searched(spark, monkeypatch, frame(spark, e))
    assert len(found) == n // 20 and all(len(v) == 20 for v in found.values())
    assert mean_recall(e, found) >= 0.9
    if n >= 5000:  # through windows, for less than half of a full search's products
        assert index.width < index.cells and made["share"] <= 0.5


def test_isotropic_vectors_are_searched_whole(spark, monkeypatch):
    e = np.random.default_rng(4).standard_normal((5000, 64))
    found, index, made = searched(spark, monkeypatch, frame(spark, e))
    assert (index.width, made["share"]) == (index.cells, 1.0)
    assert mean_recall(e, found) == 1.0


@pytest.mark.parametrize("n", [2000, 12_000])
def test_windows_alone_reach_the_target_on_isotropic_vectors(spark, monkeypatch, n):
    e = np.random.default_rng(n).standard_normal((n, 24))
    found, index, _ = searched(spark, monkeypatch, frame(spark, e), worth=float("inf"))
    assert index.width < index.cells
    assert mean_recall(e, found) >= 0.94  # the windows were chosen for 0.97 of the probes' neighbours


def test_small_segments_and_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    e = rng.standard_normal((1500, 12))
    want, _, _ = searched(spark, monkeypatch, frame(spark, e))
    monkeypatch.setattr(ann, "HELD", 7)
    monkeypatch.setattr(ann, "SEGMENT", 100)
    got, _, _ = searched(spark, monkeypatch, frame(spark, e))
    assert got == want


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    e = rng.integers(-2, 3, (300, 6)).astype(float)
    e[(e == 0).all(1)] = 1
    e[100:190] = e[100]
    ids = rng.permutation(1000)[:300]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, e)]
    rows += rows[:5] + [(None, [1.0] * 6), (2000, None), (2020, [0.0] * 6), (2040, [float("inf")] + [1.0] * 5), (2060, [None] + [1.0] * 5), (2080, []), (2100, [1.0] * 5)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    for q, found in got.items():
        s = e @ e[list(ids).index(q)]
        want = sorted(((-x, int(i)) for x, i in zip(s, ids) if i != q))[:20]
        assert sorted(found) == [(k + 1, i, -x) for k, (x, i) in enumerate(want)]


def test_a_third_of_one_vector_is_not_sorted_in_one_task(spark):
    e = np.random.default_rng(1).standard_normal((3000, 8))
    e[::3] = e[0]
    rows = ann.usable_vectors(frame(spark, e))
    same = Window.partitionBy(F.xxhash64("embedding")).orderBy("vec_id")
    plan = rows.withColumn("copy", F.row_number().over(same)).filter("copy <= 21")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # the first of them before the shuffle


def test_hilbert_keys_sort_as_the_curve_does():
    points = np.stack(np.meshgrid(*[np.arange(16)] * 2, indexing="ij"), -1).reshape(-1, 2)
    order = np.argsort(ann.hilbert(points, 4), kind="stable")
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()
