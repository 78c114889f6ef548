"""Null ids, parts, long chains and many blocks against brute force."""

import numpy as np
import pytest

from corpusmill.llm import neardup
from tests.llm.test_operators import BASE, brute_components

SCHEMA = "doc_id long, text string, id int, root string, family int, n int, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, "c") for i, t in rows], SCHEMA)


def near_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 100)]
    out = []
    for _ in range(n):
        t = list(base)
        for k in rng.integers(0, 100, int(rng.integers(0, 7))):
            t[k] = words[int(rng.integers(0, 400))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("block", "shingles", "part"), [(2048, 8_000_000, 1024), (7, 8_000_000, 3), (2048, 700, 1)])
def test_null_ids_blocks_and_parts(spark, monkeypatch, block, shingles, part):
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHINGLES", shingles)
    texts = near_texts(60, 3) + [None, "", " \n", BASE, BASE, BASE + "x", "just three words", "JUST three\twords"] + near_texts(12, 4)
    texts += texts[:6]
    ids = [None if i % 5 == 0 else 1000 - i for i in range(len(texts))]
    ids[-1] = ids[3]  # one id with two texts
    sizes, roots = brute_components(texts, 4, 80)
    up = {}
    for i, r in enumerate(roots):  # an id with two texts joins their components
        up.setdefault(r, r)
    a, b = roots[3], roots[len(texts) - 1]
    roots = [min(a, b) if r in (a, b) else r for r in roots]
    least = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(ids[i], sizes[i], ids[i] if not sizes[i] else least.get(roots[i])) for i in range(len(texts))]
    got = neardup.near_duplicates(frame(spark, zip(ids, texts)).repartition(3), 4, 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        if r["doc_id"] is not None:
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["kept"] == (r["component_id"] is None) or r["kept"] is False


def test_components_of_a_chain_a_star_and_a_cloud(spark):
    rng = np.random.default_rng(6)
    chain = rng.permutation(1000)
    links = [(int(a), int(b)) for a, b in zip(chain, chain[1:])]
    links += [(5000, 5000 + i) for i in range(1, 2000)]
    cloud = rng.integers(10_000, 10_400, (300, 2)).tolist()
    links += [(a, b) for a, b in cloud if a != b]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a long, b long"), 20).collect()}
    assert got == {i: root(i) for i in up}


def test_components_that_do_not_settle_raise(spark):
    chain = np.random.default_rng(1).permutation(500).tolist()
    with pytest.raises(RuntimeError, match="settled"):
        neardup.components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long"), 1)


def test_large_ids_keep_their_links(spark):
    texts = near_texts(40, 9)
    ids = [(1 << 62) - 7 * i for i in range(20)] + [-(1 << 60) - 3 * i for i in range(20)]
    _, roots = brute_components(texts, 4, 80)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(least.get(r, i), i)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, zip(ids, texts)).repartition(3), 4, 80).collect()}
    assert got == {i: least[r] for i, r in zip(ids, roots)}


def test_parts_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 4)
    rows = [(band, i) for band, n in ((5, 1), (7, 9), (8, 2), (-3, 13), (1 << 62, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "band long, id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, neardup.shared_bands(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((band, i, i // 4) for band, i in rows if band != 5)
