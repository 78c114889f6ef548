import random

import pytest

from corpusmill.operators import allocation

CASES = [
    ({"a": 10, "b": 5}, 0, (0, 0)), ({"a": 10, "b": 5}, 1, (1, 0)), ({"a": 10, "b": 5}, 3, (2, 1)), ({"a": 10, "b": 5}, 7, (4, 3)), ({"a": 10, "b": 5}, 100, (10, 5)),
    ({"a": 100, "b": 50, "c": 25, "d": 25}, 10, (4, 2, 2, 2)), ({"a": 10, "b": 5, "c": 0}, 7, (4, 3, 0)), ({"a": 3, "b": 3, "c": 9, "d": 0}, 2, (1, 0, 1, 0)), ({"a": 4, "b": 4}, 3, (2, 1)), ({"x": 2, "y": 3, "z": 4}, 6, (1, 2, 3)), ({"p": 276, "q": 52}, 20, (16, 4)),
]


@pytest.mark.parametrize("counts,cap,want", CASES)
def test_known_caps(spark, counts, cap, want):
    rows = allocation.stratified_caps(spark.createDataFrame(list(counts.items()), "repo string, cnt long"), cap).orderBy("repo").collect()
    assert tuple(r["cap_rows"] for r in rows) == want


def test_cap_invariants(spark):
    rng = random.Random(3)
    for _ in range(8):
        counts = {f"r{i}": rng.randrange(0, 40) for i in range(rng.randrange(1, 12))}
        cap = rng.randrange(0, 150)
        got = {r["repo"]: r["cap_rows"] for r in allocation.stratified_caps(spark.createDataFrame(list(counts.items()), "repo string, cnt long"), cap).collect()}
        assert sum(got.values()) == min(cap, sum(counts.values()))
        assert all(0 <= got[k] <= counts[k] for k in counts)
        if cap >= sum(c > 0 for c in counts.values()):
            assert all(got[k] >= 1 for k in counts if counts[k])


def test_negative_cap(spark):
    with pytest.raises(ValueError):
        allocation.stratified_caps(spark.createDataFrame([("a", 1)], "repo string, cnt long"), -1)
