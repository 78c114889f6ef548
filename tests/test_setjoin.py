"""Candidates against all pairs; comparisons in large groups of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, setjoin


def numbers(rng, n, most=1 << 62):
    return {rng.randrange(-most, most) for _ in range(n)}


@pytest.mark.parametrize("percent", [80, 30])
def test_candidates_lose_no_pair_and_pass_few_others(spark, percent, monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK", 500)
    monkeypatch.setattr(setjoin, "WORDS", 64)
    monkeypatch.setattr(setjoin, "SLICE", 3000)
    rng = random.Random(2)
    common = sorted(numbers(rng, 300))
    sets = [set()]
    for n in (3, 40, 200, 400, 401, 900, 1700):  # sketches of several widths, pairs across them
        for _ in range(4):
            s = numbers(rng, n // 2) | set(rng.sample(common, min(n // 2, 250)))
            sets.append(s)
            for share in (0.02, 0.1, 0.15, 0.4):
                cut = set(sorted(s)[int(len(s) * share) :])
                sets += [cut, cut | numbers(rng, int(n * share / 2))]
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(10**6, None)], "k long, tokens array<long>").repartition(3)
    got = [tuple(r) for r in setjoin.candidates(df, "k", percent).collect()]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i] | sets[j]}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100
    if percent == 80:
        assert len(got) < 2 * len(want)


def test_near_copies_are_compared_with_their_first(spark, monkeypatch):
    rng = random.Random(3)
    base = sorted(numbers(rng, 100))
    sets = [sorted(set(base) - {base[i]}) for i in range(90)] + [sorted(numbers(rng, 30)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<long>").withColumn("id", F.col("id").cast("long"))
    compared = []
    plain = dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    assert sorted(r["k"] for r in dedup.dropped_near(df, "id", 80).collect()) == list(range(1, 90))
    assert sum(compared) < 200  # of 4005 pairs


def test_the_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 150))
    b[:100] = a[:100]
    x, y = (setjoin._sketches(np.zeros(150, np.int64), s, 1, 8).view(np.uint64) for s in (a, b))
    assert 0 < np.bitwise_count(x ^ y).sum() <= 100
