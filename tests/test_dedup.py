import random

import pytest
import xxhash

from corpusmill.operators import dedup, graph


def greedy(n, pairs):
    kept = []
    for i in range(n):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    return kept


def test_keep_first_equals_the_loop(spark):
    rng = random.Random(5)
    for n, density in ((12, 0.2), (20, 0.4)):
        pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < density}
        nodes = spark.createDataFrame([(i,) for i in range(n)], "k long")
        got = dedup.keep_first(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"), "k")
        assert sorted(r["k"] for r in got.filter("kept").collect()) == greedy(n, pairs)


def test_copies_and_blanks(spark):
    rows = [(1, "def f(a): return a + b"), (2, "def f(a): return a + b"), (3, ""), (4, " \n"), (5, None), (6, "class Other: pass")]
    df = spark.createDataFrame(rows, "k long, text string")
    for mode in ("exact", "lsh"):
        assert sorted(r["k"] for r in dedup.deduplicate(df, "k", "text", 80, mode).collect()) == [1, 3, 4, 5, 6]


def test_banding_follows_the_threshold():
    from corpusmill.operators.dedup import banding

    assert banding(0.8) == (9, 13)
    (b1, r1), (b2, r2) = banding(0.4), banding(0.95)
    assert b1 > b2 and r1 < r2 and b1 * r1 <= 128 and b2 * r2 <= 128


@pytest.mark.parametrize("solve", [1_000_000, 40, 3])
def test_long_chains_and_random_links_equal_the_loop(spark, monkeypatch, solve):
    monkeypatch.setattr(graph, "SOLVE", solve)
    rng = random.Random(solve)
    chain = 1000 if solve > 40 else 9
    links = {(i, i + 1) for i in range(chain)}
    links |= {tuple(sorted(rng.sample(range(2000, 2060), 2))) for _ in range(90)}
    nodes = sorted({x for p in links for x in p})
    got = {r["k"] for r in graph.dropped_by_earlier(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    kept = set()
    for i in nodes:
        if not any((k, i) in links for k in ((i - 1,) if i <= chain else kept)) or (i <= chain and i - 1 not in kept):
            kept.add(i)
    assert got == set(nodes) - kept


@pytest.mark.parametrize("solve", [1_000_000, 60, 5])
def test_groups_equal_the_loop(spark, monkeypatch, solve):
    monkeypatch.setattr(graph, "SOLVE", solve)
    rng = random.Random(4)
    members = {(rng.randrange(60), -g) for g in range(40) for _ in range(rng.randrange(1, 5))} | {(1000 + i, 7) for i in range(300)}
    kept, taken = set(), set()
    for i in sorted({a for a, _ in members}):
        mine = {g for a, g in members if a == i}
        if not mine & taken:
            kept.add(i)
            taken |= mine
    got = [r["k"] for r in graph.dropped_in_groups(spark.createDataFrame(sorted(members), "a long, g long")).collect()]
    assert sorted(got) == sorted({a for a, _ in members} - kept)


def words(rng, n):
    return [f"w{rng.randrange(300)}" for _ in range(n)]


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        t = words(rng, rng.randrange(1, 60)) if rng.random() < 0.4 or not texts else list(rng.choice(texts))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(["the", "of", f"w{rng.randrange(300)}"])
        texts.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "k long, text string").repartition(3)
    for percent in (30, 80):
        got = {tuple(r) for r in dedup.exact_pairs(dedup.token_sets(df, "k", "text"), "k", percent).collect()}
        sets = [set(t) for t in texts]
        assert got == {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def test_signatures_and_lsh_equal_plain_versions(spark):
    rng = random.Random(9)
    base = words(rng, 80)
    texts = [" ".join(base[: 80 - k] + words(rng, k)) for k in (0, 0, 3, 5, 40)] + [" ".join(words(rng, 50)) for _ in range(10)] + [None, " ", "12 34", "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    mult, add = (v.tolist() for v in dedup.permutation_constants())

    def signature(t, n):
        hashes = {xxhash.xxh64(w.encode(), seed=42).intdigest() for w in t.split() if not w.isdigit()}
        return [min([(h * m + c) % 2**64 >> 32 for h in hashes], default=2**32 - 1) for m, c in zip(mult[:n], add[:n])]

    live = {i: t for i, t in enumerate(texts) if t and t.strip()}
    got = {r["k"]: r["signature"] for r in dedup.minhash(dedup.token_sets(df, "k", "text"), "k").collect()}
    assert got == {i: signature(t, 128) for i, t in live.items()}
    bands, rows = dedup.banding(0.8)
    constants = dedup.permutation_constants(bands * rows)
    mult, add = (v.tolist() for v in constants)
    kept, taken = [], set()
    for i, t in enumerate(texts):
        if i not in live:
            kept.append(i)
            continue
        s = signature(t, bands * rows)
        mine = {(b, tuple(s[b * rows : (b + 1) * rows])) for b in range(bands)}
        if not mine & taken:
            kept.append(i)
            taken |= mine
    assert sorted(r["k"] for r in dedup.deduplicate(df, "k", "text", 80, "lsh").collect()) == kept


def test_struct_keys_give_precedence(spark):
    rows = [((2, "a"), "x y z"), ((1, "b"), "z y x"), ((1, "a"), "q r s"), ((3, "c"), "x y z")]
    df = spark.createDataFrame(rows, "k struct<p: int, q: string>, text string")
    assert sorted(tuple(r["k"]) for r in dedup.deduplicate(df, "k", "text").collect()) == [(1, "a"), (1, "b")]
