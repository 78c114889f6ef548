"""Greedy keep-first de-duplication, in parallel and with the sequential loop's result.

A row is dropped if an earlier kept row is similar: the lexicographically first
maximal independent set of the similarity graph. Token sets are sets of 64-bit
hashes, so that neither shuffles nor comparisons carry strings.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import code_tokens
from corpusmill.operators.graph import dropped_by_earlier, dropped_in_groups
from corpusmill.operators.setjoin import candidates
from corpusmill.sources.scratch import remove, written

#: Permutations of a signature. Keys that a join sends to all executors at most.
PERMUTATIONS, SENT = 128, 500_000


def token_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and the sorted hashes of its distinct tokens; blank or null text gives null, which is never similar."""
    tokens = F.array_sort(F.array_distinct(F.transform(code_tokens(F.col(text)), lambda t: F.xxhash64(t))))
    return rows.select(key, F.when(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), tokens).alias("tokens"))


def _live(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """rows semi- or anti-joined with keys; as many keys as are safe to send are sent, so that wide rows stay where they are."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT else keys, key, how)


def split_copies(sets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each class of equal token sets, with its tokens; and the keys of all other members."""
    live = written(sets.withColumns({"_x": F.xxhash64("tokens"), "_y": F.hash("tokens")}), "dedup-sets")[0].filter("tokens IS NOT NULL")  # filtered once written: before, texts would be tokenized for the filter too
    heads = live.groupBy("_x", "_y").agg(F.min(key).alias(key)).select(key)
    copies = written(live.select(key).join(heads, key, "left_anti"), "dedup-copies")[0]
    return _live(live.select(key, "tokens"), copies, key, "left_anti"), copies


def verified(pairs: DataFrame, sets: DataFrame, key: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col(key).alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.filter(shared * 100 >= (F.size("ta") + F.size("tb") - shared) * percent).select("a", "b")


def exact_pairs(firsts: DataFrame, key: str, percent: int) -> DataFrame:
    """a, b (a < b): pairs of different sets that reach the similarity."""
    kind = firsts.schema[key].dataType
    maybe = candidates(firsts, key, percent).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    return verified(maybe, firsts, key, percent)


def dropped_near(firsts: DataFrame, key: str, percent: int) -> DataFrame:
    """k: the sets that the sequential loop drops; key is long.

    Sets are compared for as many pairs as there are sets in them, about. While there
    are more, a set without an earlier candidate is kept for sure, and each set that is
    found near one goes with all of its pairs: a large group of near copies takes a comparison each.
    """
    spark = firsts.sparkSession
    pairs, path = written(candidates(firsts, key, percent), "dedup-pairs")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "dedup-nodes")[0]
    near, n, few = written(_live(firsts, nodes, key, "left_semi"), "dedup-near")[0], pairs.count(), nodes.count()
    found = []
    while n > few:
        heads = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        stars = written(pairs.join(heads, "a", "left_semi").groupBy("b").agg(F.min("a").alias("a")), "dedup-stars")[0]
        out = written(verified(stars, near, key, percent).select(F.col("b").alias("k")), "dedup-out")[0]
        found.append(out)
        rest = pairs.join(stars, ["a", "b"], "left_anti").join(out.withColumnRenamed("k", "a"), "a", "left_anti").join(out.withColumnRenamed("k", "b"), "b", "left_anti")
        old, before = path, n
        pairs, path = written(rest.select("a", "b"), "dedup-pairs")
        remove(spark, old)
        n = pairs.count()
        if n > 0.9 * before:  # rounds no longer pay
            break
    every = dropped_by_earlier(verified(pairs, near, key, percent))
    for more in found:
        every = every.unionByName(more)
    return every


@functools.cache
def banding(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows whose chance to miss above the threshold and to hit below it, summed evenly, is least."""
    s = (np.arange(1000) + 0.5) / 1000
    below = s < threshold
    best = (np.inf, 1, 1)
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            hit = 1 - (1 - s**rows) ** bands
            best = min(best, (float(np.where(below, hit, 1 - hit).sum()), bands, rows))
    return best[1:]


def minhash(sets: DataFrame, key: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """key and signature: for each permutation i, the least (token hash * m_i + c_i) mod 2**64, all but the upper 32 bits cut off.

    An empty set has the greatest value everywhere; null sets are left out.
    """
    mult, add = permutation_constants(permutations)

    @F.pandas_udf("array<long>")
    def signature(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            low = np.full(permutations, 0xFFFFFFFF, np.uint64)
            x = np.asarray(s, np.int64).view(np.uint64)
            for at in range(0, len(x), 4096):
                low = np.minimum(low, ((x[at : at + 4096, None] * mult + add) >> np.uint64(32)).min(0))
            out.append(low.astype(np.int64))
        return pd.Series(out)

    return sets.filter("tokens IS NOT NULL").select(key, signature("tokens").alias("signature"))


def permutation_constants(permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, permutations, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, permutations, dtype=np.uint64)


def band_groups(sets: DataFrame, key: str, bands: int = 9, rows: int = 13) -> DataFrame:
    """key and band: a row for each band that the set shares with another."""
    signed = minhash(sets, key, bands * rows)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, F.lit(rows))))
    banded = signed.select(key, F.explode(pieces).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    return banded.join(shared, "band")


def keep_first(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key and kept for every node; pairs has a earlier than b, both long."""
    marks = dropped_by_earlier(pairs).select(F.col("k").alias(key), F.lit(False).alias("_out"))
    return nodes.select(key).join(marks, key, "left").select(key, F.col("_out").isNull().alias("kept"))


def _numbered(live: DataFrame, key: str) -> DataFrame:
    """key and id: whole numbers in the order of the keys."""
    if isinstance(live.schema[key].dataType, T.LongType | T.IntegerType):
        return live.select(key, F.col(key).cast("long").alias("id"))
    # Written, so that all uses see the same numbers.
    return written(live.select(key).orderBy(key).withColumn("id", F.monotonically_increasing_id()), "dedup-order")[0]


def deduplicate(rows: DataFrame, key: str, text: str, percent: int = 80, mode: str = "exact") -> DataFrame:
    """rows that survive, keys giving precedence; mode exact verifies token-set similarity, lsh takes any shared band.

    A copy of an earlier set always goes: what would drop the first also drops the copy.
    """
    firsts, copies = split_copies(token_sets(rows, key, text), key)
    order = _numbered(firsts, key)
    if isinstance(rows.schema[key].dataType, T.LongType | T.IntegerType):
        firsts = firsts.select(F.col(key).cast("long").alias("id"), "tokens")
    else:
        firsts = written(firsts.join(order, key).select("id", "tokens"), "dedup-firsts")[0]
    if mode == "exact":
        gone = dropped_near(firsts, "id", percent)
    else:  # all who share a band are held for similar
        gone = dropped_in_groups(band_groups(firsts, "id", *banding(percent / 100)).select(F.col("id").alias("a"), F.col("band").alias("g")))
    gone = gone.select(F.col("k").alias("id"))
    dropped = order.join(gone, "id", "left_semi").select(key).unionByName(copies)
    return rows.join(dropped, key, "left_anti")
