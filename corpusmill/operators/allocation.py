"""Corpus caps over groups, ordered limits, refill and seeded sampling; every limit has a total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(seed: str, *keys: str) -> Column:
    """A seeded pseudo-random order key: the same draw on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def stratified_caps(counts: DataFrame, cap: int, group: str = "repo", count: str = "cnt") -> DataFrame:
    """group, cnt, cap_rows: largest-remainder shares with a floor of one, in integers.

    The window runs over one row a group, which is bounded by the number of groups.
    """
    if cap < 0:
        raise ValueError("cap must not be negative")
    every = Window.partitionBy(F.lit(0))
    c = F.col(count)
    live = (c > 0).cast("long")
    df = counts.withColumn("_total", F.sum(c).over(every)).withColumn("_live", F.sum(live).over(every))
    df = df.withColumn("_eff", F.least(F.lit(cap).cast("long"), F.col("_total")))
    df = df.withColumn("_spare", F.col("_total") - F.col("_live")).withColumn("_extra", F.col("_eff") - F.col("_live"))
    by_size = F.row_number().over(every.orderBy(F.desc(count), group))
    share = F.expr(f"CASE WHEN _spare > 0 THEN _extra * ({count} - 1) ELSE 0 END")
    df = df.withColumn("_size_rank", by_size).withColumn("_share", share)
    df = df.withColumn("_floor", F.expr("CASE WHEN _spare > 0 THEN _share div _spare ELSE 0 END")).withColumn("_rest", F.expr("CASE WHEN _spare > 0 THEN _share % _spare ELSE 0 END"))
    df = df.withColumn("_given", F.sum(F.when(c > 0, 1 + F.col("_floor")).otherwise(0)).over(every))
    df = df.withColumn("_rest_rank", F.row_number().over(every.orderBy(F.desc(live), F.desc("_rest"), F.desc(count), group)))
    few = F.when((F.col("_size_rank") <= F.col("_eff")) & (c > 0), 1).otherwise(0)
    many = F.when(c > 0, 1 + F.col("_floor") + F.when(F.col("_rest_rank") <= F.col("_eff") - F.col("_given"), 1).otherwise(0)).otherwise(0)
    return df.select(group, count, F.when(F.col("_eff") < F.col("_live"), few).otherwise(many).cast("long").alias("cap_rows"))


def first_n(rows: DataFrame, caps: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with pos, their place in the group's order, and cap_rows; groups without a cap are uncapped."""
    pos = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return rows.withColumn("pos", pos).join(caps.select(group, "cap_rows"), group, "left")


def buffered_cap(cap: Column) -> Column:
    """Rows to fetch for a cap: twice, but at most 50 more; null stays null."""
    return F.when(cap.isNotNull(), F.least(cap * 2, cap + 50))


def proportional_sample(rows: DataFrame, cap: int, group: str, key: str, seed: str) -> DataFrame:
    """Rows of a proportional sample without a floor; shortfall goes to the largest remainders."""
    counts = rows.groupBy(group).agg(F.count("*").alias("cnt"))
    every = Window.partitionBy(F.lit(0))
    total = F.sum("cnt").over(every)
    q = counts.withColumn("_total", total).withColumn("_cap", F.least(F.lit(cap).cast("long"), F.col("_total")))
    q = q.withColumn("_quota", F.expr("(_cap * cnt) div _total")).withColumn("_rest", F.expr("(_cap * cnt) % _total"))
    q = q.withColumn("_short", F.col("_cap") - F.sum("_quota").over(every)).withColumn("_rank", F.row_number().over(every.orderBy(F.desc("_rest"), group)))
    q = q.select(group, (F.col("_quota") + (F.col("_rank") <= F.col("_short")).cast("long")).alias("_take"))
    # No group gives more than the cap, which Spark applies on both sides of the shuffle; with it no task ranks a whole group.
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, key), key))
    return rows.withColumn("_rn", rank).filter(F.col("_rn") <= cap).join(q, group).filter("_rn <= _take").drop("_rn", "_take")


def two_level_cap(rows: DataFrame, group: str, per_group: int, total: int, key: str, seed: str) -> DataFrame:
    """At most per_group drawn rows of each group, then at most total of those."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, key), key))
    kept = rows.withColumn("_rn", rank).filter(F.col("_rn") <= per_group).drop("_rn")
    return kept.orderBy(draw(seed + "t", key), key).limit(total)


def seeded_sample(rows: DataFrame, n: int, keys: Sequence[str], seed: str) -> DataFrame:
    """n rows by seeded draw (a bounded top-k)."""
    return rows.orderBy(draw(seed, *keys), *keys).limit(n)


def stratified_split(rows: DataFrame, strata: Sequence[str], key: str, seed: str) -> DataFrame:
    """rows with split: train, val or test, 80/10/10 within each stratum by seeded order.

    The draw's first three digits part a stratum in 4096 ranges. Counts of ranges
    tell where the borders lie, so rows are ranked within a range only, and a large
    stratum is ranked by many tasks.
    """
    df = rows.withColumn("_d", draw(seed, key)).withColumn("_r", F.substring("_d", 1, 3))
    same = lambda a, b, names: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    ranges = df.groupBy(*strata, "_r").agg(F.count("*").alias("_k"))
    stratum = Window.partitionBy(*strata)
    ranges = ranges.withColumn("_n", F.sum("_k").over(stratum)).withColumn("_before", F.sum("_k").over(stratum.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k"))
    df = df.alias("x").join(ranges.alias("y"), same("x", "y", [*strata, "_r"])).select("x.*", "y._n", "y._before")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_d", key))
    split = F.when(place * 10 <= F.col("_n") * 8, "train").when(place * 10 <= F.col("_n") * 9, "val").otherwise("test")
    return df.withColumn("split", split).drop("_d", "_r", "_n", "_before")


def refill(surplus: DataFrame, taken: DataFrame, shortfall: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first shortfall rows of surplus that are not taken yet; none if nothing is short."""
    return surplus.join(taken.select(*keys).distinct(), list(keys), "left_anti").orderBy(*order).limit(max(0, shortfall))
