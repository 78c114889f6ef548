"""Connected components and ordered independent sets of link tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.scratch import remove, written

#: Links that one task settles in memory at most.
SOLVE = 1_000_000


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: least reachable node, for every node of links (a, b long); alternating large-star and small-star steps.

    RuntimeError where that many rounds do not settle it (they need about the
    logarithm of the longest chain). A node of very many links is met by partial
    aggregation first, then in a join whose sides are shuffled for it alone, so that
    Spark can split its share.
    """
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-links")

    def measured() -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself do."""
        around = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # By a key of its own: on the aggregate's, Spark would join where it aggregates and could not split a node.
        moved = around.join(least.select((F.col("u") + 0).alias("w"), "m"), F.col("u") == F.col("w"))
        if large:
            moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    before = measured()
    for _ in range(rounds):
        old = path
        edges, path = written(star(star(edges, True), False), "cc-round")
        remove(spark, old)
        now = measured()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def _settled_pairs(rows: pa.Table) -> pa.Table:
    """The nodes that an earlier kept one drops, in the order of the nodes."""
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    order = np.lexsort((a, b))
    out: set[int] = set()
    for x, y in zip(a[order].tolist(), b[order].tolist()):  # all links into a node stand together, and earlier nodes are settled
        if x not in out:
            out.add(y)
    return pa.table({"k": pa.array(sorted(out), pa.int64())})


def _settled_groups(rows: pa.Table) -> pa.Table:
    """The nodes one of whose groups has an earlier kept node."""
    a, g = rows["a"].to_numpy(), rows["g"].to_numpy()
    order = np.argsort(a, kind="stable")
    a, g = a[order], g[order]
    taken: set[int] = set()
    out = []
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mine = g[lo:hi].tolist()
        if taken.isdisjoint(mine):
            taken.update(mine)
        else:
            out.append(int(a[lo]))
    return pa.table({"k": pa.array(out, pa.int64())})


def _peeled_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without an earlier neighbour are kept: the nodes that they drop, and the links that are left."""
    heads = rows.select("a").distinct().join(rows.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    out = written(rows.join(heads, "a", "left_semi").select(F.col("b").alias("k")).distinct(), "settle-out")[0]
    return out, rows.join(out.withColumnRenamed("k", "a"), "a", "left_anti").join(out.withColumnRenamed("k", "b"), "b", "left_anti")


def _peeled_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are first in all of their groups are kept: the nodes that they drop, and the memberships that are left."""
    first = rows.groupBy("g").agg(F.min("a").alias("first"))
    heads = rows.join(first, "g").groupBy("a").agg(F.bool_and(F.col("a") == F.col("first")).alias("kept")).filter("kept").select("a")
    taken = rows.join(heads, "a", "left_semi").select("g")
    out = written(rows.join(taken, "g", "left_semi").select("a").distinct().join(heads, "a", "left_anti").select(F.col("a").alias("k")), "settle-out")[0]
    return out, rows.join(out.withColumnRenamed("k", "a"), "a", "left_anti").join(taken.distinct(), "g", "left_anti")


def _dropped(rows: DataFrame, links: Callable, settle: Callable, peel: Callable) -> DataFrame:
    """k: what settle drops of rows (node in column a).

    Rows that fit one task are settled there. Of more, each connected component
    that fits is settled in a task of its own; one that does not is peeled until
    its pieces fit. A round peels what has no undecided earlier neighbour, so a
    single chain of more than SOLVE links would take very many of them.
    """
    spark = rows.sparkSession
    rows, path = written(rows, "settle-rows")
    found = [rows.filter(F.lit(False)).select(F.col("a").alias("k"))]
    while n := rows.count():
        if n <= SOLVE:
            found.append(rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: settle(t), "k long"))
            break
        roots = written(components(links(rows)), "settle-roots")[0]
        rooted = written(rows.join(roots, F.col("a") == F.col("node")).drop("node"), "settle-rooted")[0]
        large = written(rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > SOLVE).select("root"), "settle-large")[0]
        small = rooted.join(large, "root", "left_anti")
        found.append(written(small.groupBy("root").applyInArrow(lambda t: settle(t), "k long"), "settle-small")[0])
        out, rest = peel(rooted.join(large, "root", "left_semi").drop("root"))
        found.append(out)
        old = path
        rows, path = written(rest, "settle-rows")
        remove(spark, old)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def dropped_by_earlier(pairs: DataFrame) -> DataFrame:
    """k: the nodes that the sequential loop drops, which keeps a node if no earlier kept one is linked to it; pairs has a < b (long)."""
    links = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    return _dropped(links, lambda rows: rows.select("a", "b"), _settled_pairs, _peeled_pairs)


def dropped_in_groups(members: DataFrame) -> DataFrame:
    """k: as dropped_by_earlier, where all members of a group g are linked to one another; members has a and g (long).

    Work grows with the members, not with their pairs.
    """

    def links(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("g").agg(F.min("a").alias("b")), "g").select("a", "b")

    return _dropped(members.select("a", "g").distinct(), links, _settled_groups, _peeled_groups)
