"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of the budget by weight; shares above a cap are
dealt again. A source repeats all its documents ``floor(target / size)`` times;
the rest of its target is a subset-sum problem over a histogram of exact
document lengths. The histogram is made with map-side aggregation, so its size
follows the number of distinct lengths, not of documents. Within a length,
documents are chosen by a seeded hash. A large group of equal length is ranked
in hash ranges of about RANGE rows each, so that no task ranks all of it.

Defined results: null text has size 0 and is never taken; null sources form one
source, ordered last; equal rows are documents of their own and split by a row
number only where their hash ties; an empty table gives no rows; extra columns
are dropped by ``plan`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.llm.common import fresh, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
RANGE = 1000
#: Budget left to the dynamic programme, in words; proportional filling comes first.
DP_BUDGET = 1 << 17


def word_count(text: Column) -> Column:
    """Words are runs of anything but space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: list[float], weights: list[float], budget: float, most: float) -> list[float]:
    """Water-filling: shares by weight, none above most times its size; what is cut goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest to the budget.

    Every length first gives the same fraction of a share of the budget, rounded
    down, so that the mix keeps the source's lengths. A bounded knapsack over
    reachable sums, held as bits of an integer, counts split into powers of two,
    then finds the nearest sum to what is left. Where that is not the budget
    itself, more is left to it, at last all of a budget of up to DP_BUDGET: then no
    subset is nearer.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    best, off = [], total
    for left in (0, min(budget, DP_BUDGET) // 8, min(budget, DP_BUDGET)):
        taken = _fit(lengths, counts, budget, [c * (budget - left) // total if n else 0 for n, c in zip(lengths, counts)])
        if (now := abs(budget - sum(n * t for n, t in zip(lengths, taken)))) < off:
            best, off = taken, now
        if not off:
            break
    return best


def _fit(lengths: list[int], counts: list[int], budget: int, taken: list[int]) -> list[int]:
    """taken, and the documents beside them whose words come nearest to the rest of the budget."""
    left = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])
    for i in order:  # what rounding down left over, long ones first
        k = min(counts[i] - taken[i], max(0, left - DP_BUDGET) // lengths[i])
        taken[i] += k
        left -= k * lengths[i]
    most = left + min(left, max(lengths))  # no sum beyond is nearer than none, or than one document less
    limit = (1 << (most + 1)) - 1
    items, reach, states = [], 1, [1]
    for i in sorted(order, key=lambda i: lengths[i]):
        spare, k = min(counts[i] - taken[i], most // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            k = min(k, spare)
            grown = (reach | reach << (lengths[i] * k)) & limit
            if grown != reach:
                items.append((i, k))
                states.append(grown)
                reach = grown
            spare -= k
            k *= 2
    below = (reach & ((2 << left) - 1)).bit_length() - 1
    above = reach >> left
    above = left + (above & -above).bit_length() - 1 if above else most + left + 1
    best = below if left - below <= above - left else above
    for (i, k), before in zip(reversed(items), reversed(states[:-1])):
        if not before >> best & 1:
            taken[i] += k
            best -= k * lengths[i]
    return taken


def _order(spark_rows: list) -> list:
    """Sources by code point, null last."""
    return sorted(spark_rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, key: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs, and its key where a column of unique keys is named."""
    spark = docs.sparkSession
    keys = [key] if key else []
    # Rows without an id are told apart by their keys.
    told = F.coalesce(F.col("doc_id").cast("long"), F.col(key)) if key else F.col("doc_id")
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), told, "source").alias("h"), *keys), "mix-sizes")
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n")).persist()
    # One row per source: bounded by the number of sources, which the caller names and weighs.
    per = _order(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect())
    sizes = [float(r["s"]) for r in per]
    targets = shared_targets(sizes, [weights[i % len(weights)] for i in range(len(per))], share * sum(sizes), most)
    table = spark.createDataFrame([(r["source"], int(r["s"]), float(t)) for r, t in zip(per, targets)], "source string, source_size long, target double")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        s, t = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(t // s) if s else 0
        extra = fit_budget(rows["size"].tolist(), rows["n"].tolist(), round(t - whole * s))
        out = rows[["source", "size", "source_size", "target", "n"]].copy()
        out["whole"], out["extra"] = whole, extra
        return out

    fitted = hist.join(F.broadcast(table), hist["source"].eqNullSafe(table["source"])).select(hist["source"], "size", "n", "source_size", "target").groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, n long, whole long, extra long")
    fitted = materialise(fitted.withColumn("ranges", F.ceil(F.col("n") / RANGE)), "mix-fit")
    hist.unpersist()
    a, b = sized.alias("a"), fitted.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.doc_id", "a.size", "a.source", "a.h", "b.source_size", "b.target", "b.whole", "b.extra", F.pmod(F.shiftrightunsigned("a.h", 20), F.col("b.ranges")).alias("r"), *keys)
    group = ["source", "size", "r"]
    runs = rows.groupBy(*group).agg(F.count("*").alias("in_range")).withColumn("before", F.sum("in_range").over(Window.partitionBy("source", "size").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))).na.fill({"before": 0})
    x, y = rows.alias("x"), runs.alias("y")
    rows = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.r") == F.col("y.r"))).select("x.*", "y.before")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id", *keys))
    more = (F.col("before") + rank <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("whole") + more)).alias("taken"), *keys)


def apply_mix(docs: DataFrame, planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with each row as often as the plan takes it; rows with one key (null is one) share one decision, the greatest."""
    (times,) = fresh(docs.columns, "mix_times")
    factor = planned.filter(F.col("taken") > 0).groupBy(key).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(times))
    kept = docs.alias("d").join(factor.alias("t"), F.col(f"d.{key}").eqNullSafe(F.col(f"t.{key}"))).select("d.*", F.col(f"t.{times}"))
    return kept.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
