"""Binary evaluation of scores, in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evaluate(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """n, accuracy, precision, recall, f1, auroc and log loss; a zero denominator gives 0.

    The rank sum uses a histogram of distinct scores, so no window sorts single rows.
    """
    y, s = F.col(label) == 1, F.col(score)
    hist = rows.groupBy(*by, s.alias("_s")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_q"))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    auc = hist.withColumn("_b", F.coalesce(F.sum("_q").over(below), F.lit(0))).groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_b") + F.col("_q") / 2)).alias("_u"))
    hit = s >= threshold
    clipped = F.greatest(F.lit(1e-12), F.least(s, F.lit(1 - 1e-12)))
    cells = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & hit).alias("_tp"), F.count_if(~y & hit).alias("_fp"), F.count_if(y & ~hit).alias("_fn"), F.count_if(y).alias("_pos"), F.avg(F.when(y, -F.log(clipped)).otherwise(-F.log(1 - clipped))).alias("loss"))
    out = cells.join(auc, list(by)) if by else cells.join(F.broadcast(auc))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return out.select(*by, "n", safe(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(F.col("_u"), F.col("_pos") * (F.col("n") - F.col("_pos"))).alias("auroc"), "loss")


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """Counts of both classes and the weight of the positive one."""
    out = rows.agg(F.count_if(F.col(label) == 0).alias("n_human"), F.count_if(F.col(label) == 1).alias("n_ai"))
    return out.withColumn("pos_weight", F.try_divide(F.col("n_human").cast("double"), F.col("n_ai").cast("double")))
