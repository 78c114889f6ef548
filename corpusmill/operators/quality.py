"""The filter for engineered repositories: licence, hard limits, population quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMAS = 2.17
UNUSABLE = ("NOASSERTION", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "OFL-1.1")


def licence_passes(licence: Column, unusable: Sequence[str] = UNUSABLE) -> Column:
    return F.coalesce(~licence.isin(*unusable), F.lit(False))


def hard_limits_pass(contributors: Column, releases: Column) -> Column:
    return ~F.coalesce(contributors < 2, F.lit(False)) & F.coalesce(releases > 0, F.lit(False))


def apply_filters(metrics: DataFrame, unusable: Sequence[str] = UNUSABLE) -> DataFrame:
    """metrics with passes_stage1..3 and passes_all; stage 3 compares with the quartiles of rows that pass the others."""
    df = metrics.withColumn("passes_stage1", licence_passes(F.col("license_spdx"), unusable)).withColumn("passes_stage2", hard_limits_pass(F.col("contributor_count"), F.col("release_count")))
    pool = df.filter("passes_stage1 AND passes_stage2")
    ratio = F.when(F.col("code_ratio") > 0, F.col("code_ratio"))
    limits = pool.agg(F.percentile("pull_request_count", 0.25).alias("_pr"), F.percentile("issue_count", 0.25).alias("_is"), F.percentile("loc", 0.25).alias("_loc"), F.avg(ratio).alias("_m"), F.stddev_pop(ratio).alias("_s"), F.count(ratio).alias("_n"))
    df = df.join(F.broadcast(limits))  # one row
    low, high = F.when(F.col("_n") >= 2, F.col("_m") - SIGMAS * F.col("_s")).otherwise(0.0), F.when(F.col("_n") >= 2, F.col("_m") + SIGMAS * F.col("_s")).otherwise(1.0)
    fits = (F.col("code_ratio") <= 0) | F.col("code_ratio").between(low, high)
    three = F.col("passes_stage1") & F.col("passes_stage2") & ~((F.col("pull_request_count") < F.col("_pr")) | (F.col("issue_count") < F.col("_is")) | (F.col("loc") < F.col("_loc"))) & fits
    df = df.withColumn("passes_stage3", F.coalesce(three, F.lit(False))).drop("_pr", "_is", "_loc", "_m", "_s", "_n")
    return df.withColumn("passes_all", F.col("passes_stage1") & F.col("passes_stage2") & F.col("passes_stage3"))


def code_ratio(loc: Column, comments: Column) -> Column:
    return F.coalesce(F.try_divide(loc.cast("double"), (loc + comments).cast("double")), F.lit(0.0))
