"""Repository discovery over a table of repositories: predicates, ranked limits, date windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1000


def qualify(repos: DataFrame, start: date, end: date, min_stars: float, language: str | None = None) -> DataFrame:
    """Search predicates; plain comparisons, so that they reach the scan."""
    out = repos.filter((F.col("created") >= F.lit(start)) & (F.col("created") < F.lit(end + timedelta(days=1))) & (F.col("stars") >= min_stars))
    return out.filter(F.col("language") == language.lower()) if language else out


def enough_contributors(contributors: Column, least: int) -> Column:
    """Unknown passes."""
    return contributors.isNull() | (contributors >= least)


def is_bot(login: Column, kind: Column) -> Column:
    return F.coalesce(F.lower(login).endswith("[bot]"), F.lit(False)) | F.coalesce(kind == "Bot", F.lit(False))


def top(repos: DataFrame, k: int, *, least_contributors: int | None = None, scanned: int | None = LIMIT) -> DataFrame:
    """The first k by stars, then name; with scanned, only that many are looked at before the contributor test."""
    if k < 0:
        raise ValueError("k must not be negative")
    order = [F.desc("stars"), F.asc("full_name")]
    if scanned is not None:
        repos = repos.orderBy(*order).limit(scanned)
    if least_contributors is not None:
        repos = repos.filter(enough_contributors(F.col("contributors"), least_contributors))
    return repos.orderBy(*order).limit(k)


def split_windows(daily: Sequence[tuple[date, int]], start: date, end: date, limit: int = LIMIT) -> list[tuple[date, date, int, bool]]:
    """(start, end, rows, truncated), oldest first, over a histogram of days: halved until a window fits the limit or is a day."""
    days = (end - start).days + 1
    running = [0] * (days + 1)
    for d, n in daily:
        if start <= d <= end:
            running[(d - start).days + 1] += n
    for i in range(days):
        running[i + 1] += running[i]
    out, todo = [], [(0, days - 1)]
    while todo:
        lo, hi = todo.pop()
        n = running[hi + 1] - running[lo]
        if n and (n <= limit or lo == hi):
            out.append((start + timedelta(lo), start + timedelta(hi), n, n > limit))
        elif n:
            middle = lo + (hi - lo) // 2
            todo += [(middle + 1, hi), (lo, middle)]
    return out


def windows(repos: DataFrame, start: date, end: date, limit: int = LIMIT) -> DataFrame:
    """Date windows of at most limit rows each; the histogram has one row a day, so it is small."""
    daily = qualify(repos, start, end, float("-inf")).groupBy(F.to_date("created").alias("d")).count().orderBy("d").collect()
    found = split_windows([(r["d"], r["count"]) for r in daily], start, end, limit)
    return repos.sparkSession.createDataFrame(found, "window_start date, window_end date, n_rows long, truncated boolean")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the greatest order value."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
