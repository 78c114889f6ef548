"""Formulas over counted operators, operands and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halstead(h1: Column, h2: Column, n1: Column, n2: Column) -> dict[str, Column]:
    """The derived measures, unrounded."""
    h1, h2, n1, n2 = (c.cast("double") for c in (h1, h2, n1, n2))
    term = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    vocabulary, length = h1 + h2, n1 + n2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(0.0)
    difficulty = F.when(h2 > 0, h1 / 2 * n2 / h2).otherwise(0.0)
    effort = difficulty * volume
    return {"vocabulary": vocabulary, "halstead_length": length, "calculated_length": term(h1) + term(h2), "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18, "bugs": volume / 3000}


def maintainability(volume: Column, complexity: Column, sloc: Column, comment_ratio: Column) -> Column:
    """At least 0, not capped above; 100 where there is no code."""
    mi = 171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(sloc) + 50 * F.sin(F.sqrt(2.4 * comment_ratio))
    return F.when((sloc <= 0) | (volume <= 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), mi * 100 / 171))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
