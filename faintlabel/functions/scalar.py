"""Numeric column expressions: stable logistic functions, weighted sums, entropy terms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(margin: Column) -> Column:
    """Logistic function, branched on the sign so that exp never overflows."""
    return F.when(margin >= 0, 1.0 / (1.0 + F.exp(-margin))).otherwise(F.exp(margin) / (1.0 + F.exp(margin)))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def weighted_sum(columns: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    """bias + sum of column * weight as one flat expression, so it stays inside whole-stage codegen."""
    terms = [c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(bias)))


def divide(a: Column, b: Column) -> Column:
    """a / b as double; NaN where b is 0 (an undefined rate)."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(float("nan")))


def xlog2x(n: Column) -> Column:
    """n * log2(n) with the value 0 at 0: the building block of all entropy sums."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
