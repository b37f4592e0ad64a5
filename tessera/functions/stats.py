"""Interval estimates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: normal quantile of a two-sided 95 % interval.
Z = 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval of a rate; (0, 1) where n is 0."""
    p, n = F.try_divide(hits.cast("double"), n.cast("double")), n.cast("double")
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    return low, F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def normal_interval(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Normal approximation of a pass rate's interval, clipped to 0 and 1."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    half = z * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)
