"""Interval estimates and rates as column expressions. NULL stands for missing throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, in which Spark's aggregates skip them."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; `empty` (NULL by default) where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def deception_rate(num_truthful: Column, num_valid: Column) -> Column:
    """1 - truthful / valid, and 0.5 where nothing is valid."""
    return F.when(num_valid > 0, 1.0 - num_truthful / num_valid).otherwise(F.lit(0.5))


def wilson(k: Column, n: Column, z: float = Z95, clamp: bool = True, empty: float | None = None) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval for k of n; `empty` at both ends where n <= 0."""
    n_, p = n.cast("double"), k / n
    middle = (p + z * z / (2 * n_)) / (1 + z * z / n_)
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / (1 + z * z / n_)
    low, high = middle - half, middle + half
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    out = [F.when(n > 0, x).otherwise(F.lit(empty).cast("double")) for x in (low, high)]
    return out[0], out[1]


def complement_wilson(num_truthful: Column, num_valid: Column, z: float = Z95) -> tuple[Column, Column]:
    """The interval of 1 - truthful / valid: the ends of the truthful rate's, swapped."""
    low, high = wilson(num_truthful, num_valid, z)
    return 1 - high, 1 - low


def mean_ci(x: Column, z: float = Z95) -> tuple[Column, Column, Column, Column]:
    """Aggregates n, mean, low, high: sample deviation, normal interval; degenerate at n = 1."""
    v = finite(x)
    n, mean = F.count(v), F.avg(v)
    half = F.when(n > 1, z * F.stddev_samp(v) / F.sqrt(n.cast("double"))).otherwise(F.when(n == 1, F.lit(0.0)))
    return n, mean, mean - half, mean + half


def bounded_change(current: Column, reference: Column, eps: float = 1e-6) -> Column:
    """(c - r) / (|c| + |r| + eps), kept within -1 and 1."""
    raw = (current - reference) / (F.abs(current) + F.abs(reference) + eps)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def percent_reduction(delta: Column) -> Column:
    return 100 * (1 - F.exp(-delta))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def bracket(rate_: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """An interval that holds its rate, all within 0 and 1."""
    return clamp01(rate_), clamp01(F.least(low, rate_)), clamp01(F.greatest(high, rate_))
