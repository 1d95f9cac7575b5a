"""Angles in [-pi, pi)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column) -> Column:
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def difference(a: Column, b: Column) -> Column:
    """Absolute difference of two directions."""
    return F.abs(wrap(a - b))


def mean_of_two(a: Column, b: Column) -> Column:
    """Circular mean; the first where the two cancel."""
    y, x = F.sin(a) + F.sin(b), F.cos(a) + F.cos(b)
    return F.when(F.hypot(x, y) <= 1e-12, wrap(a)).otherwise(wrap(F.atan2(y, x)))


def finite(value: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
