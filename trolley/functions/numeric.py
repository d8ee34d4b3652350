"""Numeric helpers."""

from pyspark.sql import Column, functions as F


def round_even(c, digits: int) -> Column:
    """Half-to-even rounding as ``rint(x * 10^d) / 10^d`` (Spark's ``round`` is half-up)."""
    scale = float(10 ** digits)
    return F.rint(F.col(c) * scale if isinstance(c, str) else c * scale) / scale
