"""Rounding and safe ratios (FN-32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even, as banker's rounding; whole numbers come back as int."""
    rounded = F.bround(c, digits)
    return rounded.cast("int") if digits == 0 else rounded


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 where there is nothing to compare."""
    return F.when(whole == 0, F.lit(0)).otherwise(half_even(F.lit(100.0) * part / whole))
