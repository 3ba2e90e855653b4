"""Scalar expressions over node tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centrality(n: Column, farness: Column) -> Column:
    """n / farness; null where the farness is 0 (a single node)."""
    return F.when(farness != 0, n / farness)


def stretched(value: Column, stretch: float) -> Column:
    """The value times `stretch`, or as it is where that is 0."""
    return value * stretch if stretch else value


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero: sums over shuffles differ in their last bits."""
    return F.round(value, digits) + F.lit(0.0)
