"""Column helpers: rounding that both engines share, and repeatable random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, never -0.0."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale + 0.0


def uniform(seed: int, axis: int, index: Column) -> Column:
    """A number in [0, 1) from (seed, axis, index) by integer arithmetic, the same on any partitioning."""
    a = F.pmod(index.cast("long") * 1103515245 + seed * 12345 + axis * 2654435, F.lit(2147483648))
    b = F.pmod(a * 1103515245 + 12345, F.lit(2147483648))
    c = F.pmod(b * 214013 + 2531011, F.lit(2147483648))
    return c / 2147483648.0
