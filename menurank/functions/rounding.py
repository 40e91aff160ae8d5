"""Rounding by a double's exact binary value, halves to even. Spark's own rounds work on its decimal rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(x: Column, parts: list[int]) -> Column:
    """floor-like number of units of 1/m nearest x (m is half of sum(parts), powers of two in falling order).

    2*m*x is held as a sum s and what rounding s lost, e; x lies between k and k+1 units, the middle at s = 2k+1."""
    s, e = parts[0] * x, F.lit(0.0)
    for p in parts[1:]:
        t = s + p * x
        e = e + (p * x - (t - s))
        s = t
    k = F.floor(s / 2).cast("double")
    k = F.when((s == 2 * k) & (e < 0), k - 1).otherwise(k)
    middle = 2 * k + 1
    odd = (k % 2) != 0
    up = (s > middle) | ((s == middle) & ((e > 0) | ((e == 0) & odd)))
    return F.when(up, k + 1).otherwise(k)


def round1(x: Column) -> Column:
    """To one digit."""
    return _units(x, [16, 4]) / 10


def fixed2(x: Column) -> Column:
    """As text with two digits; for x >= 0."""
    n = _units(x, [128, 64, 8]).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
