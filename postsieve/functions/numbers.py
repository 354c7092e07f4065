"""Clamping and rounding with the rounding rule of the scored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rescale(value: Column, floor: float, ceil: float) -> Column:
    """Map [floor, ceil] to [0, 1] and clamp; an empty range only clamps."""
    if ceil <= floor:
        return clamp(value, 0.0, 1.0)
    return clamp((value - F.lit(floor)) / F.lit(ceil - floor), 0.0, 1.0)


def round_tenth(value: Column) -> Column:
    """Round a non-negative double to one decimal by its exact binary value.

    Built-in rounding looks at the shortest decimal text, so 0.35 (a little
    below the tie in binary) would go up.  20 * value is an odd integer at a
    tie; the part lost by that product tells on which side the value lies, and
    an exact tie goes to the even digit.
    """
    a, b = value * F.lit(16.0), value * F.lit(4.0)
    total = a + b
    shadow = total - a
    lost = (a - (total - shadow)) + (b - shadow)
    tenths = F.floor(total / F.lit(2.0))
    is_tie = (total == F.floor(total)) & (total % F.lit(2.0) == F.lit(1.0))
    up = (lost > 0) | ((lost == 0) & (tenths % 2 == 1))
    tie_value = F.when(up, tenths + 1).otherwise(tenths).cast("double") / F.lit(10.0)
    return F.when(is_tie, tie_value).otherwise(F.round(value, 1))


def whole_text(value: Column) -> Column:
    """A double as text without decimals, halves to the even neighbour."""
    return F.bround(value, 0).cast("bigint").cast("string")
