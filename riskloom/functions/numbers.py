"""Rounding and ratio helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value: float | Column) -> Column:
    """A single-precision literal or column."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def round1_f32(c: Column) -> Column:
    """Single-precision value rounded half away from zero to one decimal."""
    return (F.round(c * f32(10.0)) / f32(10.0)).cast("float")


def round_exact(c: Column, digits: int, ties: str = "even") -> Column:
    """Round a non-negative double by its exact binary value, as C and JavaScript print it.

    ``round`` decides ties on the shortest decimal text of the number, so 98.35 (stored a little
    below) would go up. Splitting the number into a 24-bit head and a tail keeps both products
    with 10^digits exact, so the comparison with one half is exact as well.
    """
    scale = float(10 ** digits)
    head = c.cast("float").cast("double")
    floor = F.floor(c * scale).cast("double")
    rest = ((head * scale - floor) - 0.5) + (c - head) * scale
    up = (rest > 0) | ((rest == 0) & (F.lit(ties == "up") | (floor % 2 == 1)))
    return F.when(up, floor + 1).otherwise(floor) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent, one decimal; 0 -> 0 is 0 and 0 -> x is NULL."""
    cur, prev = current.cast("double"), previous.cast("double")
    return (
        F.when((F.coalesce(prev, F.lit(0.0)) <= 0) & (F.coalesce(cur, F.lit(0.0)) <= 0), F.lit(0.0))
        .when(F.coalesce(prev, F.lit(0.0)) <= 0, F.lit(None).cast("double"))
        .otherwise(F.round((cur - prev) / prev * 1000) / 10)
    )
