"""Null-safe number helpers. NaN never enters a window: it becomes null here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """Numeric ``x`` as double, with NaN and both infinities turned into null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def to_number(x: Column) -> Column:
    """Text or number to a finite double; anything unreadable is null."""
    return finite(x.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(now: Column, before: Column) -> Column:
    """Fractional change; null when there is no base to compare with."""
    return ratio(now, before) - F.lit(1.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (greatest/least skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def half_up(x: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def half_up_at(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return half_up(x * F.lit(scale)) / F.lit(scale)


# The score band every served score is mapped to.
SCORE_LOW, SCORE_SPAN, SCORE_TOP, SCORE_FLAT = 70.0, 29.0, 99.0, 85


def band_score(x: Column, low: Column, high: Column, halves: str) -> Column:
    """Min-max scale into the score band; a flat range scores SCORE_FLAT.

    ``halves`` is "even" or "up" -- the batch job and the serving side round
    differently and both behaviours are kept.
    """
    scaled = F.lit(SCORE_LOW) + ratio(x - low, high - low) * F.lit(SCORE_SPAN)
    limited = clamp(scaled, 0.0, SCORE_TOP)
    rounded = F.rint(limited) if halves == "even" else half_up(limited)
    flat = low.isNull() | high.isNull() | (high <= low)
    return F.when(x.isNull(), None).otherwise(
        F.when(flat, F.lit(SCORE_FLAT)).otherwise(rounded)
    ).cast("int")


def row_std(columns: list[Column]) -> Column:
    """Population standard deviation across columns of one row (two-pass)."""
    n = F.lit(float(len(columns)))
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    mean = total / n
    squares = (columns[0] - mean) * (columns[0] - mean)
    for c in columns[1:]:
        squares = squares + (c - mean) * (c - mean)
    return F.sqrt(squares / n)


def decimal4(x: Column) -> Column:
    """Any value to DECIMAL(18,4), halves away from zero, unreadable -> null."""
    wide = finite(x).try_cast("decimal(28,10)")
    return F.round(wide, 4).try_cast("decimal(18,4)")
