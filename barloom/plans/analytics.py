"""Reports over the bar table, and the registry of named reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, ratio
from barloom.operators.recursive import ewm_columns
from barloom.operators.indicators import rsi_null_seed, rsi_unguarded
from barloom.operators.series import latest_per_ticker, slice_half_open, slice_inclusive, trailing_window


def high_low_52_week(bars: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Highest high and lowest low of each ticker's last 365 days, by ticker."""
    return (
        trailing_window(bars, 365, as_of)
        .groupBy("ticker")
        .agg(F.max("high").alias("high_52w"), F.min("low").alias("low_52w"))
        .orderBy("ticker")
    )


def close_vs_52w_range(bars: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Where the last close sits in the 52-week range, highest first.

    The last close is a max_by in the same aggregation as the range, so the
    join of "latest" and "ranges" on ticker needs no second pass.
    """
    grouped = (
        trailing_window(bars, 365, as_of)
        .groupBy("ticker")
        .agg(
            F.max_by("close", "date").alias("last_close"),
            F.max("high").alias("high_52w"),
            F.min("low").alias("low_52w"),
        )
    )
    position = ratio(F.col("last_close") - F.col("low_52w"), F.col("high_52w") - F.col("low_52w"))
    return grouped.withColumn("pct_in_range", position).orderBy(
        F.col("pct_in_range").desc_nulls_last(), "ticker"
    )


def cross_section_momentum(bars: DataFrame, k: int = 20, out: str = "ret_1m") -> DataFrame:
    """Each ticker's newest known k-row return, highest first."""
    f = Frames()
    momentum = change(F.col("close"), f.lag("close", k))
    known = f.select(bars, "ticker", "date", momentum.alias(out)).where(F.col(out).isNotNull())
    return latest_per_ticker(known).orderBy(F.col(out).desc_nulls_last(), "ticker")


def with_indicators(
    bars: DataFrame, ticker: str, start: str, end: str, flavour: str = "recursive"
) -> DataFrame:
    """One ticker's slice with RSI(14) and MACD(12, 26, 9).

    flavour="recursive": EMA started from the first value, RSI null-seeded
    with the zero-loss guard. flavour="adjusted": weights normalised over the
    rows seen so far, RSI zero-seeded without the guard.
    """
    adjust = {"recursive": False, "adjusted": True}[flavour]
    picked = slice_half_open(bars, ticker, start, end)
    rsi = rsi_unguarded if adjust else rsi_null_seed
    f = Frames()
    out = f.select(picked, "*", rsi(f, F.col("close"), 14).alias("rsi_14"))
    return ewm_columns(out, adjust=adjust).orderBy("date")


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "ohlcv_slice": slice_inclusive,
    "get_prices": slice_half_open,
    "high_low_52_week": high_low_52_week,
    "close_vs_52w_range": close_vs_52w_range,
    "cross_section_momentum": cross_section_momentum,
    "with_indicators": with_indicators,
}


def report(name: str, bars: DataFrame, **params) -> DataFrame:
    """Run a report by name; an unknown name lists the known ones."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; known: {', '.join(sorted(REPORTS))}")
    return REPORTS[name](bars, **params)


def register_market_data(bars: DataFrame, name: str = "market_data") -> None:
    """Expose the bar table to spark.sql under one reusable name."""
    bars.createOrReplaceTempView(name)
