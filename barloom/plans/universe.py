"""Choosing symbols: liquidity universe and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIQUIDITY_BARS = 252  # fixed value: one trading year


def liquidity(bars: DataFrame, inside: Column) -> DataFrame:
    """Per ticker: bar count and mean traded value of the last year, over all bars and over those that are ``inside``."""
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bars.select(
        "ticker",
        (F.col("close") * F.col("volume")).alias("value"),
        inside.alias("inside"),
        F.row_number().over(newest).alias("n"),
        F.count_if(inside).over(so_far).alias("n_inside"),
    )
    return ranked.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg(F.when(F.col("n") <= LIQUIDITY_BARS, F.col("value"))).alias("liquidity"),
        F.count_if("inside").alias("bars_inside"),
        F.avg(F.when(F.col("inside") & (F.col("n_inside") <= LIQUIDITY_BARS), F.col("value"))).alias("liquidity_inside"),
    )


def universe_by_liquidity(
    bars: DataFrame,
    max_symbols: int,
    *,
    min_bars: int = 400,
    start: str | None = None,
    end: str | None = None,
    allow_fallback: bool = True,
) -> DataFrame:
    """The ``max_symbols`` most liquid tickers with at least ``min_bars`` bars in the range.

    If the range leaves nobody, the whole history is used instead (when
    allowed). One plan does both: a subquery tells whether anybody is left.
    """
    inside = F.col("date").isNotNull()
    if start is not None:
        inside = inside & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("date") <= F.lit(end).cast("date"))
    rated = liquidity(bars, inside)
    anybody = F.lit(True)
    if allow_fallback and (start or end):
        anybody = F.coalesce(rated.agg(F.max(F.col("bars_inside") >= min_bars)).scalar(), F.lit(False))
    chosen = rated.select(
        "ticker",
        F.when(anybody, F.col("bars_inside")).otherwise(F.col("bars")).alias("bars"),
        F.when(anybody, F.col("liquidity_inside")).otherwise(F.col("liquidity")).alias("liquidity"),
    )
    kept = chosen.where(F.col("bars") >= min_bars)
    return kept.orderBy(F.col("liquidity").desc_nulls_last(), "ticker").limit(max_symbols)


def seeded_sample(symbols: DataFrame, n: int, seed: int, column: str = "ticker") -> DataFrame:
    """n symbols chosen by a seeded hash: the same seed gives the same symbols on any cluster."""
    return symbols.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column).limit(n)
