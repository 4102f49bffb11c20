"""Per-date operators: market context and z-scores.

Both reduce the bars to one row per date with map-side aggregation. That table,
as long as the trading calendar, is written before it is joined back, so Spark
knows its size when it chooses to broadcast it; then a date holding a large
share of all rows costs nothing extra, and the bars are not shuffled by date.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import staged


def date_stats(df: DataFrame, z_columns: list[str] = ()) -> DataFrame:
    """One row per date: market mean return, breadth, k-day index returns, and mean/std of z_columns.

    The index return over k dates is the product of the k daily gross means
    minus one, null for the first k dates. Dates without any return keep
    their z statistics and have null market columns.
    """
    rising = F.when(F.col("ret_1d") > 0, F.lit(1.0)).when(F.col("ret_1d").isNotNull(), F.lit(0.0))
    days = df.groupBy("date").agg(
        F.avg("ret_1d").alias("market_ret_1d"),
        F.avg(rising).alias("breadth_up_ratio"),
        F.nullif(F.count("ret_1d"), F.lit(0)).alias("breadth_count"),
        *[F.avg(c).alias(f"_m_{c}") for c in z_columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in z_columns],
    )
    # a window over the calendar: one row per date
    known = F.col("breadth_count").isNotNull()
    calendar = Window.partitionBy(known).orderBy("date")
    gross = F.lit(1.0) + F.col("market_ret_1d")

    def index_return(k: int):
        product = F.product(gross).over(calendar.rowsBetween(-(k - 1), 0))
        return F.when(known & (F.row_number().over(calendar) > k), product - F.lit(1.0))

    return days.select(
        "*", index_return(5).alias("market_ret_5d"), index_return(20).alias("market_ret_20d")
    )


MARKET_COLUMNS = ["market_ret_1d", "breadth_up_ratio", "breadth_count", "market_ret_5d", "market_ret_20d"]


def market_days(df: DataFrame) -> DataFrame:
    return date_stats(df.select("date", "ret_1d")).where(F.col("breadth_count").isNotNull())


def add_date_context(df: DataFrame, z_columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Market context, relative strength, the risk-on flag and z_<column> for each z column.

    A z-score with a zero or missing standard deviation is null. The dates'
    statistics come from ``source``, the same rows with fewer columns, if given.
    """
    out = df.join(staged(date_stats(df if source is None else source, z_columns)), "date", "left")
    risk_on = (F.col("market_ret_20d") > 0.0) & (F.col("breadth_up_ratio") >= 0.5)
    scores = [
        F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"z_{c}") for c in z_columns
    ]
    return out.select(
        *df.columns,
        *MARKET_COLUMNS,
        (F.col("ret_5d") - F.col("market_ret_5d")).alias("rel_strength_5d"),
        (F.col("ret_20d") - F.col("market_ret_20d")).alias("rel_strength_20d"),
        F.coalesce(risk_on, F.lit(False)).cast("int").alias("risk_on_regime"),
        *scores,
    )


def weighted_sum(weights: dict[str, float]):
    """Linear score; a missing part counts as zero."""
    terms = [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()]
    return functools.reduce(lambda a, b: a + b, terms)
