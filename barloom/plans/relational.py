"""Feature sets of the relational price table and of the market data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, decimal4
from barloom.operators.indicators import rsi_zero_seed, sma_set
from barloom.schema import DERIVED_COLUMNS, PRICE_COLUMNS


def relational_features(bars: DataFrame) -> DataFrame:
    """Daily return in percent, RSI(14) and three moving averages of adj_close, as doubles."""
    f, x = Frames(), F.col("adj_close")
    return f.select(
        bars,
        F.col("ticker").alias("symbol"),
        F.to_date("date").alias("trade_date"),
        *PRICE_COLUMNS,
        F.coalesce(F.col("volume"), F.lit(0)).cast("long").alias("volume"),
        (change(x, f.lag(x)) * F.lit(100.0)).alias("daily_return"),
        rsi_zero_seed(f, x, 14).alias("rsi_14"),
        *[c.alias(name) for name, c in sma_set(f, x, (20, 60, 120)).items()],
    )


def to_price_rows(features: DataFrame) -> DataFrame:
    """Decimal(18,4) rows of the price table; rows with an unreadable price are dropped."""
    numbers = PRICE_COLUMNS + DERIVED_COLUMNS
    rows = features.select(
        "symbol",
        "trade_date",
        *[decimal4(F.col(c)).alias(c) for c in PRICE_COLUMNS],
        F.coalesce(F.col("volume"), F.lit(0)).cast("long").alias("volume"),
        *[decimal4(F.col(c)).alias(c) for c in numbers if c not in PRICE_COLUMNS],
    )
    return rows.dropna(subset=["symbol", "trade_date", *PRICE_COLUMNS])


def market_features(bars: DataFrame) -> DataFrame:
    """Trading value, 1-day return, moving averages and 20-day volatility of the return."""
    f, x = Frames(), F.col("close")
    ret = change(x, f.lag(x))
    return f.select(
        bars,
        "*",
        (x * F.col("volume")).alias("trading_value"),
        ret.alias("return_1d"),
        *[c.alias(name) for name, c in sma_set(f, x, prefix="ma").items()],
        f.std(ret, 20, ddof=1).alias("volatility20"),
    )


def market_dataset(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Bars with symbol-master columns and the market features.

    The master grows with the listing, so no broadcast is forced: Spark
    broadcasts it while its size stays under the session's threshold and
    joins on the ticker otherwise, where a ticker is one calendar-bounded
    series.
    """
    names = master.select(
        F.col("symbol").alias("ticker"), F.col("market"), F.col("ticker").alias("code"), F.col("name_ko").alias("name")
    )
    return market_features(bars).join(names, "ticker", "left")
