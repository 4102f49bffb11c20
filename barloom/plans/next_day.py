"""Next-day signal: trailing features of the newest row, rule score, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, clamp, ratio
from barloom.functions.symbols import BARE_CODE, bare_code
from barloom.operators.ranking import number_rows
from barloom.operators.series import latest_per_ticker, trailing_window

REQUIRED = ["ret_1d", "ret_5d", "ret_20d", "sma20", "sma60", "sma120"]


def signal_features(bars: DataFrame, lookback_days: int, as_of: str | Column | None = None) -> DataFrame:
    """Newest row of each six-digit ticker inside the lookback; returns are percentages.

    Averages and highs use whatever rows the lookback holds (no min-periods).
    """
    f, close = Frames(), F.col("close")
    window = trailing_window(bars, lookback_days, as_of).where(bare_code(F.col("ticker")).rlike(BARE_CODE))
    rows = f.select(
        window,
        "ticker",
        "date",
        F.to_date("date").alias("trade_date"),
        "close",
        *[(change(close, f.lag(close, k)) * F.lit(100.0)).alias(f"ret_{k}d") for k in (1, 5, 20)],
        *[f.mean(close, n, partial=True).alias(f"sma{n}") for n in (20, 60, 120)],
        ratio(F.col("volume"), f.mean(F.col("volume"), 20, partial=True)).alias("volume_ratio_20d"),
        ratio(close, f.highest(F.col("high"), 20, partial=True)).alias("breakout_ratio_20d"),
    )
    return latest_per_ticker(rows).drop("date").dropna(subset=REQUIRED)


def _rules() -> list[tuple[Column, Column, str]]:
    """(condition, points, reason), in the order reasons are listed. Points and labels are fixed values."""
    c = {
        n: F.col(n) for n in ("close", "sma20", "sma60", "sma120", "ret_1d", "ret_5d", "ret_20d")
    }
    volume = F.coalesce(F.col("volume_ratio_20d"), F.lit(0.0))
    breakout = F.coalesce(F.col("breakout_ratio_20d"), F.lit(0.0))

    def capped(x: Column, slope: float, top: float) -> Column:
        return F.least(F.lit(top), x * F.lit(slope))

    return [
        (c["close"] > c["sma20"], F.lit(15.0), "close>sma20"),
        (c["close"] > c["sma60"], F.lit(12.0), "close>sma60"),
        (c["sma20"] > c["sma60"], F.lit(10.0), "sma20>sma60"),
        (c["sma60"] > c["sma120"], F.lit(8.0), "sma60>sma120"),
        (c["ret_20d"] > 0, capped(c["ret_20d"], 0.8, 15.0), "20d_momentum"),
        (c["ret_5d"] > 0, capped(c["ret_5d"], 1.2, 10.0), "5d_momentum"),
        (volume.between(1.2, 3.5), F.lit(10.0), "volume_spike"),
        (volume > 3.5, F.lit(5.0), "high_volume"),
        (breakout >= 0.995, F.lit(10.0), "near_20d_high"),
        (c["ret_1d"] >= 8, F.lit(-8.0), "overheated_1d"),
    ]


def add_signal_score(features: DataFrame) -> DataFrame:
    """Rule score, pseudo-probability in [5, 95] and the comma-joined reasons that fired."""
    total, reasons = F.lit(0.0), []
    for condition, points, label in _rules():
        total = total + F.when(condition, points).otherwise(F.lit(0.0))
        reasons.append(F.when(condition, F.lit(label)))
    probability = clamp(F.lit(28.0) + total * F.lit(0.72), 5.0, 95.0)
    return features.select(
        "*",
        F.round(total, 2).alias("score"),
        F.round(probability, 2).alias("probability_next_up"),
        F.concat_ws(",", *reasons).alias("reason"),
    )


def next_day_signal(bars: DataFrame, lookback_days: int = 400, as_of: str | Column | None = None) -> DataFrame:
    """All scored tickers with their overall rank."""
    scored = add_signal_score(signal_features(bars, lookback_days, as_of))
    order = [F.col(c).desc_nulls_last() for c in ("probability_next_up", "score", "ret_20d")]
    # one row per ticker
    return number_rows(scored, [*order, F.col("ticker")], "rank").withColumn("rank", F.col("rank").cast("int"))
