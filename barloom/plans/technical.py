"""The full indicator set per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import to_number
from barloom.operators.indicators import window_indicators
from barloom.operators.ranking import all_of
from barloom.operators.recursive import FAMILIES, recursive_indicators, walk_inputs, walked_in_batches
from barloom.session import staged

BASE = ["ticker", "date", "open", "high", "low", "close", "volume"]

# Output columns kept by prefix, and prefixes dropped first.
KEEP_PREFIXES = (
    "sma_", "ema_", "macd", "adx_", "dmp_", "dmn_", "psar", "its_", "iks_", "rsi_", "stoch_",
    "cci_", "roc_", "willr_", "mom_", "bbl_", "bbm_", "bbu_", "bbb_", "bbp_", "atr_", "kcl_",
    "kcb_", "kcu_", "stdev_", "obv", "mfi_", "cmf_", "vwma_",
)
DROP_PREFIXES = ("isa_", "isb_", "ics_")


def keep_indicator_columns(df: DataFrame) -> DataFrame:
    """Base columns plus columns with a kept prefix; a dropped prefix wins."""

    def wanted(name: str) -> bool:
        lower = name.lower()
        return lower in BASE or (not lower.startswith(DROP_PREFIXES) and lower.startswith(KEEP_PREFIXES))

    return df.select(*[c for c in dict.fromkeys(df.columns) if wanted(c)])


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def downcast(df: DataFrame) -> DataFrame:
    """double to float, for sinks only."""
    return df.select(
        *[
            F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


NO_TICKER, NO_ROWS, REPEATED = "no ticker", "no valid rows after normalization", "repeated dates"


def typed_series(raw: DataFrame) -> DataFrame:
    """Rows as they came, with dates and numbers read from whatever text they hold; ``usable`` tells a date and four prices."""
    numbers = [to_number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    typed = raw.select(F.col("ticker").cast("string").alias("ticker"), F.col("date").cast("string").try_cast("date").alias("date"), *numbers)
    prices = [F.col(c).isNotNull() for c in ("open", "high", "low", "close")]
    volume = F.coalesce("volume", F.lit(0.0)).try_cast("long")
    return typed.withColumn("volume", volume).withColumn("usable", F.col("date").isNotNull() & all_of(prices))


def series_faults(typed: DataFrame) -> DataFrame:
    """(ticker, error, rows) of every ticker; error is null for a sound one.

    Counted by date first, so that the copies of a day, or rows without a
    ticker, shrink before they meet.
    """
    days = typed.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("usable"))
    counted = days.groupBy("ticker").agg(F.sum("n").alias("rows"), F.sum("usable").alias("usable"), F.max("usable").alias("most"))
    fault = (
        F.when(F.col("ticker").isNull(), NO_TICKER).when(F.col("usable") == 0, NO_ROWS).when(F.col("most") > 1, REPEATED)
    )
    return counted.select("ticker", fault.alias("error"), "rows")


def indicators_or_errors(raw: DataFrame, *, batches: bool = False, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(indicators of every sound ticker, (ticker, error, rows) of the others).

    A ticker without a usable row, or with two for one date, is rejected; the
    others do not notice. The typed rows are written once for both results.
    """
    typed = staged(typed_series(raw))
    faults = series_faults(typed)
    sound = typed.where("usable").join(faults.where("error IS NULL").select("ticker"), "ticker")
    return technical_indicators(sound.select(*BASE), batches=batches, only=only), faults.where("error IS NOT NULL")


def technical_indicators(bars: DataFrame, *, batches: bool = False, only: list[str] | None = None) -> DataFrame:
    """Bars with all window and recursive indicators: one shuffle by ticker.

    With ``batches`` long frames and recurrences are worked out in Arrow
    batches, which pays on long tables; without, Python is not needed. Spark
    does not see which columns of a batch are read later: ``only`` names them.
    """
    base = bars.select(*BASE)
    if batches:
        rows, hidden = walk_inputs(base)
        walks = [f for f, family in FAMILIES.items() if only is None or set(only) & set(family.outputs)]
        return keep_indicator_columns(walked_in_batches(window_indicators(rows, batches=True, only=only), hidden, walks))
    return keep_indicator_columns(recursive_indicators(window_indicators(base)))
