"""Table schemas. Readers never infer types; they use these."""

from pyspark.sql import types as T

BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume", "adj_close"]

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
    ]
)

PRICE = T.DecimalType(18, 4)
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]
DERIVED_COLUMNS = ["daily_return", "rsi_14", "sma_20", "sma_60", "sma_120"]

DAILY_PRICES_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("trade_date", T.DateType(), False),
        *[T.StructField(c, PRICE, False) for c in PRICE_COLUMNS],
        T.StructField("volume", T.LongType(), False),
        *[T.StructField(c, PRICE) for c in DERIVED_COLUMNS],
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

SYMBOL_MASTER_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("market", "ticker", "symbol", "name_ko")]
)

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField(
            "best",
            T.StructType(
                [
                    T.StructField("feature_names", T.ArrayType(T.StringType())),
                    T.StructField("weights", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
    ]
)

STRATEGY_SCHEMA = "strategy_id long, signal string, low double, high double"

RULE_FIELDS = [
    ("rsi_period", "int"),
    ("rsi_entry", "double"),
    ("rsi_exit", "double"),
    ("bb_period", "int"),
    ("bb_std", "double"),
    ("vol_period", "int"),
    ("vol_ratio_min", "double"),
    ("breakout_lookback", "int"),
    ("trend_ma", "int"),
    ("hold_days", "int"),
    ("stop_loss", "double"),
    ("take_profit", "double"),
]
RULE_SCHEMA = "strategy_id long, " + ", ".join(f"{name} {kind}" for name, kind in RULE_FIELDS)
