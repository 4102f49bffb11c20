"""Bars from a trade-like fact table (one row per fill)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.symbols import SUFFIX_KOSDAQ, SUFFIX_KOSPI


def ticker_of(supplier_key: Column) -> Column:
    suffix = F.when(supplier_key % 2 == 0, SUFFIX_KOSPI).otherwise(SUFFIX_KOSDAQ)
    return F.concat(F.format_string("%06d", supplier_key), suffix)


def bars_from_trades(lineitem: DataFrame) -> DataFrame:
    """One bar per (ticker, trade date).

    The key is the raw supplier number, formatted only after the aggregation,
    and every aggregate is combined map-side, so a supplier-day holding a
    large share of all fills is reduced to one row per task before the
    shuffle. The output is unique on (ticker, date). Fills are ordered by one
    number of fixed width, so that the aggregation needs no sort; keys too
    large for their share of its digits fail rather than overlap.
    """
    # 16 digits of the order, 6 of its line, 16 of the part
    order, line, part = (F.col(c).cast(f"decimal({d},0)") for c, d in (("l_orderkey", 16), ("l_linenumber", 6), ("l_partkey", 16)))
    place = (order * F.lit(Decimal(10**22)) + line * F.lit(Decimal(10**16)) + part).cast("decimal(38,0)")
    fills = lineitem.select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        place.alias("place"),
    ).where(F.col("price").isNotNull())
    bars = fills.groupBy("l_suppkey", "date").agg(
        F.min_by("price", "place").alias("open"),
        F.max_by("price", "place").alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )
    return bars.select(
        ticker_of(F.col("l_suppkey")).alias("ticker"),
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("close").alias("adj_close"),
    )


def master_from_suppliers(supplier: DataFrame) -> DataFrame:
    symbol = ticker_of(F.col("s_suppkey"))
    return supplier.select(
        F.when(symbol.endswith(SUFFIX_KOSPI), "KOSPI").otherwise("KOSDAQ").alias("market"),
        F.format_string("%06d", "s_suppkey").alias("ticker"),
        symbol.alias("symbol"),
        F.col("s_name").alias("name_ko"),
    )


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def load_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_from_suppliers(spark.read.parquet(f"{sf_dir}/supplier.parquet"))
