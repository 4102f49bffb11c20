"""Sinks: the bar lake, sorted tables, CSV and JSON snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: rows per Parquet row group of the lake.
ROW_GROUP_ROWS = 200_000


def _with_year(df: DataFrame) -> DataFrame:
    return df if "year" in df.columns else df.withColumn("year", F.year("date"))


def write_lake(df: DataFrame, root: str, layout: str = "year", mode: str = "append") -> None:
    """Write bars as ZSTD Parquet partitioned by year, or by year and ticker.

    layout="year": range-partitioned and sorted by (year, ticker, date), so
    one year spreads over many tasks and files, and ticker filters skip row
    groups by their statistics. layout="year_ticker": one folder and file per
    pair, for readers that expect it (many small files).
    mode="overwrite" replaces only the partitions present in ``df``.
    """
    df = _with_year(df)
    if layout == "year":
        parted = df.repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "date")
        folders = ["year"]
    elif layout == "year_ticker":
        parted = df.repartition("year", "ticker").sortWithinPartitions("year", "ticker", "date")
        folders = ["year", "ticker"]
    else:
        raise ValueError(f"unknown layout {layout!r}")
    (
        parted.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .partitionBy(*folders)
        .parquet(root)
    )


def append_days(df: DataFrame, root: str, layout: str = "year_ticker") -> None:
    """Add new day parts; existing files stay."""
    write_lake(df, root, layout, "append")


def compact_years(df: DataFrame, root: str, layout: str = "year_ticker") -> None:
    """Replace the touched partitions by sorted files; running it again changes nothing."""
    write_lake(df, root, layout, "overwrite")


def write_sorted(df: DataFrame, path: str, keys: tuple[str, ...] = ("date", "ticker")) -> None:
    """ZSTD Parquet globally sorted by key: files hold consecutive ranges."""
    df.orderBy(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV snapshot with header (plain UTF-8, no byte-order mark)."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Summary or payload rows as JSON lines."""
    df.write.mode("overwrite").json(path)
