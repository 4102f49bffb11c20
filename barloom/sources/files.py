"""File sources: per-ticker CSV folders, typed tables, the bar lake, wide matrices."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import to_number
from barloom.operators.series import keep_last
from barloom.schema import BAR_COLUMNS, BAR_SCHEMA

REQUIRED = ["date", "open", "high", "low", "close", "volume"]
# Accepted spellings of the date column in the tolerant reader.
DATE_ALIASES = ("date", "datetime", "timestamp")


def snake(name: str) -> str:
    """Header key of the strict reader: trimmed, lower case, blanks to underscores."""
    return name.strip().lstrip("﻿").lower().replace(" ", "_")


def alnum(name: str) -> str:
    """Header key of the tolerant reader: lower-case letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve_columns(columns: list[str], spellings: dict[str, list[str]]) -> dict[str, str]:
    """The spelling in use of each wanted column, by its listed order; an error names all that have none."""
    there = set(columns)
    used = {wanted: next((s for s in known if s in there), None) for wanted, known in spellings.items()}
    absent = {wanted: spellings[wanted] for wanted, spelling in used.items() if spelling is None}
    if absent:
        raise KeyError(f"no column for {absent}; available: {sorted(there)}")
    return used


def standard_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


# Vendor spellings of the bar columns.
VENDOR_NAMES = {
    "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Volume": "volume", "Adj Close": "adj_close", "Ticker": "ticker",
}


def from_vendor(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor columns to canonical bars: renamed, adj_close defaulted, rows without a price dropped."""
    out = df.withColumnsRenamed(VENDOR_NAMES)
    if ticker is not None:
        out = out.withColumn("ticker", F.lit(ticker))
    if "adj_close" not in out.columns:
        out = out.withColumn("adj_close", F.lit(None).cast("double"))
    out = out.withColumn("adj_close", F.coalesce("adj_close", "close"))
    return out.select(*BAR_COLUMNS).dropna(subset=["date", "open", "high", "low", "close"])


def _header_groups(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Distinct first lines with the files that begin with them, whatever they hold.

    A file's first line is the first row of its block at 0, taken on the
    executors; the driver sees one line per distinct layout and the file names
    it lists anyway.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    firsts = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "row").alias("value"))
    groups = firsts.groupBy("value").agg(F.collect_list("file").alias("files")).collect()
    return [(g["value"], sorted(g["files"])) for g in sorted(groups, key=lambda g: g["value"])]


def _read_layout(
    spark: SparkSession, header: str, files: list[str], key: Callable[[str], str]
) -> DataFrame:
    names = [key(c.strip('"')) for c in header.rstrip("\r").split(",")]
    names = [n or f"_blank{i}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
    return raw.select(
        *[c for c in names],
        F.upper(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)).alias("ticker"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("_order"),
    )


def read_ticker_csvs(spark: SparkSession, path: str, tolerant: bool = False, on_bad: str = "skip") -> DataFrame:
    """Bars from one CSV per ticker; the ticker is the upper-cased file stem.

    Header spelling may differ from file to file. Dates are parsed as UTC,
    numbers that cannot be read are null, rows without a date or a price are
    dropped and of repeated dates the last row stays. tolerant=True matches
    headers by letters and digits, accepts date aliases and reads a missing
    volume as zero. Files lacking a required column are skipped, or raise
    with on_bad="raise".
    """
    parts = []
    for header, files in _header_groups(spark, path):
        keys = [(alnum if tolerant else snake)(c.strip('"')) for c in header.rstrip("\r").split(",")]
        dated = tolerant and any(a in keys for a in DATE_ALIASES)
        missing = [c for c in REQUIRED if c not in keys and not (c == "date" and dated)]
        if missing:
            if on_bad == "raise":
                raise ValueError(f"{files[0]}: missing required columns {', '.join(missing)}")
            continue
        raw = _read_layout(spark, header, files, alnum if tolerant else snake)
        if tolerant:
            found = [a for a in DATE_ALIASES if a in raw.columns]
            raw = raw.withColumnRenamed(found[0], "date") if found else raw
            raw = raw.withColumnRenamed("adjclose", "adj_close")
        close = to_number(F.col("close"))
        adjusted = to_number(F.col("adj_close")) if "adj_close" in raw.columns and not tolerant else close
        volume = to_number(F.col("volume"))
        parts.append(
            raw.select(
                "ticker",
                F.try_to_timestamp(F.trim("date")).alias("date"),
                *[to_number(F.col(c)).alias(c) for c in ("open", "high", "low")],
                close.alias("close"),
                (F.coalesce(volume, F.lit(0.0)) if tolerant else volume).alias("volume"),
                adjusted.alias("adj_close"),
                "_order",
            )
        )
    if not parts:
        raise ValueError(f"no usable CSV files in {path}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.dropna(subset=["ticker", "date", "open", "high", "low", "close", "adj_close"])
    return keep_last(rows, ["ticker", "date"], ["_order"]).select(*BAR_COLUMNS)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix; the canonical base columns are required and projected."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "pq"):
        df = spark.read.parquet(path)
    elif suffix == "csv":
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        raise ValueError(f"unsupported input extension: .{suffix}")
    base = ["date", "ticker", "open", "high", "low", "close", "volume"]
    df = standard_columns(df)
    missing = [c for c in base if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing required columns: {missing}")
    if suffix == "csv":
        df = df.withColumn("date", F.try_to_timestamp("date"))
        df = df.withColumns({c: to_number(F.col(c)) for c in base[2:]})
    return df.select(*base)


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """The bar lake (year=*/ticker=* or year=*). The given schema keeps leading zeros of the ticker."""
    return spark.read.schema(BAR_SCHEMA).parquet(root)


def wide_to_long(df: DataFrame, separator: str = "|") -> DataFrame:
    """(date, "A|B" columns) to one row per date and ticker.

    The two header levels may come in either order; a field that is absent
    is null and rows without a close are dropped.
    """
    fields = ["Open", "High", "Low", "Close", "Volume"]
    day, *matrix = df.columns
    first_level = {c.split(separator)[0] for c in matrix}
    field_first = set(fields) <= first_level
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in matrix]
    long = df.select(day, *quoted).unpivot([day], [F.col(f"`{c}`") for c in matrix], "k", "v")
    parts = F.split("k", re.escape(separator))
    long = long.select(
        F.col(day).alias("date"),
        parts[1 if field_first else 0].alias("ticker"),
        parts[0 if field_first else 1].alias("field"),
        "v",
    )
    out = long.groupBy("date", "ticker").pivot("field", fields).agg(F.first("v", ignorenulls=True))
    return out.select("date", "ticker", *[F.col(c).alias(c.lower()) for c in fields]).dropna(subset=["close"])
