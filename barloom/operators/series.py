"""Operators on one ticker's series: cleaning, slices, latest rows, returns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, finite
from barloom.schema import BAR_COLUMNS


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``.

    An aggregate rather than a window: copies of one key are reduced before
    the shuffle, so a key with very many copies does not land in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def clean_bars(df: DataFrame) -> DataFrame:
    """NaN to null, adj_close defaulting to close, rows without a key or a price dropped."""
    numbers = ["open", "high", "low", "close"]
    adjusted = finite(F.col("adj_close")) if "adj_close" in df.columns else F.lit(None).cast("double")
    out = df.select(
        "ticker",
        "date",
        *[finite(F.col(c)).alias(c) for c in numbers],
        F.col("volume"),
        adjusted.alias("adj_close"),
    )
    out = out.withColumn("adj_close", F.coalesce("adj_close", "close"))
    return out.select(*BAR_COLUMNS).dropna(subset=["ticker", "date", *numbers])


def _year_guard(df: DataFrame, low, high) -> Column:
    """A predicate on the ``year`` partition implied by a literal date range."""
    guard = F.lit(True)
    if "year" in df.columns:
        if low is not None and not isinstance(low, Column):
            guard = guard & (F.col("year") >= int(str(low)[:4]))
        if high is not None and not isinstance(high, Column):
            guard = guard & (F.col("year") <= int(str(high)[:4]))
    return guard


def slice_half_open(df: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """One ticker, start <= date < end, oldest first."""
    day = F.col("date")
    return (
        df.where(_year_guard(df, start, end))
        .where((F.col("ticker") == ticker) & (day >= F.lit(start).cast("timestamp")) & (day < F.lit(end).cast("timestamp")))
        .select(*BAR_COLUMNS)
        .orderBy("date")
    )


def slice_inclusive(df: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """One ticker, both ends included, oldest first."""
    return (
        df.where(_year_guard(df, start, end))
        .where(
            (F.col("ticker") == ticker)
            & F.col("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        )
        .select(*BAR_COLUMNS)
        .orderBy("date")
    )


def latest_date(df: DataFrame, column: str = "date") -> Column:
    """max(date) as a scalar subquery, for use inside another expression; with a ``year`` partition only the newest is read."""
    if "year" in df.columns and column == "date":
        df = df.where(F.col("year") == df.select(F.max("year")).scalar())
    return df.select(F.max(column)).scalar()


def trailing_window(df: DataFrame, days: int, as_of: str | Column | None = None) -> DataFrame:
    """Rows of the ``days`` days up to ``as_of``.

    The anchor is the given date or the newest date of the table, never the
    clock, so a re-run gives the same rows.
    """
    if isinstance(as_of, str):
        dt.datetime.strptime(as_of, "%Y-%m-%d")  # a malformed date is an error
        low = dt.date.fromisoformat(as_of) - dt.timedelta(days=days)
        guard = _year_guard(df, low.isoformat(), as_of)
        return df.where(guard).where(
            (F.to_date("date") >= F.lit(low)) & (F.to_date("date") <= F.lit(as_of).cast("date"))
        )
    anchor = F.to_date(latest_date(df) if as_of is None else as_of)
    if "year" in df.columns:
        # partitions are pruned when the anchor is known, at run time
        df = df.where(F.col("year").cast("int").between(F.year(F.date_sub(anchor, days)), F.year(anchor)))
    return df.where((F.to_date("date") >= F.date_sub(anchor, days)) & (F.to_date("date") <= anchor))


def latest_per_ticker(df: DataFrame, require_market_date: bool = False) -> DataFrame:
    """Newest row of each ticker; optionally only if it is on the newest date of all."""
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    out = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")
    if require_market_date:
        out = out.where(F.col("date") == latest_date(df))
    return out


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each ticker."""
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def min_history(df: DataFrame, bars: int) -> DataFrame:
    """Tickers with at least ``bars`` rows."""
    size = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return df.withColumn("_n", size).where(F.col("_n") >= bars).drop("_n")


def max_dates(df: DataFrame) -> DataFrame:
    """Newest date per upper-cased ticker; rows without ticker or date do not count."""
    known = df.where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
    return known.groupBy(F.upper("ticker").alias("ticker")).agg(F.max("date").alias("max_date"))


def returns(df: DataFrame, price: str = "close") -> DataFrame:
    """1/5/20-row returns and the log return."""
    f, x = Frames(), F.col(price)
    return f.select(
        df,
        "*",
        *[change(x, f.lag(x, k)).alias(f"ret_{k}d") for k in (1, 5, 20)],
        (F.ln(x) - f.lag(F.ln(x))).alias("log_ret_1d"),
    )


def with_neighbours(df: DataFrame) -> DataFrame:
    """Add the close of the bar before and after (left alone if already there)."""
    if {"next_close", "prev_close"} <= set(df.columns):
        return df
    f = Frames()
    return f.select(df, "*", f.lead("close").alias("next_close"), f.lag("close").alias("prev_close"))


def next_day_labels(df: DataFrame) -> DataFrame:
    """Rows whose next close is known and whose close is positive, with label and forward return."""
    out = with_neighbours(df)
    return out.where(F.col("next_close").isNotNull() & (F.col("close") > 0)).select(
        "*",
        (F.col("next_close") > F.col("close")).cast("int").alias("target_up"),
        change(F.col("next_close"), F.col("close")).alias("fwd_ret_1d"),
    )


SERIES_ROWS = 200_000  # rows that a task gathers before it works on them


def whole_series(batches: Iterator[pa.RecordBatch], rows: int = SERIES_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table of whole tickers, first row of each) from batches sorted by ticker; at least ``rows`` rows but for the last table.

    What waits for more batches is one ticker, as long as the calendar.
    """
    waiting: list[pa.Table] = []
    have = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        have += batch.num_rows
        if have < rows:
            continue
        table = pa.concat_tables(waiting).combine_chunks()
        first = _first_rows(table)
        if len(first) > 1:
            yield table.slice(0, first[-1]), first[:-1]
            table = table.slice(first[-1])
        waiting, have = [table], table.num_rows
    if have:
        table = pa.concat_tables(waiting).combine_chunks()
        yield table, _first_rows(table)


def _first_rows(table: pa.Table) -> np.ndarray:
    ticker = pc.fill_null(table["ticker"], "\0")
    turns = pc.not_equal(ticker.slice(1), ticker.slice(0, max(0, len(ticker) - 1)))
    return np.append(0, np.flatnonzero(turns.to_numpy(zero_copy_only=False)) + 1)
