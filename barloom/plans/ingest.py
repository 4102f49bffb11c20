"""Loading jobs: incremental plans, lead-in features, lake merge, run summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.merge import upsert
from barloom.operators.series import keep_last, max_dates
from barloom.plans.analytics import report
from barloom.session import path_exists, staged
from barloom.sources.files import read_lake
from barloom.sources.tables import export_rows
from barloom.sources.writers import compact_years, write_lake

BOOTSTRAP_DAYS = 3650  # fixed value: history fetched for a new ticker


def incremental_plan(
    requested: DataFrame, bars: DataFrame, full_start: str, end: Column, full: bool = False
) -> DataFrame:
    """Start date per requested ticker: the day after its newest bar, or the full start when new.

    Tickers are trimmed, upper-cased and distinct; ``skip`` marks those already up to date.
    """
    wanted = requested.select(F.upper(F.trim("ticker")).alias("ticker")).where(F.col("ticker") != "").distinct()
    known = max_dates(bars)
    start = F.lit(full_start).cast("date")
    if not full:
        start = F.coalesce(F.date_add(F.to_date("max_date"), 1), start)
    plan = wanted.join(known, "ticker", "left").select("ticker", "max_date", start.alias("start_date"), end.alias("end_date"))
    return plan.withColumn("skip", F.col("start_date") > F.col("end_date"))


def shard_plan(requested: DataFrame, bars: DataFrame, today: Column) -> DataFrame:
    """Bootstrap new tickers over ten years; reload only the current year of known ones."""
    known = max_dates(bars)
    start = F.when(F.col("max_date").isNull(), F.date_sub(today, BOOTSTRAP_DAYS)).otherwise(F.trunc(today, "year"))
    return requested.join(known, "ticker", "left").select(
        "ticker",
        start.alias("start_date"),
        today.alias("end_date"),
        F.when(F.col("max_date").isNull(), "bootstrap").otherwise("current_year").alias("mode"),
    )


def new_rows(incoming: DataFrame, bars: DataFrame) -> DataFrame:
    """Incoming rows newer than the stored history of their ticker."""
    known = max_dates(bars)
    joined = incoming.join(known, "ticker", "left")
    return joined.where(F.col("max_date").isNull() | (F.col("date") > F.col("max_date"))).drop("max_date")


def incremental_features(bars: DataFrame, incoming: DataFrame, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features that new or corrected bars change: per ticker, every row from its first incoming day on.

    ``incoming`` is unique on (ticker, date) and replaces stored bars of the
    same day. Features are computed over the whole stored series of the touched
    tickers, so no look-back is cut short and running features are right; a
    series is as long as the calendar.
    """
    keys = ["ticker", "date"]
    first = incoming.groupBy("ticker").agg(F.min("date").alias("_first"))
    touched = bars.select(*incoming.columns).join(first.select("ticker"), "ticker", "left_semi")
    series = touched.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
    start = first.select(F.col("ticker").alias("symbol"), F.to_date("_first").alias("_first"))
    changed = features(series).join(start, "symbol").where(F.col("trade_date") >= F.col("_first"))
    return changed.drop("_first")


def lake_export(source: DataFrame, root: str, layout: str = "year") -> None:
    """Typed, cleaned rows of a relational source into the lake."""
    write_lake(export_rows(source), root, layout)


def merge_into_lake(
    spark: SparkSession, incoming: DataFrame, root: str, layout: str = "year", order: list[str] | None = None
) -> None:
    """Upsert bars by (ticker, date), rewriting only the years they touch.

    Repeated keys within ``incoming`` need ``order``: columns of it by which
    the last row arrived last. Without them such bars are refused.
    The touched years are collected (at most a calendar of them) so that only
    those partitions are read; the merged rows are written aside first, since
    they are read from the very partitions they replace.
    """
    rows = export_rows(incoming, order or [])
    keys = ["ticker", "date"]
    if order:
        rows = keep_last(rows, keys, order).drop(*order)
    elif not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("bars repeat a (ticker, date): name the columns that tell which arrived last")
    years = [r["year"] for r in rows.select("year").distinct().collect()]
    if not years:
        return
    stored = read_lake(spark, root).where(F.col("year").isin(years)) if path_exists(spark, root) else rows.limit(0)
    merged = upsert(stored, rows, keys, F.current_timestamp())
    compact_years(staged(merged), root, layout)


def load_summary(results: DataFrame, top: int = 20) -> DataFrame:
    """One row over (ticker, rows, failed): processed, updated, failed, appended rows, most updated tickers."""
    best = (
        results.where(F.col("rows") > 0)
        .orderBy(F.col("rows").desc(), "ticker")
        .limit(top)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("neg"), "ticker", "rows"))).alias("best"))
        .select(F.transform("best", lambda x: F.struct(x["ticker"].alias("ticker"), x["rows"].alias("rows"))))
    )
    return results.agg(
        F.count(F.lit(1)).alias("processed_tickers"),
        F.count_if(F.col("rows") > 0).alias("updated_tickers"),
        F.count_if("failed").alias("failed_tickers"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows_appended"),
    ).select("*", best.scalar().alias("top_updated"))


def refresh(
    spark: SparkSession,
    root: str,
    *,
    initial: DataFrame | None = None,
    incoming: DataFrame | None = None,
    name: str | None = None,
    **params,
) -> DataFrame | None:
    """Optional first load, then an optional merge of new bars, then an optional report on the lake."""
    if initial is not None:
        lake_export(initial, root)
    if incoming is not None:
        merge_into_lake(spark, incoming, root)
    return report(name, read_lake(spark, root), **params) if name else None
