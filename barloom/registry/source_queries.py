"""Sinks and sources: what is written is read back, and compared with the bars it came from.

Files go to the folder that all executors share, a new one for each run.
"""

from pyspark.sql import functions as F

from barloom.plans import analytics
from barloom.registry.base import Catalogue, Tables, query, r, rounded, rs
from barloom.session import shared_path
from barloom.sources import files, writers

QUERIES = Catalogue()
OHLC = "open high low close"
BARS_SQL = query(f"SELECT ticker, date, {rs(OHLC)}, volume, {rs('adj_close')} FROM bars")
TABLE_SQL = query(f"SELECT ticker, date, {rs(OHLC)}, CAST(volume AS DOUBLE) AS volume FROM bars")
AS_OF = "(SELECT max(date) FROM bars)"


def _stamped(t: Tables):
    return t.bars.withColumn("date", F.col("date").cast("timestamp"))


def _bars(df):
    return rounded(df.select("ticker", F.col("date").cast("date").alias("date"), *OHLC.split(), "volume", "adj_close"))


@QUERIES.add("lake_by_year", BARS_SQL)
def lake_by_year(t: Tables):
    root = shared_path(t.spark, "lake")
    writers.write_lake(_stamped(t), root)
    return _bars(files.read_lake(t.spark, root))


@QUERIES.add("lake_of_appended_days", BARS_SQL)
def lake_of_appended_days(t: Tables):
    """The newest days come later, as a daily load brings them."""
    root, bars = shared_path(t.spark, "lake"), _stamped(t)
    late = F.year("date") >= 1998
    writers.write_lake(bars.where(~late), root)
    writers.append_days(bars.where(late), root, layout="year")
    return _bars(files.read_lake(t.spark, root))


@QUERIES.add("lake_compacted", BARS_SQL)
def lake_compacted(t: Tables):
    """Years that were loaded twice are replaced by their rows; the others stay as they are."""
    root, bars = shared_path(t.spark, "lake"), _stamped(t)
    twice = F.year("date").isin(1995, 1996)
    writers.write_lake(bars, root)
    writers.append_days(bars.where(twice), root, layout="year")
    writers.compact_years(bars.where(twice), root, layout="year")
    return _bars(files.read_lake(t.spark, root))


@QUERIES.add(
    "lake_52_week",
    query(
        f"""SELECT ticker, {r('max(high)', 'high_52w')}, {r('min(low)', 'low_52w')} FROM bars
        WHERE date >= {AS_OF} - INTERVAL 365 DAY GROUP BY ticker ORDER BY ticker"""
    ),
)
def lake_52_week(t: Tables):
    """The 52-week report over a lake, of which it reads the last two years."""
    root = shared_path(t.spark, "lake")
    writers.write_lake(_stamped(t), root)
    return rounded(analytics.high_low_52_week(files.read_lake(t.spark, root)))


def _table(df):
    return rounded(df.select("ticker", F.col("date").cast("date").alias("date"), *OHLC.split(), F.col("volume").cast("double").alias("volume")))


@QUERIES.add("sorted_table", TABLE_SQL)
def sorted_table(t: Tables):
    path = shared_path(t.spark, "table") + "/bars.parquet"
    writers.write_sorted(t.bars, path)
    return _table(files.read_table(t.spark, path))


@QUERIES.add("csv_table", TABLE_SQL)
def csv_table(t: Tables):
    path = shared_path(t.spark, "table") + "/bars.csv"
    writers.write_csv(t.bars.withColumnsRenamed({"close": "Close", "date": "Date"}), path)
    return _table(files.read_table(t.spark, path))


@QUERIES.add("json_rows", query(f"SELECT ticker, {r('sum(close * volume)', 'traded', 2)}, count(*) AS bars FROM bars GROUP BY ticker"))
def json_rows(t: Tables):
    path = shared_path(t.spark, "json")
    sums = t.bars.groupBy("ticker").agg(F.sum(F.col("close") * F.col("volume")).alias("traded"), F.count(F.lit(1)).alias("bars"))
    writers.write_json(sums, path)
    return rounded(t.spark.read.schema("ticker string, traded double, bars long").json(path), digits=2)
