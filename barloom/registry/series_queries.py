"""Bars, slices, reports, returns and rolling windows."""

from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, ratio
from barloom.operators import series
from barloom.operators.indicators import realized_vol
from barloom.plans import analytics, relational
from barloom.registry.base import MASTER, Catalogue, Tables, W, frame, lag, query, r, roll, rounded, rs

QUERIES = Catalogue()
ONE_TICKER = "000003.KQ"
OHLC = "open high low close"
FROM, TO = "1996-01-01", "1999-12-31"
AS_OF = "(SELECT max(date) FROM bars)"


@QUERIES.add("bars", query(f"SELECT ticker, date, {rs(OHLC)}, volume, {rs('adj_close')} FROM bars"))
def bars(t: Tables):
    return rounded(t.bars)


@QUERIES.add(
    "clean_bars",
    query(
        f"SELECT ticker, date, {rs(OHLC)}, volume, {rs('adj_close')} FROM bars WHERE open IS NOT NULL"
    ),
)
def clean_bars(t: Tables):
    return rounded(series.clean_bars(t.bars.drop("adj_close")))


@QUERIES.add(
    "ohlcv_slice",
    query(
        f"""SELECT ticker, date, {rs(OHLC)}, volume, {rs('adj_close')} FROM bars
        WHERE ticker = '{ONE_TICKER}' AND date BETWEEN DATE '{FROM}' AND DATE '{TO}' ORDER BY date"""
    ),
)
def ohlcv_slice(t: Tables):
    return rounded(series.slice_inclusive(t.bars, ONE_TICKER, FROM, TO))


@QUERIES.add(
    "prices_half_open",
    query(
        f"""SELECT ticker, date, {rs(OHLC)}, volume, {rs('adj_close')} FROM bars
        WHERE ticker = '{ONE_TICKER}' AND date >= DATE '{FROM}' AND date < DATE '{TO}' ORDER BY date"""
    ),
)
def prices_half_open(t: Tables):
    return rounded(series.slice_half_open(t.bars, ONE_TICKER, FROM, TO))


@QUERIES.add(
    "high_low_52_week",
    query(
        f"""SELECT ticker, {r('max(high)', 'high_52w')}, {r('min(low)', 'low_52w')} FROM bars
        WHERE date >= {AS_OF} - INTERVAL 365 DAY GROUP BY ticker ORDER BY ticker"""
    ),
)
def high_low_52_week(t: Tables):
    return rounded(analytics.high_low_52_week(t.bars))


@QUERIES.add(
    "close_vs_52w_range",
    query(
        f"""SELECT l.ticker, {r('l.close', 'last_close')}, {rs('high_52w low_52w')},
        {r('(l.close - low_52w) / nullif(high_52w - low_52w, 0)', 'pct_in_range')}
        FROM latest l JOIN ranges USING (ticker)""",
        f"y AS (SELECT * FROM bars WHERE date >= {AS_OF} - INTERVAL 365 DAY)",
        "ranges AS (SELECT ticker, max(high) AS high_52w, min(low) AS low_52w FROM y GROUP BY ticker)",
        f"latest AS (SELECT ticker, close FROM y QUALIFY row_number() OVER ({W} DESC) = 1)",
    ),
)
def close_vs_52w_range(t: Tables):
    return rounded(analytics.close_vs_52w_range(t.bars))


@QUERIES.add(
    "cross_section_momentum",
    query(
        f"""SELECT ticker, date, {rs('ret_1m')} FROM p WHERE ret_1m IS NOT NULL
        QUALIFY row_number() OVER ({W} DESC) = 1""",
        f"p AS (SELECT ticker, date, close / {lag('close', 20)} - 1 AS ret_1m FROM bars)",
    ),
)
def cross_section_momentum(t: Tables):
    return rounded(analytics.cross_section_momentum(t.bars))


@QUERIES.add(
    "market_data_view",
    query("SELECT ticker, count(*) AS bars, max(date) AS last_date FROM bars GROUP BY ticker"),
)
def market_data_view(t: Tables):
    analytics.register_market_data(t.bars)
    return t.spark.sql(
        "SELECT ticker, count(*) AS bars, max(date) AS last_date FROM market_data"
        " WHERE date >= :since GROUP BY ticker",
        args={"since": "1900-01-01"},
    )


@QUERIES.add("max_date_per_ticker", query("SELECT upper(ticker) AS ticker, max(date) AS max_date FROM bars GROUP BY 1"))
def max_date_per_ticker(t: Tables):
    return series.max_dates(t.bars)


@QUERIES.add("last_date_of_ticker", query(f"SELECT max(date) AS last_date FROM bars WHERE ticker = '{ONE_TICKER}'"))
def last_date_of_ticker(t: Tables):
    return t.bars.where(F.col("ticker") == ONE_TICKER).agg(F.max("date").alias("last_date"))


@QUERIES.add(
    "distinct_counts",
    query("SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, count(*) AS bars FROM bars"),
)
def distinct_counts(t: Tables):
    return t.bars.agg(
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct("date").alias("dates"),
        F.count(F.lit(1)).alias("bars"),
    )


@QUERIES.add(
    "latest_per_ticker",
    query(f"SELECT ticker, date, {rs('close')}, volume FROM bars QUALIFY row_number() OVER ({W} DESC) = 1"),
)
def latest_per_ticker(t: Tables):
    return rounded(series.latest_per_ticker(t.bars).select("ticker", "date", "close", "volume"))


@QUERIES.add(
    "latest_on_market_date",
    query(f"SELECT ticker, date, {rs('close')} FROM bars WHERE date = {AS_OF}"),
)
def latest_on_market_date(t: Tables):
    return rounded(series.latest_per_ticker(t.bars, require_market_date=True).select("ticker", "date", "close"))


@QUERIES.add(
    "last_rows_per_ticker",
    query(f"SELECT ticker, date, {rs('close')} FROM bars QUALIFY row_number() OVER ({W} DESC) <= 252"),
)
def last_rows_per_ticker(t: Tables):
    return rounded(series.last_rows(t.bars, 252).select("ticker", "date", "close"))


@QUERIES.add(
    "min_history",
    query(
        "SELECT ticker, count(*) AS bars FROM (SELECT * FROM bars QUALIFY count(*) OVER"
        " (PARTITION BY ticker) >= 530) GROUP BY ticker"
    ),
)
def min_history(t: Tables):
    return series.min_history(t.bars, 530).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))


@QUERIES.add(
    "returns_multi",
    query(
        f"""SELECT ticker, date, {r(f"close / {lag('close')} - 1", 'ret_1d')},
        {r(f"close / {lag('close', 5)} - 1", 'ret_5d')}, {r(f"close / {lag('close', 20)} - 1", 'ret_20d')},
        {r(f"ln(close) - {lag('ln(close)')}", 'log_ret_1d')} FROM bars"""
    ),
)
def returns_multi(t: Tables):
    return rounded(series.returns(t.bars.select("ticker", "date", "close")).drop("close"))


@QUERIES.add(
    "rolling_std",
    query(
        f"""SELECT ticker, date, {r(roll('stddev_samp', 'close', 20), 'std_samp_20')},
        {r(roll('stddev_pop', 'close', 20), 'std_pop_20')} FROM bars"""
    ),
)
def rolling_std(t: Tables):
    f, x = Frames(), F.col("close")
    return rounded(
        f.select(
            t.bars, "ticker", "date", f.std(x, 20, ddof=1).alias("std_samp_20"), f.std(x, 20, ddof=0).alias("std_pop_20")
        )
    )


@QUERIES.add(
    "sma_partial",
    query(
        f"""SELECT ticker, date, {r(f'avg(close) OVER {frame(20)}', 'sma20')},
        {r(f'max(high) OVER {frame(20)}', 'high_20')} FROM bars"""
    ),
)
def sma_partial(t: Tables):
    f = Frames()
    return rounded(
        f.select(
            t.bars,
            "ticker",
            "date",
            f.mean(F.col("close"), 20, partial=True).alias("sma20"),
            f.highest(F.col("high"), 20, partial=True).alias("high_20"),
        )
    )


@QUERIES.add(
    "breakout_dist",
    query(
        f"""SELECT ticker, date, {r(f"adj_close / ({roll('max', 'high', 20, 1)}) - 1", 'breakout_dist_20')} FROM bars"""
    ),
)
def breakout_dist(t: Tables):
    f = Frames()
    top = f.highest(F.col("high"), 20, shift=1)
    return rounded(f.select(t.bars, "ticker", "date", change(F.col("adj_close"), top).alias("breakout_dist_20")))


@QUERIES.add(
    "rvol_dollar_volume_z",
    query(
        f"""SELECT ticker, date, {r(f"volume / ({roll('avg', 'volume', 20)})", 'rvol20')},
        {r('dv', 'dollar_volume')},
        {r(f"(dv - ({roll('avg', 'dv', 20)})) / nullif({roll('stddev_samp', 'dv', 20)}, 0)", 'dollar_volume_z20')}
        FROM (SELECT *, adj_close * volume AS dv FROM bars)"""
    ),
)
def rvol_dollar_volume_z(t: Tables):
    f, volume = Frames(), F.col("volume")
    dollars = F.col("adj_close") * volume
    z = ratio(dollars - f.mean(dollars, 20), f.std(dollars, 20, ddof=1))
    return rounded(
        f.select(
            t.bars,
            "ticker",
            "date",
            ratio(volume, f.mean(volume, 20)).alias("rvol20"),
            dollars.alias("dollar_volume"),
            z.alias("dollar_volume_z20"),
        )
    )


@QUERIES.add(
    "realized_vol",
    query(
        f"""SELECT ticker, date, {r(f"({roll('stddev_samp', 'lr', 20)}) * sqrt(252.0)", 'realized_vol20')}
        FROM (SELECT *, ln(adj_close) - {lag('ln(adj_close)')} AS lr FROM bars)"""
    ),
)
def realized_vol_query(t: Tables):
    f = Frames()
    log_return = F.ln("adj_close") - f.lag(F.ln("adj_close"))
    return rounded(f.select(t.bars, "ticker", "date", realized_vol(f, log_return).alias("realized_vol20")))


@QUERIES.add(
    "next_day_labels",
    query(
        f"""SELECT ticker, date, {r('next_close', 'next_close')}, {r('prev_close', 'prev_close')},
        CAST(next_close > close AS INTEGER) AS target_up, {r('next_close / close - 1', 'fwd_ret_1d')}
        FROM (SELECT *, lead(close) OVER ({W}) AS next_close, {lag('close')} AS prev_close FROM bars)
        WHERE next_close IS NOT NULL AND close > 0"""
    ),
)
def next_day_labels(t: Tables):
    out = series.next_day_labels(t.bars.select("ticker", "date", "close"))
    return rounded(out.drop("close"))


RELATIONAL_SQL = f"""
  SELECT ticker AS symbol, date AS trade_date, open, high, low, close, adj_close, volume,
    (adj_close / prev - 1) * 100 AS daily_return,
    100 - 100 / (1 + ({roll('avg', 'gain', 14)}) / nullif({roll('avg', 'loss', 14)}, 0)) AS rsi_14,
    {roll('avg', 'adj_close', 20)} AS sma_20, {roll('avg', 'adj_close', 60)} AS sma_60,
    {roll('avg', 'adj_close', 120)} AS sma_120
  FROM (SELECT *, greatest(coalesce(adj_close - prev, 0), 0) AS gain, greatest(coalesce(prev - adj_close, 0), 0) AS loss
        FROM (SELECT *, {lag('adj_close')} AS prev FROM bars))"""


@QUERIES.add(
    "relational_features",
    query(
        f"""SELECT symbol, trade_date, {rs('open high low close adj_close')}, volume,
        {rs('daily_return rsi_14 sma_20 sma_60 sma_120')} FROM ({RELATIONAL_SQL})"""
    ),
)
def relational_features(t: Tables):
    return rounded(relational.relational_features(t.bars))


@QUERIES.add("price_rows", query(
    f"""SELECT symbol, trade_date, {', '.join(f'CAST(round(CAST({c} AS DECIMAL(28,10)), 4) AS DOUBLE) AS {c}'
        for c in 'open high low close adj_close'.split())}, volume FROM ({RELATIONAL_SQL})"""))
def price_rows(t: Tables):
    rows = relational.to_price_rows(relational.relational_features(t.bars))
    prices = [F.col(c).cast("double").alias(c) for c in "open high low close adj_close".split()]
    return rows.select("symbol", "trade_date", *prices, "volume")


@QUERIES.add(
    "market_dataset",
    query(
        f"""SELECT b.ticker, date, {rs('open high low close')}, volume, {rs('adj_close')}, {rs('trading_value return_1d ma5 ma20 ma60 ma120 volatility20')},
        m.market, m.ticker AS code, m.name_ko AS name
        FROM feats b LEFT JOIN master m ON m.symbol = b.ticker""",
        MASTER,
        f"""feats AS (SELECT *, {', '.join(f"{roll('avg', 'close', n)} AS ma{n}" for n in (5, 20, 60, 120))},
        {roll('stddev_samp', 'return_1d', 20)} AS volatility20
        FROM (SELECT *, close * volume AS trading_value, close / {lag('close')} - 1 AS return_1d FROM bars))""",
    ),
)
def market_dataset(t: Tables):
    return rounded(relational.market_dataset(t.bars, t.master))
