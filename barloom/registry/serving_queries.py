"""Ingest, merge, master and serving queries."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import merge
from barloom.operators.series import latest_per_ticker
from barloom.plans import daily_top, ingest, master, relational, serving, tier1
from barloom.registry.base import MASTER, Catalogue, Tables, W, query, r, rounded, rs
from barloom.registry.model_queries import (
    CANDIDATES_SQL,
    CAND_COLUMNS,
    CANDIDATE_ORDER,
    MODEL,
    RULES,
    TIER1,
    TOP_SQL,
    _train,
)
from barloom.registry.series_queries import RELATIONAL_SQL
from barloom.session import staged

QUERIES = Catalogue()
STAMP = "TIMESTAMP '2002-01-01 00:00:00'"
CUT = "2001-06-30"
OLD_STAMP = "TIMESTAMP '2001-07-01 00:00:00'"


def _now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")


def _prices(t: Tables):
    """Price rows with stamps, doubles instead of decimals for comparison."""
    return t.bars.select(
        F.col("ticker").alias("symbol"), F.col("date").alias("trade_date"), "close", "volume",
        F.lit("2001-07-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("2001-07-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


# incoming: every bar after the cut plus corrected closes for the half-year before it
EXISTING_WHERE, INCOMING_WHERE = f"date <= DATE '{CUT}'", "date >= DATE '2001-01-01'"


@QUERIES.add(
    "upsert_merge",
    query(
        f"""SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.trade_date, n.trade_date) AS trade_date,
        {r('coalesce(n.close, o.close)', 'close')}, coalesce(n.volume, o.volume) AS volume,
        coalesce(o.created_at, {STAMP}) AS created_at, CASE WHEN n.symbol IS NOT NULL THEN {STAMP} ELSE o.updated_at END AS updated_at
        FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.trade_date = n.trade_date""",
        f"old AS (SELECT ticker AS symbol, date AS trade_date, close, volume, {OLD_STAMP} AS created_at, {OLD_STAMP} AS updated_at FROM bars WHERE {EXISTING_WHERE})",
        f"new AS (SELECT ticker AS symbol, date AS trade_date, close * 2 AS close, volume FROM bars WHERE {INCOMING_WHERE})",
    ),
)
def upsert_merge(t: Tables):
    prices = _prices(t)
    existing = prices.where(F.col("trade_date") <= CUT)
    incoming = prices.where(F.col("trade_date") >= "2001-01-01").select(
        "symbol", "trade_date", (F.col("close") * 2.0).alias("close"), "volume"
    )
    return rounded(merge.upsert(existing, incoming, ["symbol", "trade_date"], _now()))


@QUERIES.add(
    "range_replace",
    query(
        f"""SELECT symbol, trade_date, {rs('close')}, volume FROM (SELECT o.* FROM old o LEFT JOIN rg USING (symbol)
        WHERE lo IS NULL OR trade_date < lo OR trade_date > hi UNION ALL SELECT * FROM new)""",
        "old AS (SELECT ticker AS symbol, date AS trade_date, close, volume FROM bars)",
        "new AS (SELECT symbol, trade_date, close * 2 AS close, volume FROM old WHERE trade_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND volume >= 20)",
        "rg AS (SELECT symbol, min(trade_date) AS lo, max(trade_date) AS hi FROM new GROUP BY symbol)",
    ),
)
def range_replace(t: Tables):
    existing = _prices(t).drop("created_at", "updated_at")
    incoming = existing.where(F.col("trade_date").between("1999-01-01", "1999-12-31") & (F.col("volume") >= 20))
    incoming = incoming.withColumn("close", F.col("close") * 2.0)
    return rounded(merge.range_replace(existing, incoming))


def _one_more(rows: DataFrame, symbol: str, name: str) -> DataFrame:
    """A row of a symbol that the listing does not hold."""
    return rows.select(F.lit(symbol).alias("symbol"), F.lit(name).alias("company_name"), F.lit(True).alias("is_active")).distinct()


@QUERIES.add(
    "upsert_master",
    query(
        f"""SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.company_name, o.company_name) AS company_name, true AS is_active,
        CASE WHEN n.symbol IS NOT NULL THEN {STAMP} ELSE {OLD_STAMP} END AS updated_at FROM old o FULL JOIN new n ON o.symbol = n.symbol""",
        MASTER,
        "old AS (SELECT symbol, name_ko AS company_name FROM master UNION ALL SELECT '999998.KS', 'gone')",
        "new AS (SELECT symbol, upper(name_ko) AS company_name FROM master UNION ALL SELECT '999999.KS', 'NEW')",
    ),
)
def upsert_master(t: Tables):
    stamp = F.lit("2001-07-01 00:00:00").cast("timestamp_ntz").alias("updated_at")
    rows = t.master.select("symbol", F.col("name_ko").alias("company_name"), F.lit(True).alias("is_active"))
    existing = rows.unionByName(_one_more(rows, "999998.KS", "gone")).withColumn("updated_at", stamp)
    incoming = rows.unionByName(_one_more(rows, "999999.KS", "new")).withColumn("company_name", F.upper("company_name"))
    return merge.upsert_master(existing, incoming, _now())


PLAN_SQL = """
req AS (SELECT symbol AS ticker FROM master UNION ALL SELECT '999999.KS'),
mx AS (SELECT ticker, max(date) AS max_date FROM bars GROUP BY ticker)"""


def _requested(t: Tables):
    extra = t.master.select(F.lit("999999.ks ").alias("ticker")).distinct()
    return t.master.select(F.col("symbol").alias("ticker")).unionByName(extra)


@QUERIES.add(
    "incremental_plan",
    query(
        """SELECT ticker, max_date, s AS start_date, DATE '2001-11-03' AS end_date, s > DATE '2001-11-03' AS skip FROM
        (SELECT req.ticker, max_date, coalesce(max_date + 1, DATE '1995-01-01') AS s FROM req LEFT JOIN mx USING (ticker))""",
        MASTER,
        PLAN_SQL,
    ),
)
def incremental_plan(t: Tables):
    return ingest.incremental_plan(_requested(t), t.bars, "1995-01-01", F.lit(dt.date(2001, 11, 3)))


@QUERIES.add(
    "shard_plan",
    query(
        """SELECT req.ticker, CASE WHEN max_date IS NULL THEN DATE '2001-11-03' - 3650 ELSE DATE '2001-01-01' END AS start_date, DATE '2001-11-03' AS end_date,
        CASE WHEN max_date IS NULL THEN 'bootstrap' ELSE 'current_year' END AS mode FROM req LEFT JOIN mx USING (ticker)""",
        MASTER,
        PLAN_SQL,
    ),
)
def shard_plan(t: Tables):
    requested = _requested(t).select(F.upper(F.trim("ticker")).alias("ticker"))
    return ingest.shard_plan(requested, t.bars, F.lit(dt.date(2001, 11, 3)))


@QUERIES.add(
    "incremental_features",
    query(
        f"""SELECT symbol, trade_date, {rs('daily_return rsi_14 sma_20 sma_60 sma_120')} FROM ({RELATIONAL_SQL}) WHERE trade_date > DATE '{CUT}'"""
    ),
)
def incremental_features(t: Tables):
    bars = t.bars
    stored, incoming = bars.where(F.col("date") <= CUT), bars.where(F.col("date") > CUT)
    out = ingest.incremental_features(stored, incoming, relational.relational_features)
    return rounded(out.select("symbol", "trade_date", "daily_return", "rsi_14", "sma_20", "sma_60", "sma_120"))


@QUERIES.add(
    "new_rows",
    query(f"SELECT ticker, date, {rs('close')} FROM bars WHERE date > DATE '{CUT}'"),
)
def new_rows(t: Tables):
    bars = t.bars
    # tickers whose stored history ends at the cut contribute only later rows
    return rounded(ingest.new_rows(bars, bars.where(F.col("date") <= CUT)).select("ticker", "date", "close"))


@QUERIES.add(
    "load_summary",
    query(
        f"""SELECT count(*) AS processed_tickers, count(*) FILTER (WHERE rows > 0) AS updated_tickers, count(*) FILTER (WHERE rows IS NULL) AS failed_tickers,
        CAST(coalesce(sum(rows), 0) AS BIGINT) AS total_rows_appended,
        (SELECT string_agg(ticker, ',' ORDER BY rows DESC, ticker) FROM (SELECT * FROM ld WHERE rows > 0 ORDER BY rows DESC, ticker LIMIT 20)) AS top_updated FROM ld""",
        MASTER,
        f"ld AS (SELECT m.symbol AS ticker, b.n AS rows FROM master m LEFT JOIN (SELECT ticker, count(*) AS n FROM bars WHERE date > DATE '{CUT}' GROUP BY ticker) b ON b.ticker = m.symbol)",
    ),
)
def load_summary(t: Tables):
    loaded = t.bars.where(F.col("date") > CUT).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    results = t.master.select(F.col("symbol").alias("ticker")).join(loaded, "ticker", "left")
    out = ingest.load_summary(results.withColumn("failed", F.col("rows").isNull()))
    return out.withColumn("top_updated", F.concat_ws(",", F.col("top_updated.ticker")))


@QUERIES.add("symbol_master", query("SELECT market, ticker, symbol, name_ko FROM master", MASTER))
def symbol_master(t: Tables):
    listing = t.read("supplier").select(
        F.col("s_suppkey").cast("double").cast("string").alias("Code"), F.col("s_name").alias("Name"),
        (F.col("s_suppkey") % 2 == 0).alias("even"),
    )
    return master.symbol_master({"KOSPI": listing.where("even"), "KOSDAQ": listing.where("NOT even")})


@QUERIES.add(
    "active_universe",
    query(
        """SELECT ticker AS symbol, name_ko AS company_name, market AS sector, true AS is_active FROM master
        UNION ALL SELECT '999999', '999999.KS', NULL, true""",
        MASTER,
    ),
)
def active_universe(t: Tables):
    listing = t.master.select(
        F.col("ticker").alias("symbol"), F.col("name_ko").alias("company_name"), F.col("market").alias("sector")
    )
    codes = t.master.select(F.col("ticker").alias("code"), F.col("symbol").alias("full"))
    unlisted = t.master.select(F.lit("999999").alias("code"), F.lit("999999.KS").alias("full")).distinct()
    codes = codes.unionByName(unlisted)
    return master.active_universe(codes, listing, F.col("full"))


@QUERIES.add(
    "symbols_in_order",
    query("SELECT ticker AS symbol, min(date) AS pos FROM bars GROUP BY ticker"),
)
def symbols_in_order(t: Tables):
    rows = t.bars.select(F.col("ticker").alias("symbol"), F.col("date").alias("pos"))
    return master.distinct_in_order(rows)


# --- serving -------------------------------------------------------------------------------

SNAP = [*TIER1, CANDIDATES_SQL]
CSUM = f"""
cr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {CANDIDATE_ORDER}) AS candidate_rank FROM cand),
sn AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
lim AS (SELECT min(tier1_composite_score) AS lo, max(tier1_composite_score) AS hi FROM sn),
cf AS (SELECT sn.*, CAST(CASE WHEN hi <= lo THEN 85 ELSE floor(least(99, greatest(0, 70 + (tier1_composite_score - lo) / (hi - lo) * 29)) + 0.5) END AS INTEGER) AS confluence_score FROM sn, lim),
csum AS (SELECT CAST(row_number() OVER (ORDER BY candidate_rank, tier1_composite_score DESC, ticker) AS INTEGER) AS rank, ticker, strftime(date, '%Y-%m-%d') AS ranking_date,
  floor(least(95, greatest(55, 55 + (confluence_score - 70) / 29.0::DOUBLE * 40)) * 10 + 0.5) / 10 AS win_rate, floor(coalesce(ret_5d, ret_1d) * 100 * 10 + 0.5) / 10 AS avg_return,
  confluence_score, close, ret_1d, ret_5d, rvol20, breakout_dist_20, natr14, tier1_composite_score, date, lo, hi FROM cf, lim)"""


def _snapshot(t: Tables):
    """Newest candidate row of each ticker, as a snapshot would hold it."""
    features = tier1.tier1_features(t.bars, only=tier1.CANDIDATE_FEATURES)
    candidates = tier1.buy_candidates(features, RULES, per_date=True)
    return staged(latest_per_ticker(candidates).select("candidate_rank", "ticker", "date", *CAND_COLUMNS))


@QUERIES.add(
    "candidate_summary",
    query(f"SELECT rank, ticker, ranking_date, {rs('win_rate avg_return')}, confluence_score FROM csum", *SNAP, CSUM),
)
def candidate_summary(t: Tables):
    return rounded(serving.candidate_summary(_snapshot(t)))


@QUERIES.add(
    "home_rankings",
    query(
        f"""SELECT rank, {rs('win_rate avg_return')}, confluence_score, c.ticker, coalesce(name_ko, c.ticker) AS name
        FROM csum c LEFT JOIN master m ON m.symbol = c.ticker WHERE rank <= 3""",
        MASTER,
        *SNAP,
        CSUM,
    ),
)
def home_rankings(t: Tables):
    return rounded(serving.home_rankings(_snapshot(t), t.master))


INPUTS_SQL = """
inp AS (SELECT ticker AS input FROM bars UNION SELECT lower(split_part(ticker, '.', 1)) FROM bars UNION SELECT ticker || 'X' FROM bars),
typed AS (SELECT DISTINCT upper(trim(input)) AS input FROM inp),
bt AS (SELECT DISTINCT ticker FROM bars),
ml AS (SELECT * FROM master),
res AS (SELECT input, CASE WHEN input IN (SELECT symbol FROM ml) THEN input WHEN contains(input, '.') THEN input
  WHEN input || '.KS' IN (SELECT symbol FROM ml) THEN input || '.KS' WHEN input || '.KQ' IN (SELECT symbol FROM ml) THEN input || '.KQ'
  WHEN input || '.KS' IN (SELECT ticker FROM bt) THEN input || '.KS' WHEN input || '.KQ' IN (SELECT ticker FROM bt) THEN input || '.KQ'
  ELSE input END AS symbol FROM typed)"""


def _inputs(t: Tables):
    tickers = t.bars.select("ticker").distinct()
    forms = F.array("ticker", F.lower(F.split("ticker", r"\.")[0]), F.concat("ticker", F.lit("X")))
    return tickers.select(F.explode(forms).alias("symbol"))


@QUERIES.add("symbol_resolve", query("SELECT input, symbol FROM res", MASTER, INPUTS_SQL))
def symbol_resolve(t: Tables):
    return serving.resolve_symbols(_inputs(t), t.master, t.bars)


@QUERIES.add(
    "symbol_search",
    query(
        f"""SELECT input, res.symbol AS ticker, coalesce(ml.name_ko, res.symbol) AS name, ml.market AS sector,
        coalesce(csum.ranking_date, strftime(lastd.d, '%Y-%m-%d')) AS ranking_date, csum.rank, {rs('win_rate avg_return')}, csum.confluence_score
        FROM res LEFT JOIN csum ON csum.ticker = res.symbol LEFT JOIN ml ON ml.symbol = res.symbol
        LEFT JOIN (SELECT ticker, max(date) AS d FROM bars GROUP BY ticker) lastd ON lastd.ticker = res.symbol
        WHERE csum.ticker IS NOT NULL OR ml.symbol IS NOT NULL OR lastd.ticker IS NOT NULL""",
        MASTER,
        *SNAP,
        CSUM,
        INPUTS_SQL,
    ),
)
def symbol_search(t: Tables):
    return rounded(serving.symbol_search(_inputs(t), _snapshot(t), t.master, t.bars))


@QUERIES.add(
    "market_board",
    query(
        f"""SELECT l.ticker, coalesce(name_ko, l.ticker) AS name, {r('close', 'close')}, {r('ret_1d * 100', 'change_pct')}, volume, strftime(date, '%Y-%m-%d') AS trade_date,
        'KR' AS market, 'KRW' AS currency, market AS exchange FROM (SELECT * FROM f2 QUALIFY row_number() OVER ({W} DESC) = 1) l
        LEFT JOIN master m ON m.symbol = l.ticker ORDER BY volume DESC, l.ticker LIMIT 4 OFFSET 2""",
        MASTER,
        TIER1[0],
    ),
)
def market_board(t: Tables):
    return rounded(serving.market_board(_latest_features(t), t.master, limit=4, offset=2))


def _latest_features(t: Tables):
    features = tier1.symbol_features(t.bars, ["ret_1d"]).select("ticker", "date", "close", "ret_1d", "volume")
    return latest_per_ticker(features)


@QUERIES.add(
    "tier1_payload",
    query(
        f"""SELECT c.ticker || '-' || ranking_date AS id, c.ticker AS symbol, coalesce(name_ko, c.ticker) AS name, {r('close', 'current_price')}, confluence_score AS ai_score,
        {r('ret_1d * 100', 'fluctuation_rate')}, {r('tier1_composite_score', 'score')},
        concat('5D momentum ', {{p5}}, ', 1D move ', {{p1}}, ', volume ', printf('%.1f', round(rvol20, 1)), 'x, breakout distance ', {{pb}}, ', NATR14 ', {{pn}}, '.') AS reasoning
        FROM csum c LEFT JOIN master m ON m.symbol = c.ticker""".format(
            **{
                k: f"CASE WHEN {c} > 0 THEN '+' ELSE '' END || printf('%.1f', round({c} * 100, 1)) || '%'"
                for k, c in {"p5": "ret_5d", "p1": "ret_1d", "pb": "breakout_dist_20", "pn": "natr14"}.items()
            }
        ),
        MASTER,
        *SNAP,
        CSUM,
    ),
)
def tier1_payload(t: Tables):
    return rounded(serving.tier1_items(_snapshot(t), t.master, "en"))


def _signed(c: str) -> str:
    return f"coalesce(CASE WHEN {c} >= 0 THEN '+' ELSE '' END || printf('%.2f', round({c} * 100, 2)) || '%', '-')"


def _band(c: str) -> str:
    return f"printf('%.1f', round(greatest(0, (1 - {c}) * 100), 1)) || '%'"


def _three(c: str) -> str:
    return f"printf('%.3f', round({c}, 3))"


REASON_SQL = f"""concat('Turnover ', format('{{:,}}', CAST(floor(trading_value / 1e8 + 0.5) AS BIGINT)), 'eok KRW (top ', {_band('turnover_rank_pct')}, '), 1D return ',
  {_signed('ret_1d')}, ' (top ', {_band('ret1d_rank_pct')}, '), base-model signal top ', {_band('model_rank_pct')}, '; final score ', {_three('final_score')}, ' [turnover ',
  {_three('score_turnover')}, ', return ', {_three('score_ret1d')}, ', model ', {_three('score_model')}, '], max return after buy ', {_signed('mr')}, ' (peak ', coalesce(pd, '-'), ').')"""


@QUERIES.add(
    "daily_payload",
    query(
        f"""SELECT date, string_agg(rank || '|' || date || '-' || ticker || '-' || rank || '|' || name || '|' || ai_score || '|' || {REASON_SQL}, '#' ORDER BY rank) AS items
        FROM (SELECT strftime(tp.date, '%Y-%m-%d') AS date, rank, tp.ticker, coalesce(nullif(trim(name_ko), ''), tp.ticker) AS name, tp.* EXCLUDE (date, rank, ticker),
          best.h / close - 1 AS mr, strftime(DATE '1970-01-01' + CAST(-best.d AS INTEGER), '%Y-%m-%d') AS pd
          FROM tp LEFT JOIN pk ON pk.ticker = tp.ticker AND pk.date = tp.date LEFT JOIN master ON master.symbol = tp.ticker WHERE rank <= 3)
        WHERE date BETWEEN '1999-01-01' AND '2001-12-31' GROUP BY date""",
        MASTER,
        *TOP_SQL,
    ),
)
def daily_payload(t: Tables):
    picks = daily_top.daily_top_n(_train(t), MODEL, t.master)
    items = serving.daily_items(picks, "en", start="1999-01-01", end="2001-12-31", per_day=3)
    days = serving.daily_payload(items)
    flat = F.transform(
        "items",
        lambda x: F.concat_ws(
            "|", x["rank"].cast("int").cast("string"), x["id"], x["name"], x["ai_score"].cast("string"), x["reasoning"]
        ),
    )
    return days.select("date", F.array_join(flat, "#").alias("items"))


@QUERIES.add(
    "latest_day_picks",
    query(
        f"""SELECT strftime(date, '%Y-%m-%d') AS date, CAST(rank AS DOUBLE) AS rank, ticker AS symbol, {r('prob_up_next_day', 'probability')} FROM tp
        WHERE date = (SELECT max(date) FROM tp) AND rank <= 3""",
        *TOP_SQL,
    ),
)
def latest_day_picks(t: Tables):
    picks = daily_top.daily_top_n(_train(t), MODEL, t.master)
    items = serving.latest_day_items(serving.daily_items(picks, "en"))
    return rounded(items.select("date", "rank", "symbol", "probability"))
