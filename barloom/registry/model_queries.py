"""Tier-1, next-day signal, probability model, daily picks, walk-forward, variance report."""

from pyspark.sql import functions as F

from barloom.operators import cross_section, ranking
from barloom.operators.binning import Model, fit_mappers, mapped_probability, mappers_frame, model_score, quantile_edges
from barloom.operators.series import next_day_labels, returns, with_neighbours
from barloom.plans import daily_top, next_day, tier1, variance, walk_forward
from barloom.registry.base import MASTER, Catalogue, Tables, W, frame, lag, query, r, roll, rounded, rs
from barloom.session import staged

QUERIES = Catalogue()

# Thresholds for derived bars, whose prices are noise: wide enough to keep rows.
RULES = tier1.CandidateRules(
    min_dollar_volume=2e4, max_natr14=5.0, min_rvol20=0.3, max_rvol20=3.0, min_breakout_dist_20=-0.98,
    min_ret_5d=-0.5, max_ret_1d=20.0, min_tier1_score=-0.5,
)
MODEL = Model(("ret_5d", "rvol20", "natr14", "bb_percent_b20"), (0.4, 0.3, 0.2, 0.1))
CANDIDATES = [
    (0, ["ret_5d", "rvol20"], [0.5, 0.5]),
    (1, ["ret_5d", "natr14", "bb_percent_b20"], [0.2, 0.5, 0.3]),
    (2, ["rvol20", "natr14"], [0.7, 0.3]),
]

# --- tier-1 --------------------------------------------------------------------

X = "adj_close"
FEATURES_SQL = f"""
f1 AS (SELECT *, {X} / {lag(X)} - 1 AS ret_1d, {X} / {lag(X, 5)} - 1 AS ret_5d, {X} / {lag(X, 20)} - 1 AS ret_20d,
  ln({X}) - {lag(f'ln({X})')} AS log_ret_1d, {roll('avg', X, 20)} AS sma20, {roll('avg', X, 60)} AS sma60,
  greatest(high - low, abs(high - {lag(X)}), abs(low - {lag(X)})) AS tr, {roll('avg', 'volume', 20)} AS vol_ma20,
  {X} * volume AS dollar_volume, {X} / ({roll('max', 'high', 20, 1)}) - 1 AS breakout_dist_20,
  {roll('avg', X, 20)} AS bb_mid20, 2 * ({roll('stddev_samp', X, 20)}) AS sd2,
  count(*) OVER (PARTITION BY ticker) AS history FROM bars),
f2 AS (SELECT *, {X} / sma20 - 1 AS dist_sma20, {X} / sma60 - 1 AS dist_sma60, {roll('avg', 'tr', 14)} AS atr14,
  ({roll('avg', 'tr', 14)}) / {X} AS natr14, ({roll('stddev_samp', 'log_ret_1d', 20)}) * sqrt(252.0) AS realized_vol20,
  volume / vol_ma20 AS rvol20,
  (dollar_volume - ({roll('avg', 'dollar_volume', 20)})) / nullif({roll('stddev_samp', 'dollar_volume', 20)}, 0) AS dollar_volume_z20,
  bb_mid20 + sd2 AS bb_upper20, bb_mid20 - sd2 AS bb_lower20,
  2 * sd2 / nullif(bb_mid20, 0) AS bb_width20, ({X} - (bb_mid20 - sd2)) / nullif(2 * sd2, 0) AS bb_percent_b20
  FROM f1 WHERE history >= 20)"""
MARKET_SQL = """
md AS (SELECT date, avg(ret_1d) AS market_ret_1d, avg(CASE WHEN ret_1d > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS breadth_up_ratio,
  count(ret_1d) AS breadth_count FROM f1 WHERE ret_1d IS NOT NULL GROUP BY date),
mkt AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) > 5
    THEN product(1 + market_ret_1d) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 END AS market_ret_5d,
  CASE WHEN row_number() OVER (ORDER BY date) > 20
    THEN product(1 + market_ret_1d) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 END AS market_ret_20d FROM md)"""


def _z(c: str) -> str:
    return f"({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_pop({c}) OVER (PARTITION BY date), 0) AS z_{c}"


TIER1_SQL = f"""
tz AS (SELECT f2.*, market_ret_1d, breadth_up_ratio, breadth_count, market_ret_5d, market_ret_20d,
  ret_5d - market_ret_5d AS rel_strength_5d, ret_20d - market_ret_20d AS rel_strength_20d,
  CAST(coalesce(market_ret_20d > 0 AND breadth_up_ratio >= 0.5, false) AS INTEGER) AS risk_on_regime,
  {', '.join(_z(c) for c in tier1.Z_COLUMNS)} FROM f2 LEFT JOIN mkt USING (date)),
tier1 AS (SELECT *, round({' + '.join(f'({w}::DOUBLE) * coalesce({c}, 0)' for c, w in tier1.SCORE_WEIGHTS.items())}, 12) AS tier1_composite_score FROM tz)"""
TIER1 = [FEATURES_SQL, MARKET_SQL, TIER1_SQL]
PER_TICKER = """ret_1d ret_5d ret_20d log_ret_1d sma20 sma60 dist_sma20 dist_sma60 tr atr14 natr14 realized_vol20 vol_ma20
  rvol20 dollar_volume dollar_volume_z20 breakout_dist_20 bb_mid20 bb_upper20 bb_lower20 bb_width20 bb_percent_b20"""
# index returns over noise span many orders of magnitude: compare their logarithm
LOG_INDEX = "ln(1 + market_ret_5d)"


@QUERIES.add(
    "market_context",
    query(
        f"""SELECT date, {rs('market_ret_1d breadth_up_ratio')}, breadth_count, {r(LOG_INDEX, 'ln_market_5d')},
        {r('ln(1 + market_ret_20d)', 'ln_market_20d')} FROM mkt""",
        FEATURES_SQL,
        MARKET_SQL,
    ),
)
def market_context(t: Tables):
    days = cross_section.market_days(returns(t.bars.select("ticker", "date", "adj_close"), "adj_close"))
    return rounded(
        days.select(
            "date", "market_ret_1d", "breadth_up_ratio", "breadth_count",
            F.log1p("market_ret_5d").alias("ln_market_5d"), F.log1p("market_ret_20d").alias("ln_market_20d"),
        )
    )


@QUERIES.add(
    "cross_section_z",
    query(f"SELECT ticker, date, {rs(' '.join('z_' + c for c in tier1.Z_COLUMNS))} FROM tier1", *TIER1),
)
def cross_section_z(t: Tables):
    features = tier1.symbol_features(t.bars)
    out = cross_section.add_date_context(features, tier1.Z_COLUMNS)
    return rounded(out.select("ticker", "date", *[f"z_{c}" for c in tier1.Z_COLUMNS]))


@QUERIES.add(
    "tier1_features",
    query(
        f"""SELECT ticker, date, {rs('close')}, volume, {rs(PER_TICKER)}, {rs('market_ret_1d breadth_up_ratio')}, breadth_count,
        risk_on_regime, {rs(' '.join('z_' + c for c in tier1.Z_COLUMNS))}, {rs('tier1_composite_score')} FROM tier1""",
        *TIER1,
    ),
)
def tier1_features(t: Tables):
    out = tier1.tier1_features(t.bars, written=False)
    return rounded(
        out.drop("open", "high", "low", "adj_close", "market_ret_5d", "market_ret_20d", "rel_strength_5d", "rel_strength_20d")
    )


# over noise the index returns are huge: strength is compared in shares of them
RELATIVE = {k: f"rel_strength_{k}d / (1 + abs(market_ret_{k}d))" for k in (5, 20)}


@QUERIES.add(
    "tier1_relative_strength",
    query(
        f"""SELECT ticker, date, {r(LOG_INDEX, 'ln_market_5d')}, {r('ln(1 + market_ret_20d)', 'ln_market_20d')},
        {', '.join(r(x, f'strength_{k}d') for k, x in RELATIVE.items())} FROM tier1""",
        *TIER1,
    ),
)
def tier1_relative_strength(t: Tables):
    out = tier1.tier1_features(t.bars)
    index = [F.log1p(f"market_ret_{k}d").alias(f"ln_market_{k}d") for k in (5, 20)]
    return rounded(out.select("ticker", "date", *index, *[F.expr(x).alias(f"strength_{k}d") for k, x in RELATIVE.items()]))


CANDIDATE_ORDER = "tier1_composite_score DESC, ret_5d DESC, breakout_dist_20 DESC, ticker"
CANDIDATE_WHERE = f"""tier1_composite_score IS NOT NULL AND dollar_volume IS NOT NULL AND natr14 IS NOT NULL AND rvol20 IS NOT NULL
  AND breakout_dist_20 IS NOT NULL AND ret_5d IS NOT NULL AND ret_1d IS NOT NULL AND sma20 IS NOT NULL AND risk_on_regime = 1
  AND close > sma20 AND (sma60 IS NULL OR sma20 > sma60) AND dollar_volume >= {RULES.min_dollar_volume}
  AND natr14 <= {RULES.max_natr14} AND rvol20 BETWEEN {RULES.min_rvol20} AND {RULES.max_rvol20}
  AND breakout_dist_20 >= {RULES.min_breakout_dist_20} AND ret_5d >= {RULES.min_ret_5d} AND ret_1d <= {RULES.max_ret_1d}
  AND tier1_composite_score >= {RULES.min_tier1_score}"""
CANDIDATES_SQL = f"cand AS (SELECT * FROM tier1 WHERE {CANDIDATE_WHERE})"
CAND_COLUMNS = ["close", "tier1_composite_score", "ret_1d", "ret_5d", "breakout_dist_20", "rvol20", "natr14", "dollar_volume"]


@QUERIES.add(
    "tier1_candidates",
    query(
        f"""SELECT CAST(row_number() OVER (PARTITION BY date ORDER BY {CANDIDATE_ORDER}) AS INTEGER) AS candidate_rank,
        ticker, date, {rs(CAND_COLUMNS)} FROM cand""",
        *TIER1,
        CANDIDATES_SQL,
    ),
)
def tier1_candidates(t: Tables):
    out = tier1.buy_candidates(tier1.tier1_features(t.bars), RULES, per_date=True)
    return rounded(out.select("candidate_rank", "ticker", "date", *CAND_COLUMNS))


@QUERIES.add(
    "tier1_latest_candidates",
    query(
        f"""SELECT CAST(row_number() OVER (ORDER BY {CANDIDATE_ORDER}) AS INTEGER) AS candidate_rank, ticker, date,
        {rs(CAND_COLUMNS)} FROM (SELECT * FROM tier1 QUALIFY row_number() OVER ({W} DESC) = 1) WHERE {CANDIDATE_WHERE.replace('AND risk_on_regime = 1', '')}""",
        *TIER1,
    ),
)
def tier1_latest_candidates(t: Tables):
    rules = tier1.CandidateRules(**{**RULES.__dict__, "allow_risk_off": True})
    out = tier1.buy_candidates(tier1.tier1_latest(tier1.tier1_features(t.bars)), rules)
    return rounded(out.select(F.col("candidate_rank").cast("int"), "ticker", "date", *CAND_COLUMNS))


@QUERIES.add(
    "tier1_latest",
    query(
        f"""SELECT ticker, date, {rs('close tier1_composite_score ret_5d breakout_dist_20 rvol20')} FROM tier1
        QUALIFY row_number() OVER ({W} DESC) = 1""",
        *TIER1,
    ),
)
def tier1_latest(t: Tables):
    out = tier1.tier1_latest(tier1.tier1_features(t.bars))
    return rounded(out.select("ticker", "date", "close", "tier1_composite_score", "ret_5d", "breakout_dist_20", "rvol20"))


@QUERIES.add(
    "tier1_summary",
    query(
        """SELECT (SELECT count(DISTINCT ticker) FROM tier1) AS usable_tickers, (SELECT count(*) FROM tier1) AS feature_rows,
        (SELECT strftime(max(date), '%Y-%m-%d') FROM tier1) AS latest_date, (SELECT count(*) FROM cand) AS candidate_count,
        (SELECT string_agg(ticker, ',' ORDER BY tier1_composite_score DESC, ticker) FROM (SELECT * FROM tier1
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1
          ORDER BY tier1_composite_score DESC, ticker LIMIT 5)) AS top_tickers""",
        *TIER1,
        CANDIDATES_SQL,
    ),
)
def tier1_summary(t: Tables):
    features = tier1.tier1_features(t.bars, only=tier1.CANDIDATE_FEATURES, written=False)
    features = staged(features.select(*tier1.SUMMARY_COLUMNS))
    candidates = tier1.buy_candidates(features, RULES, per_date=True)
    out = tier1.tier1_summary(features, candidates, RULES, 5)
    names = F.concat_ws(",", F.col("top_tickers.ticker"))
    return out.select("usable_tickers", "feature_rows", "latest_date", "candidate_count", names.alias("top_tickers"))


# --- next-day signal -------------------------------------------------------------

LOOKBACK = 400


def _part(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE 0 END"


SIGNAL_SQL = f"""
sg AS (SELECT * FROM (SELECT ticker, date AS trade_date, close,
  (close / nullif({lag('close')}, 0) - 1) * 100 AS ret_1d, (close / nullif({lag('close', 5)}, 0) - 1) * 100 AS ret_5d,
  (close / nullif({lag('close', 20)}, 0) - 1) * 100 AS ret_20d, avg(close) OVER {frame(20)} AS sma20,
  avg(close) OVER {frame(60)} AS sma60, avg(close) OVER {frame(120)} AS sma120,
  volume / nullif(avg(volume) OVER {frame(20)}, 0) AS volume_ratio_20d, close / nullif(max(high) OVER {frame(20)}, 0) AS breakout_ratio_20d,
  row_number() OVER ({W} DESC) AS rn
  FROM bars WHERE regexp_matches(ticker, '^[0-9]{{6}}[.](KS|KQ)$') AND date >= (SELECT max(date) FROM bars) - INTERVAL {LOOKBACK} DAY)
  WHERE rn = 1 AND ret_1d IS NOT NULL AND ret_5d IS NOT NULL AND ret_20d IS NOT NULL),
sc AS (SELECT *, {_part('close > sma20', '15')} + {_part('close > sma60', '12')} + {_part('sma20 > sma60', '10')}
  + {_part('sma60 > sma120', '8')} + {_part('ret_20d > 0', 'least(15, ret_20d * 0.8::DOUBLE)')} + {_part('ret_5d > 0', 'least(10, ret_5d * 1.2::DOUBLE)')}
  + CASE WHEN volume_ratio_20d BETWEEN 1.2 AND 3.5 THEN 10 WHEN volume_ratio_20d > 3.5 THEN 5 ELSE 0 END
  + {_part('breakout_ratio_20d >= 0.995', '10')} - {_part('ret_1d >= 8', '8')} AS raw,
  concat_ws(',', CASE WHEN close > sma20 THEN 'close>sma20' END, CASE WHEN close > sma60 THEN 'close>sma60' END,
    CASE WHEN sma20 > sma60 THEN 'sma20>sma60' END, CASE WHEN sma60 > sma120 THEN 'sma60>sma120' END,
    CASE WHEN ret_20d > 0 THEN '20d_momentum' END, CASE WHEN ret_5d > 0 THEN '5d_momentum' END,
    CASE WHEN volume_ratio_20d BETWEEN 1.2 AND 3.5 THEN 'volume_spike' WHEN volume_ratio_20d > 3.5 THEN 'high_volume' END,
    CASE WHEN breakout_ratio_20d >= 0.995 THEN 'near_20d_high' END, CASE WHEN ret_1d >= 8 THEN 'overheated_1d' END) AS reason FROM sg),
signal AS (SELECT *, round(raw, 2) AS score, round(greatest(5, least(95, 28 + raw * 0.72::DOUBLE)), 2) AS probability_next_up FROM sc)"""
SIGNAL_COLUMNS = "close ret_1d ret_5d ret_20d sma20 sma60 sma120 volume_ratio_20d breakout_ratio_20d score probability_next_up"


@QUERIES.add(
    "next_day_signal",
    query(
        f"""SELECT CAST(row_number() OVER (ORDER BY probability_next_up DESC, score DESC, ret_20d DESC, ticker) AS INTEGER) AS rank,
        ticker, trade_date, {rs(SIGNAL_COLUMNS)}, reason FROM signal""",
        SIGNAL_SQL,
    ),
)
def next_day_signal(t: Tables):
    return rounded(next_day.next_day_signal(t.bars, LOOKBACK))


# --- ranks, quantiles, model -----------------------------------------------------


def _pct(x: str, name: str) -> str:
    """Average-tie percent rank inside a date, nulls lowest."""
    key = f"coalesce({x}, '-inf'::DOUBLE)"
    return (
        f"(rank() OVER (PARTITION BY date ORDER BY {key}) + (count(*) OVER (PARTITION BY date, {key}) - 1) / 2.0::DOUBLE)"
        f" / count(*) OVER (PARTITION BY date) AS {name}"
    )


DAY_SQL = f"""dy AS (SELECT *, close * volume AS trading_value, CASE WHEN {lag('close')} > 0 THEN close / {lag('close')} - 1 END AS ret_1d FROM bars)"""


@QUERIES.add(
    "pct_rank_daily",
    query(
        f"SELECT ticker, date, {rs('turnover_rank_pct ret1d_rank_pct')} FROM"
        f" (SELECT *, {_pct('trading_value', 'turnover_rank_pct')}, {_pct('ret_1d', 'ret1d_rank_pct')} FROM dy)",
        DAY_SQL,
    ),
)
def pct_rank_daily(t: Tables):
    rows = returns(t.bars.select("ticker", "date", "close", "volume")).withColumn(
        "trading_value", F.col("close") * F.col("volume")
    )
    ranked = ranking.percent_ranks(
        rows, ["date"], {"turnover_rank_pct": "trading_value", "ret1d_rank_pct": "ret_1d"}, nulls="lowest"
    )
    return rounded(ranked.select("ticker", "date", "turnover_rank_pct", "ret1d_rank_pct"))


LABELS_SQL = f"lab AS (SELECT *, lead(close) OVER ({W}) AS next_close FROM f2)"
STEPS = "[" + ", ".join(f"{i / 20}::DOUBLE" for i in range(21)) + "]"


def _long(source: str, extra: str) -> str:
    parts = [f"SELECT {extra}, '{c}' AS feature, {c} AS x FROM {source}" for c in MODEL.features]
    return " UNION ALL ".join(parts)


def _fit_sql(prefix: str, rows: str, key: str) -> list[str]:
    """CTEs for the mapper fit, grouped by ``key`` columns plus the feature."""
    k = f"{key}, feature"
    return [
        f"{prefix}_ed AS (SELECT {k}, list_sort(list_distinct(quantile_cont(x, {STEPS}))) AS edges, count(*) AS n, avg(y) AS base"
        f" FROM {rows} WHERE x IS NOT NULL GROUP BY {k})",
        f"{prefix}_in AS (SELECT {k}, base, edges[2:len(edges) - 1] AS inner_edges FROM {prefix}_ed WHERE n >= 600 AND len(edges) >= 4)",
        f"{prefix}_bn AS (SELECT {k}, len(list_filter(e.inner_edges, lambda q: q <= l.x)) AS bin, count(*) AS cnt, sum(y) AS ups"
        f" FROM {rows} l JOIN {prefix}_in e USING ({k}) WHERE x IS NOT NULL GROUP BY {k}, bin)",
        f"{prefix}_pr AS (SELECT {k}, bin, cnt, least(greatest((ups + 120 * base) / (cnt + 120), 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS prob"
        f" FROM {prefix}_bn JOIN {prefix}_in USING ({k}))",
    ]


FIT = [
    FEATURES_SQL,
    LABELS_SQL,
    f"tr AS (SELECT *, CAST(next_close > close AS INTEGER) AS y FROM lab WHERE next_close IS NOT NULL AND close > 0)",
    f"tl AS ({_long('tr', '0 AS g, y')})",
    *_fit_sql("m", "tl", "g"),
]
ALL_ROWS = f"al AS ({_long('f2', 'ticker, date')})"
WEIGHT_VALUES = ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in zip(MODEL.features, MODEL.weights))


def _score_sql(name: str = "prob_up_next_day") -> list[str]:
    """Long form probabilities per row, summed in feature order."""
    pieces = " + ".join(f"{w}::DOUBLE * max(CASE WHEN feature = '{f}' THEN p END)" for f, w in zip(MODEL.features, MODEL.weights))
    return [
        ALL_ROWS,
        """pl AS (SELECT a.ticker, a.date, a.feature, CASE WHEN a.x IS NULL THEN e.base ELSE p.prob END AS p FROM al a JOIN m_in e USING (feature)
        LEFT JOIN m_pr p ON p.feature = a.feature AND p.bin = len(list_filter(e.inner_edges, lambda q: q <= a.x)))""",
        f"ps AS (SELECT ticker, date, least(greatest({pieces}, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS {name} FROM pl GROUP BY ticker, date)",
    ]


def _train(t: Tables):
    columns = ["ticker", "date", "close", "high", "volume", *MODEL.features]
    return tier1.symbol_features(t.bars, MODEL.features).select(*columns)


@QUERIES.add(
    "quantile_edges",
    query(
        f"SELECT feature, i AS edge_no, {r('edges[i]', 'edge')} FROM (SELECT feature, edges, unnest(range(1, len(edges) + 1)) AS i FROM m_ed)",
        *FIT,
    ),
)
def quantile_edges_query(t: Tables):
    labelled = staged(next_day_labels(_train(t)))
    edges = quantile_edges(labelled, list(MODEL.features))
    return rounded(
        edges.select("feature", F.posexplode("edges").alias("i", "edge")).select(
            "feature", (F.col("i") + 1).cast("long").alias("edge_no"), "edge"
        )
    )


@QUERIES.add(
    "prob_mapper",
    query(f"SELECT feature, bin, {r('prob', 'prob')}, {r('base', 'base')} FROM m_pr JOIN m_in USING (g, feature)", *FIT),
)
def prob_mapper(t: Tables):
    labelled = staged(next_day_labels(_train(t)))
    mappers = fit_mappers(labelled, list(MODEL.features), "target_up")[0]
    table = mappers_frame(t.spark, mappers).select("feature", F.posexplode("probs").alias("bin", "prob"), "base")
    return rounded(table.withColumn("bin", F.col("bin").cast("long")))


@QUERIES.add("prob_apply", query(f"SELECT ticker, date, {rs('prob_up_next_day')} FROM ps", *FIT, *_score_sql()))
def prob_apply(t: Tables):
    table = staged(with_neighbours(_train(t)))
    mappers = fit_mappers(next_day_labels(table), list(MODEL.features), "target_up")[0]
    return rounded(table.select("ticker", "date", model_score(MODEL, mappers).alias("prob_up_next_day")))


@QUERIES.add(
    "ai_score",
    query(
        """SELECT ticker, date, CASE WHEN hi <= lo THEN 85 ELSE CAST(round_even(least(greatest(70 + (prob_up_next_day - lo) / (hi - lo) * 29, 0), 99), 0)
        AS INTEGER) END AS ai_score FROM ps, (SELECT min(prob_up_next_day) AS lo, max(prob_up_next_day) AS hi FROM ps)""",
        *FIT,
        *_score_sql(),
    ),
)
def ai_score(t: Tables):
    return daily_top.score_days(staged(with_neighbours(_train(t))), MODEL).select("ticker", "date", "ai_score")


PEAKS_SQL = """(SELECT max(b.high) FROM bars b WHERE b.ticker = p.ticker AND b.date > p.date)"""
TOP_SQL = [
    *FIT,
    *_score_sql(),
    DAY_SQL,
    f"""rk AS (SELECT dy.ticker, dy.date, dy.close, trading_value, dy.ret_1d, prob_up_next_day, {_pct('trading_value', 'turnover_rank_pct')},
    {_pct('dy.ret_1d', 'ret1d_rank_pct')}, {_pct('prob_up_next_day', 'model_rank_pct')} FROM dy JOIN ps USING (ticker, date))""",
    """fs AS (SELECT *, 0.45::DOUBLE * turnover_rank_pct AS score_turnover, 0.35::DOUBLE * ret1d_rank_pct AS score_ret1d, 0.2::DOUBLE * model_rank_pct AS score_model,
    CAST(round_even(least(greatest(70 + (prob_up_next_day - min(prob_up_next_day) OVER ()) / (max(prob_up_next_day) OVER () - min(prob_up_next_day) OVER ()) * 29, 0), 99), 0) AS INTEGER) AS ai_score FROM rk)""",
    """tp AS (SELECT *, score_turnover + score_ret1d + score_model AS final_score, CAST(row_number() OVER (PARTITION BY date
    ORDER BY score_turnover + score_ret1d + score_model DESC, prob_up_next_day DESC, ticker) AS INTEGER) AS rank FROM fs QUALIFY rank <= 5)""",
    """pk AS (SELECT ticker, date, max(struct_pack(h := bh, d := -bd)) AS best FROM (SELECT p.ticker, p.date, b.high AS bh, date_diff('day', DATE '1970-01-01', b.date) AS bd
    FROM tp p JOIN bars b ON b.ticker = p.ticker AND b.date > p.date) GROUP BY ticker, date)""",
]
TOP_COLUMNS = """close trading_value ret_1d prob_up_next_day turnover_rank_pct ret1d_rank_pct model_rank_pct score_turnover score_ret1d
  score_model final_score"""


@QUERIES.add(
    "daily_top_n",
    query(
        f"""SELECT strftime(tp.date, '%Y-%m-%d') AS date, rank, tp.ticker, coalesce(nullif(trim(name_ko), ''), tp.ticker) AS name, {rs(TOP_COLUMNS)}, ai_score,
        {r('best.h / close - 1', 'max_return_since_buy')},
        coalesce(strftime(DATE '1970-01-01' + CAST(-best.d AS INTEGER), '%Y-%m-%d'), '') AS max_return_peak_date
        FROM tp LEFT JOIN pk ON pk.ticker = tp.ticker AND pk.date = tp.date LEFT JOIN master ON master.symbol = tp.ticker""",
        MASTER,
        *TOP_SQL,
    ),
)
def daily_top_n(t: Tables):
    return rounded(daily_top.daily_top_n(_train(t), MODEL, t.master))


@QUERIES.add(
    "predict_latest",
    query(
        f"""SELECT date, ticker, {r('close', 'close')}, {rs('prob_up_next_day')},
        CAST(row_number() OVER (ORDER BY prob_up_next_day DESC, ticker) AS INTEGER) AS rank FROM ps JOIN bars USING (ticker, date)
        WHERE date = (SELECT max(date) FROM bars) QUALIFY rank <= 25""",
        *FIT,
        *_score_sql(),
    ),
)
def predict_latest(t: Tables):
    return rounded(daily_top.predict_latest(_train(t), MODEL))


@QUERIES.add(
    "future_max_high",
    query(
        f"SELECT ticker, date, {r(f'max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)', 'peak_high')} FROM bars"
    ),
)
def future_max_high(t: Tables):
    return rounded(daily_top.future_peaks(t.bars).drop("peak_date"))


@QUERIES.add(
    "max_return_since_buy",
    query(
        f"""SELECT p.ticker, p.date, {r('best.h / close - 1', 'max_return_since_buy')},
        coalesce(strftime(DATE '1970-01-01' + CAST(-best.d AS INTEGER), '%Y-%m-%d'), '') AS max_return_peak_date FROM picks p LEFT JOIN pk USING (ticker, date)""",
        "picks AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) <= 3)",
        """pk AS (SELECT ticker, date, max(struct_pack(h := bh, d := -bd)) AS best FROM (SELECT p.ticker, p.date, b.high AS bh,
        date_diff('day', DATE '1970-01-01', b.date) AS bd FROM picks p JOIN bars b ON b.ticker = p.ticker AND b.date > p.date) GROUP BY ticker, date)""",
    ),
)
def max_return_since_buy(t: Tables):
    table = staged(t.bars.select("ticker", "date", "close", "high"))
    picks = ranking.top_per_group(table, ["date"], [F.col("close").desc(), F.col("ticker")], 3).drop("rank", "high")
    out = daily_top.add_max_return_since_buy(picks, table)
    return rounded(out.drop("close"))


# --- walk-forward ------------------------------------------------------------------

FOLD_SQL = """
dts AS (SELECT list_sort(list(DISTINCT date)) AS days, count(DISTINCT date) AS n FROM lb),
folds AS (SELECT fold, days[train_i] AS train_end, days[val_i] AS val_end FROM (SELECT fold, days, CAST(floor(n * t) AS INTEGER) AS train_i,
  least(CAST(n AS INTEGER) - 1, CAST(floor(n * v) AS INTEGER)) AS val_i FROM dts, (VALUES (1, 0.55::DOUBLE, 0.55::DOUBLE + 0.1::DOUBLE),
  (2, 0.65::DOUBLE, 0.65::DOUBLE + 0.1::DOUBLE), (3, 0.75::DOUBLE, 0.75::DOUBLE + 0.1::DOUBLE), (4, 0.85::DOUBLE, 0.85::DOUBLE + 0.1::DOUBLE)) p(fold, t, v)
  WHERE n >= 400) WHERE train_i >= 120 AND val_i > train_i)"""
LB = f"lb AS (SELECT * FROM (SELECT *, lead(close) OVER ({W}) AS next_close FROM bars) WHERE next_close IS NOT NULL AND close > 0)"


@QUERIES.add("fold_plan", query("SELECT CAST(fold AS INTEGER) AS fold, train_end, val_end FROM folds", LB, FOLD_SQL))
def fold_plan(t: Tables):
    return walk_forward.fold_plan(next_day_labels(t.bars.select("ticker", "date", "close")))


def _wf(t: Tables) -> walk_forward.WalkForward:
    return walk_forward.WalkForward(_train(t), list(MODEL.features), min_train_rows=2000, min_val_rows=200)


def _candidates(t: Tables):
    return t.spark.createDataFrame(CANDIDATES, "candidate_id long, features array<string>, weights array<double>")


MIN_ROWS = {"min_train_rows": 34_000, "min_val_rows": 200}


@QUERIES.add(
    "fold_report",
    query(
        f"""SELECT CAST(fold AS INTEGER) AS fold, train_end, val_end, train_rows, val_rows, {r('train_up / train_rows', 'train_base_rate')},
        {r('val_up / val_rows', 'val_base_rate')}, CASE WHEN train_rows < {MIN_ROWS["min_train_rows"]} THEN 'few_train_rows'
        WHEN val_rows < {MIN_ROWS["min_val_rows"]} THEN 'few_validation_rows' END AS dropped
        FROM (SELECT fold, train_end, val_end, CAST(count_if(date <= train_end) AS BIGINT) AS train_rows, CAST(count_if(date > train_end AND date <= val_end) AS BIGINT) AS val_rows,
          count_if(date <= train_end AND next_close > close) AS train_up, count_if(date > train_end AND date <= val_end AND next_close > close) AS val_up
          FROM folds, lb GROUP BY fold, train_end, val_end)""",
        LB,
        FOLD_SQL,
    ),
)
def fold_report(t: Tables):
    days = walk_forward.day_counts(next_day_labels(t.bars.select("ticker", "date", "close")), "target_up")
    return rounded(walk_forward.fold_report(days, **MIN_ROWS))


def _candidate_sql() -> str:
    parts = []
    for cid, features, weights in CANDIDATES:
        total = " + ".join(f"{w}::DOUBLE * max(CASE WHEN feature = '{f}' THEN p END)" for f, w in zip(features, weights))
        parts.append(
            f"SELECT {cid}::BIGINT AS candidate_id, fold, ticker, date, y, least(greatest({total}, 1e-4::DOUBLE), 1 - 1e-4::DOUBLE) AS p"
            " FROM fp GROUP BY fold, ticker, date, y"
        )
    return " UNION ALL ".join(parts)


WALK_SQL = [
    FEATURES_SQL,
    LABELS_SQL,
    "lb AS (SELECT *, CAST(next_close > close AS INTEGER) AS y FROM lab WHERE next_close IS NOT NULL AND close > 0)",
    FOLD_SQL,
    f"ll AS ({_long('lb', 'ticker, date, y')})",
    "tl AS (SELECT fold, feature, x, y FROM ll JOIN folds ON date <= train_end)",
    *_fit_sql("m", "tl", "fold"),
    """fp AS (SELECT f.fold, a.ticker, a.date, a.y, a.feature, CASE WHEN a.x IS NULL THEN e.base ELSE p.prob END AS p
    FROM ll a JOIN folds f ON a.date > f.train_end AND a.date <= f.val_end JOIN m_in e ON e.fold = f.fold AND e.feature = a.feature
    LEFT JOIN m_pr p ON p.fold = f.fold AND p.feature = a.feature AND p.bin = len(list_filter(e.inner_edges, lambda q: q <= a.x)))""",
    f"cs AS ({_candidate_sql()})",
    """th AS (SELECT candidate_id, fold, p AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, fold ORDER BY p DESC) AS k,
    greatest(1, CAST(floor(count(*) OVER (PARTITION BY candidate_id, fold) * 0.1::DOUBLE) AS BIGINT)) AS top_k FROM cs) WHERE k = top_k)""",
    """fm AS (SELECT candidate_id, fold, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss, avg(y) AS base_rate,
    avg(CASE WHEN p >= threshold THEN y END) AS top_hit FROM cs JOIN th USING (candidate_id, fold) GROUP BY candidate_id, fold)""",
    """fc AS (SELECT *, CASE WHEN base_rate > 0 THEN top_hit / base_rate ELSE 1 END AS lift,
    top_hit + 0.4::DOUBLE * (CASE WHEN base_rate > 0 THEN top_hit / base_rate ELSE 1 END) - 0.8::DOUBLE * brier - 0.2::DOUBLE * logloss AS fold_score FROM fm)""",
]


@QUERIES.add(
    "fold_metrics",
    query(
        f"SELECT candidate_id, CAST(fold AS INTEGER) AS fold, {rs('brier logloss base_rate top_hit lift fold_score')} FROM fc",
        *WALK_SQL,
    ),
)
def fold_metrics(t: Tables):
    return rounded(_wf(t).fold_metrics(_candidates(t)))


@QUERIES.add(
    "walk_forward_eval",
    query(
        f"""SELECT candidate_id, {r('avg(fold_score)', 'score_mean')}, {r('stddev_pop(fold_score)', 'score_std')}, {r('avg(top_hit)', 'top_hit_mean')},
        {r('avg(lift)', 'lift_mean')}, {r('avg(brier)', 'brier_mean')}, {r('avg(logloss)', 'logloss_mean')},
        {r('avg(fold_score) - 0.25::DOUBLE * stddev_pop(fold_score)', 'score')} FROM fc GROUP BY candidate_id""",
        *WALK_SQL,
    ),
)
def walk_forward_eval(t: Tables):
    return rounded(walk_forward.best_candidates(_wf(t).evaluate(_candidates(t))))


# --- variance report ------------------------------------------------------------------


def _all_pct(x: str, name: str) -> str:
    return (
        f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER () AS {name}"
    )


def _bucket_sql(name: str) -> str:
    column, bounds, labels = variance.BUCKETS[name]
    arms = " ".join(f"WHEN {column} <= {b} THEN '{lab}'" for b, lab in zip(bounds, labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END AS {name}"


FOUR = "momentum_pct breakout_pct volume_pct volatility_pct".split()
MEAN4 = "(" + " + ".join(FOUR) + ") / 4"
VARIANCE_SQL = [
    *TIER1,
    CANDIDATES_SQL,
    f"""v1 AS (SELECT *, {_all_pct('ret_5d', 'momentum_pct')}, {_all_pct('breakout_dist_20', 'breakout_pct')},
    {_all_pct('greatest(rvol20, 0)', 'volume_pct')}, {_all_pct('-natr14', 'volatility_pct')}, {_all_pct('tier1_composite_score', 'composite_pct')} FROM cand)""",
    f"""v2 AS (SELECT *, {' + '.join(f'{c} * {w}::DOUBLE' for c, w in variance.QUALITY_WEIGHTS.items())} AS quality_raw,
    sqrt(({' + '.join(f'({c} - {MEAN4}) * ({c} - {MEAN4})' for c in FOUR)}) / 4) AS factor_dispersion FROM v1)""",
    f"v3 AS (SELECT *, {_all_pct('round(factor_dispersion, 12)', 'dp')} FROM v2)",
    "v4 AS (SELECT *, round_even(quality_raw * 100 * 10, 0) / 10 AS quality_score, round_even((1 - dp) * 100 * 10, 0) / 10 AS stability_score FROM v3)",
    f"""vs AS (SELECT *, round_even((quality_score * 0.72::DOUBLE + stability_score * 0.28::DOUBLE) * 10, 0) / 10 AS final_score,
    {', '.join(_bucket_sql(b) for b in variance.BUCKETS)} FROM v4)""",
]
SCORE_COLUMNS = "momentum_pct breakout_pct volume_pct volatility_pct composite_pct quality_score stability_score final_score"


def _scores(t: Tables):
    features = tier1.tier1_features(t.bars, only=tier1.CANDIDATE_FEATURES)
    candidates = tier1.buy_candidates(features, RULES, per_date=True)
    columns = ["candidate_rank", "ticker", "date", *CAND_COLUMNS]
    return variance.variance_scores(staged(candidates.select(*columns)))


@QUERIES.add(
    "variance_scores",
    query(f"SELECT ticker, date, {rs(SCORE_COLUMNS)}, {', '.join(variance.BUCKETS)} FROM vs", *VARIANCE_SQL),
)
def variance_scores(t: Tables):
    return rounded(_scores(t).select("ticker", "date", *SCORE_COLUMNS.split(), *variance.BUCKETS))


@QUERIES.add(
    "variance_buckets",
    query(
        f"""SELECT momentum_bucket, volume_bucket, count(*) AS count, {r('avg(final_score)', 'avg_final')}, {r('avg(ret_5d)', 'avg_ret5d')}
        FROM vs GROUP BY ALL""",
        *VARIANCE_SQL,
    ),
)
def variance_buckets(t: Tables):
    return rounded(variance.variance_buckets(_scores(t)))


MEANS = "ret_1d ret_5d rvol20 breakout_dist_20 natr14".split()


@QUERIES.add(
    "variance_summary",
    query(
        f"""SELECT count(*) AS rows, {r('min(final_score)', 'score_min')}, {r('max(final_score)', 'score_max')}, {r('avg(final_score)', 'score_mean')},
        {r('median(final_score)', 'score_median')}, {', '.join(r(f'avg({c})', f'mean_{c}') for c in MEANS)} FROM vs""",
        *VARIANCE_SQL,
    ),
)
def variance_summary(t: Tables):
    return rounded(variance.variance_summary(_scores(t)))
