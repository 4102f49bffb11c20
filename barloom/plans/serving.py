"""Read side: rankings, search, market board and the two recommendation payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import band_score, clamp, half_up, half_up_at, to_number
from barloom.functions.symbols import checked_day, country_of, currency_of, day_part, iso_day, market_label
from barloom.functions.texts import (
    CANDIDATE_REASON,
    DAILY_REASON,
    eok,
    fill,
    fixed,
    known,
    language,
    signed_percent,
    times,
    top_band,
)
from barloom.operators.ranking import number_rows
from barloom.plans.daily_top import with_names

# Win-rate proxy on the 70-99 band.
WIN_BASE, WIN_SPAN, WIN_TOP = 55.0, 40.0, 95.0


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of several column spellings that the frame has, by value."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


# --- rankings from the candidate snapshot -------------------------------------------


def _candidate_order() -> list[Column]:
    return [
        F.col("candidate_rank").asc_nulls_last(),
        F.col("tier1_composite_score").desc_nulls_last(),
        F.col("ticker").asc(),
    ]


def _summary_columns(candidates: DataFrame) -> DataFrame:
    score = F.col("tier1_composite_score")
    # one subquery for both ends
    ends = candidates.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
    band = band_score(score, ends["low"], ends["high"], "up")
    win = clamp(WIN_BASE + (band - 70.0) / 29.0 * WIN_SPAN, WIN_BASE, WIN_TOP)
    source = F.coalesce("ret_5d", "ret_1d")
    return candidates.select(
        "ticker",
        F.nullif(day_part(F.col("date").cast("string")), F.lit("")).alias("ranking_date"),
        half_up_at(win, 1).alias("win_rate"),
        half_up_at(source * 100.0, 1).alias("avg_return"),
        band.alias("confluence_score"),
        "candidate_rank",
        "tier1_composite_score",
    )


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Every candidate with its position and the derived display numbers."""
    numbered = number_rows(_summary_columns(candidates), _candidate_order(), "rank")
    # one row per ticker
    return numbered.withColumn("rank", F.col("rank").cast("int")).drop("candidate_rank", "tier1_composite_score")


def home_rankings(candidates: DataFrame, master: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` candidates; missing numbers show as zero."""
    # cut first (a distributed top-k), then number the few rows that are left
    top = _summary_columns(candidates).orderBy(*_candidate_order()).limit(max(0, limit))
    numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(*_candidate_order())))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("win_rate", "avg_return", "confluence_score")]
    return with_names(numbered, master).select("rank", *zero, "ticker", "name")


# --- symbol search -----------------------------------------------------------------


def resolve_symbols(inputs: DataFrame, master: DataFrame, bars: DataFrame) -> DataFrame:
    """(input, symbol): exact master match, then .KS, .KQ in the master, then the same in the bars, else as typed.

    Alternatives are tried as rows: each input explodes into its few
    candidates, which meet the known symbols by an equi-join, and the
    best-placed hit wins.
    """
    typed = inputs.select(F.upper(F.trim("symbol")).alias("input")).where(F.col("input") != "").distinct()
    known_symbols = (
        master.select(F.upper("symbol").alias("cand"), F.lit("master").alias("source"))
        .unionByName(bars.select(F.col("ticker").alias("cand"), F.lit("bars").alias("source")))
        .distinct()
    )
    x = F.col("input")
    ks, kq = F.concat(x, F.lit(".KS")), F.concat(x, F.lit(".KQ"))
    bare = ~x.contains(".")
    tries = [(x, "master", F.lit(True)), (ks, "master", bare), (kq, "master", bare)]
    tries += [(ks, "bars", bare), (kq, "bars", bare), (x, "bars", bare)]
    options = F.array(
        *[
            F.when(ok, F.struct(F.lit(i).alias("place"), cand.alias("cand"), F.lit(src).alias("source")))
            for i, (cand, src, ok) in enumerate(tries)
        ]
    )
    offered = typed.select("input", F.explode(F.array_compact(options)).alias("o")).select("input", "o.*")
    hits = offered.join(known_symbols, ["cand", "source"], "left_semi")
    best = hits.groupBy("input").agg(F.min_by("cand", "place").alias("hit"))
    return typed.join(best, "input", "left").select("input", F.coalesce("hit", "input").alias("symbol"))


def symbol_search(inputs: DataFrame, candidates: DataFrame, master: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per known input: name, market, ranking and newest date; unknown symbols give no row."""
    resolved = resolve_symbols(inputs, master, bars)
    summary = candidate_summary(candidates).withColumnRenamed("ticker", "symbol")
    details = master.select(F.upper("symbol").alias("symbol"), F.col("name_ko").alias("_name"), F.col("market").alias("sector"))
    newest = bars.groupBy(F.col("ticker").alias("symbol")).agg(F.date_format(F.max("date"), "yyyy-MM-dd").alias("_last"))
    joined = (
        resolved.join(summary.withColumn("_ranked", F.lit(True)), "symbol", "left")
        .join(details.withColumn("_listed", F.lit(True)), "symbol", "left")
        .join(newest, "symbol", "left")
    )
    exists = F.col("_ranked").isNotNull() | F.col("_listed").isNotNull() | F.col("_last").isNotNull()
    return joined.where(exists).select(
        "input",
        F.col("symbol").alias("ticker"),
        F.coalesce("_name", "symbol").alias("name"),
        "sector",
        F.coalesce("ranking_date", "_last").alias("ranking_date"),
        "rank",
        "win_rate",
        "avg_return",
        "confluence_score",
    )


# --- market board ---------------------------------------------------------------------


def market_board(latest: DataFrame, master: DataFrame, market: str = "KR", limit: int = 6, offset: int = 0) -> DataFrame:
    """The most traded tickers of a market (missing volume last), one page of them."""
    rows = latest.where(country_of(F.col("ticker")) == market)
    page = rows.orderBy(F.coalesce(F.col("volume"), F.lit(-1)).desc(), "ticker").offset(offset).limit(limit)
    t = F.col("ticker")
    return with_names(page, master).select(
        "ticker",
        "name",
        "close",
        (F.col("ret_1d") * 100.0).alias("change_pct"),
        "volume",
        day_part(F.col("date").cast("string")).alias("trade_date"),
        country_of(t).alias("market"),
        currency_of(t).alias("currency"),
        market_label(t, "en").alias("exchange"),
    )


# --- daily payload -----------------------------------------------------------------------

# Column spellings accepted in a daily snapshot.
DAILY_ALIASES = {
    "rank": ("rank",),
    "close": ("Close", "close"),
    "trading_value": ("trading_value", "tradingValue"),
    "ret_1d": ("ret_1d", "ret1d"),
    "probability": ("prob_up_next_day", "probability"),
    "final_score": ("final_score", "finalScore"),
    "ai_score": ("ai_score", "aiScore"),
    "turnover_rank_pct": ("turnover_rank_pct", "turnoverRankPct"),
    "ret1d_rank_pct": ("ret1d_rank_pct", "ret1dRankPct"),
    "model_rank_pct": ("model_rank_pct", "modelRankPct"),
    "score_turnover": ("score_turnover", "scoreTurnover"),
    "score_ret1d": ("score_ret1d", "scoreRet1d"),
    "score_model": ("score_model", "scoreModel"),
    "max_return_since_buy": ("max_return_since_buy", "maxReturnSinceBuy"),
}


def daily_rows(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as typed records; rows without date, ticker, rank, price or probability are dropped."""
    day = first_of(snapshot, "Date", "date").cast("string")
    rows = snapshot.select(
        iso_day(day).alias("date"),
        F.upper(F.trim(first_of(snapshot, "Ticker", "ticker"))).alias("ticker"),
        F.trim(F.coalesce(first_of(snapshot, "name", "Name"), F.lit(""))).alias("name"),
        *[to_number(first_of(snapshot, *names)).alias(out) for out, names in DAILY_ALIASES.items()],
        iso_day(first_of(snapshot, "max_return_peak_date", "maxReturnPeakDate").cast("string")).alias("peak_date"),
    )
    return rows.where((F.col("date") != "") & (F.col("ticker") != "")).dropna(subset=["rank", "close", "probability"])


def _daily_reason(lang: str) -> Column:
    c = F.col
    values = {
        "turnover": eok(c("trading_value"), lang),
        "turnover_top": top_band(c("turnover_rank_pct")),
        "ret1d": signed_percent(c("ret_1d"), 2, True),
        "ret1d_top": top_band(c("ret1d_rank_pct")),
        "model_top": top_band(c("model_rank_pct")),
        "score": known(fixed(c("final_score"), 3)),
        "score_turnover": known(fixed(c("score_turnover"), 3)),
        "score_ret1d": known(fixed(c("score_ret1d"), 3)),
        "score_model": known(fixed(c("score_model"), 3)),
        "max_return": signed_percent(c("max_return_since_buy"), 2, True),
        "peak": F.coalesce(F.nullif(c("peak_date"), F.lit("")), F.lit("-")),
    }
    return fill(DAILY_REASON[lang], values)


def daily_items(
    snapshot: DataFrame,
    lang: str | None = None,
    start: str | None = None,
    end: str | None = None,
    per_day: int = 5,
) -> DataFrame:
    """The first ``per_day`` picks of each day as display records (flat rows)."""
    lang = language(lang)
    rows = daily_rows(snapshot)
    low, high = checked_day(start), checked_day(end)
    if low is not None:
        rows = rows.where(F.col("date") >= low)
    if high is not None:
        rows = rows.where(F.col("date") <= high)
    order = Window.partitionBy("date").orderBy(F.col("rank").asc(), F.col("probability").desc(), F.col("ticker").asc())
    # Spark limits to per_day rows per date before the shuffle, so a crowded date stays small
    kept = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_day)
    whole = F.col("rank").cast("long")
    return kept.select(
        "date",
        F.col("rank"),
        F.concat_ws("-", "date", "ticker", whole.cast("string")).alias("id"),
        F.col("ticker").alias("symbol"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("ticker")).alias("name"),
        F.col("close").alias("current_price"),
        F.coalesce(half_up(F.col("ai_score")).cast("int"), F.lit(85)).alias("ai_score"),
        F.coalesce(F.col("ret_1d") * 100.0, F.lit(0.0)).alias("fluctuation_rate"),
        "probability",
        "trading_value",
        F.col("ret_1d").alias("day_return_1d"),
        "final_score",
        "turnover_rank_pct",
        "ret1d_rank_pct",
        "model_rank_pct",
        "score_turnover",
        "score_ret1d",
        "score_model",
        "max_return_since_buy",
        F.nullif("peak_date", F.lit("")).alias("max_return_peak_date"),
        _daily_reason(lang).alias("reasoning"),
    )


def daily_payload(items: DataFrame) -> DataFrame:
    """One row per day, newest first: date and its items ordered by rank (at most per_day each)."""
    item = F.struct("rank", *[c for c in items.columns if c not in ("rank", "date")])
    return (
        items.groupBy("date").agg(F.sort_array(F.collect_list(item)).alias("items")).orderBy(F.col("date").desc())
    )


def latest_day_items(items: DataFrame, limit: int = 3) -> DataFrame:
    newest = items.agg(F.max("date")).scalar()
    return items.where(F.col("date") == newest).orderBy("rank", F.col("probability").desc(), "symbol").limit(limit)


# --- tier-1 payload -----------------------------------------------------------------------


def tier1_items(candidates: DataFrame, master: DataFrame, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """Buy candidates as display records, strongest first."""
    lang = language(lang)
    names = ["close", "ret_1d", "ret_5d", "rvol20", "breakout_dist_20", "natr14", "tier1_composite_score"]
    rows = candidates.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.trim(F.col("date").cast("string")).alias("date"),
        *[to_number(F.col(c)).alias(c) for c in names],
    )
    rows = rows.where((F.col("ticker") != "") & F.col("close").isNotNull() & F.col("tier1_composite_score").isNotNull())
    score = F.col("tier1_composite_score")
    low, high = (rows.agg(f(score)).scalar() for f in (F.min, F.max))
    order = [
        score.desc(),
        F.col("ret_5d").desc_nulls_last(),
        F.col("breakout_dist_20").desc_nulls_last(),
        F.col("ticker"),
        F.col("date"),
    ]
    reason = fill(
        CANDIDATE_REASON[lang],
        {
            "ret5d": signed_percent(F.col("ret_5d"), 1, False),
            "ret1d": signed_percent(F.col("ret_1d"), 1, False),
            "volume": times(F.col("rvol20")),
            "breakout": signed_percent(F.col("breakout_dist_20"), 1, False),
            "natr": signed_percent(F.col("natr14"), 1, False),
        },
    )
    scored = rows.withColumn("ai_score", band_score(score, low, high, "up"))
    ordered = scored.orderBy(*order)
    if limit is not None and limit > 0:
        ordered = ordered.limit(limit)
    return with_names(ordered, master).select(
        F.concat_ws("-", "ticker", "date").alias("id"),
        F.col("ticker").alias("symbol"),
        "name",
        F.col("close").alias("current_price"),
        "ai_score",
        F.coalesce(F.col("ret_1d") * 100.0, F.lit(0.0)).alias("fluctuation_rate"),
        reason.alias("reasoning"),
        F.col("tier1_composite_score").alias("score"),
    )
