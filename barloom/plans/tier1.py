"""Tier-1 features, composite score and buy candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.functions.numeric import change, ratio
from barloom.operators.cross_section import add_date_context, weighted_sum
from barloom.operators.indicators import bollinger, realized_vol, true_range
from barloom.operators.ranking import all_of, number_rows
from barloom.operators.series import latest_per_ticker, min_history
from barloom.session import staged, staged_by

# Weights of the composite score.
SCORE_WEIGHTS = {
    "z_ret_5d": 0.30,
    "z_breakout_dist_20": 0.25,
    "z_rvol20": 0.20,
    "z_natr14": -0.15,
    "z_bb_width20": -0.10,
}
Z_COLUMNS = [name[2:] for name in SCORE_WEIGHTS]
NEEDED = [
    "tier1_composite_score", "dollar_volume", "natr14", "rvol20", "breakout_dist_20",
    "ret_5d", "ret_1d", "sma20", "close", "risk_on_regime",
]


# what the context, the score and the candidate filter read
CANDIDATE_FEATURES = [
    "ret_1d", "ret_5d", "ret_20d", "sma20", "sma60", "natr14", "rvol20", "dollar_volume", "breakout_dist_20", "bb_width20",
]
# what the summary reads of the features, context and score
SUMMARY_COLUMNS = [
    "ticker", "date", "close", "ret_1d", "ret_5d", "sma20", "sma60", "natr14", "rvol20", "dollar_volume", "breakout_dist_20",
    "risk_on_regime", "tier1_composite_score",
]


@dataclass(frozen=True)
class CandidateRules:
    """Thresholds of the candidate filter (defaults are fixed values)."""

    min_dollar_volume: float = 1_000_000_000.0
    max_natr14: float = 0.12
    min_rvol20: float = 1.1
    max_rvol20: float = 20.0
    min_breakout_dist_20: float = -0.02
    min_ret_5d: float = 0.03
    max_ret_1d: float = 0.25
    min_tier1_score: float = 0.5
    allow_risk_off: bool = False


def symbol_features(bars: DataFrame, only: Sequence[str] | None = None, *, batches: bool | None = None) -> DataFrame:
    """Per-ticker features, or ``only`` some of them. Prices are adj_close; ranges and breakouts use raw high and low.

    Long frames are rolled in Arrow ``batches`` unless only some features are asked for, or as the caller says.
    """
    f = Frames(batches=only is None if batches is None else batches)
    x, high, low, volume = (F.col(c) for c in ("adj_close", "high", "low", "volume"))
    log_return = F.ln(x) - f.lag(F.ln(x))
    sma20, sma60 = f.mean(x, 20, dense=True), f.mean(x, 60, dense=True)
    tr = true_range(f, high, low, x)
    atr = f.mean(tr, 14, dense=True)
    volume_mean, dollars = f.mean(volume, 20), x * volume
    bands = bollinger(f, x, 20, ddof=1)
    columns = {
        **{f"ret_{k}d": change(x, f.lag(x, k)) for k in (1, 5, 20)},
        "log_ret_1d": log_return,
        "sma20": sma20,
        "sma60": sma60,
        "dist_sma20": change(x, sma20),
        "dist_sma60": change(x, sma60),
        "tr": tr,
        "atr14": atr,
        "natr14": ratio(atr, x),
        "realized_vol20": realized_vol(f, log_return),
        "vol_ma20": volume_mean,
        "rvol20": ratio(volume, volume_mean),
        "dollar_volume": dollars,
        "dollar_volume_z20": ratio(dollars - f.mean(dollars, 20), f.std(dollars, 20, ddof=1)),
        "breakout_dist_20": change(x, f.highest(high, 20, shift=1, dense=True)),
        "bb_mid20": bands["bbm_20"],
        "bb_upper20": bands["bbu_20"],
        "bb_lower20": bands["bbl_20"],
        "bb_width20": bands["bbb_20"] / F.lit(100.0),
        "bb_percent_b20": bands["bbp_20"],
    }
    return f.select(bars, "*", *[c.alias(name) for name, c in columns.items() if only is None or name in only])


def tier1_features(bars: DataFrame, history: int = 20, only: Sequence[str] | None = None, *, written: bool = True) -> DataFrame:
    """Features (all, or ``only`` some that include what the score reads) of every ticker with at least ``history`` bars, with context and composite score.

    The features are written once; the statistics of the dates scan a few of their columns. For callers that read the
    result once, features that are not ``written`` take a table of the bars instead, a fraction of their size:
    the statistics roll what they need from it first.
    """
    if written:
        features = staged(symbol_features(min_history(bars, history), only, batches=True))
        scored = add_date_context(features, Z_COLUMNS)
    else:
        series = min_history(staged_by(bars, "ticker"), history)
        features = symbol_features(series, only, batches=True)
        scored = add_date_context(features, Z_COLUMNS, symbol_features(series, ["ret_1d", *Z_COLUMNS], batches=True))
    # the last bits of a mean depend on merge order: drop them, so that ties and
    # ranks come out the same on every run
    return scored.withColumn("tier1_composite_score", F.rint(weighted_sum(SCORE_WEIGHTS) * 1e12) / 1e12)


def passes(rules: CandidateRules):
    c = F.col
    conditions = [
        c("close") > c("sma20"),
        # short history leaves sma60 null: the trend test is then skipped
        c("sma60").isNull() | (c("sma20") > c("sma60")),
        c("dollar_volume") >= rules.min_dollar_volume,
        c("natr14") <= rules.max_natr14,
        c("rvol20").between(rules.min_rvol20, rules.max_rvol20),
        c("breakout_dist_20") >= rules.min_breakout_dist_20,
        c("ret_5d") >= rules.min_ret_5d,
        c("ret_1d") <= rules.max_ret_1d,
        c("tier1_composite_score") >= rules.min_tier1_score,
    ]
    if not rules.allow_risk_off:
        conditions.append(c("risk_on_regime") == 1)
    return all_of(conditions)


def _strength_order():
    keys = ["tier1_composite_score", "ret_5d", "breakout_dist_20"]
    return [*[F.col(k).desc_nulls_last() for k in keys], F.col("ticker").asc()]


def buy_candidates(features: DataFrame, rules: CandidateRules, per_date: bool = False) -> DataFrame:
    """Rows that pass the rules, numbered by strength over the whole table or within each date."""
    kept = features.dropna(subset=NEEDED).where(passes(rules))
    if not per_date:
        return number_rows(kept, _strength_order(), "candidate_rank")
    numbered = number_rows(kept, [F.col("date").asc(), *_strength_order()], "_no")
    first = numbered.groupBy("date").agg(F.min("_no").alias("_first"))
    ranked = numbered.join(first, "date")
    return ranked.withColumn("candidate_rank", (F.col("_no") - F.col("_first") + 1).cast("int")).drop(
        "_no", "_first"
    )


def tier1_latest(features: DataFrame) -> DataFrame:
    """Newest row of each ticker, best composite score first."""
    return latest_per_ticker(features).orderBy(F.col("tier1_composite_score").desc_nulls_last(), "ticker")


def tier1_summary(features: DataFrame, candidates: DataFrame, rules: CandidateRules, top_n: int = 20) -> DataFrame:
    """One nested row: counts, newest date, the filter used, the top of both rankings."""
    latest = latest_per_ticker(features)
    facts = features.agg(
        F.count_distinct("ticker").alias("usable_tickers"),
        F.count(F.lit(1)).alias("feature_rows"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("latest_date"),
    )
    top_cols = ["ticker", "date", "tier1_composite_score", "ret_5d", "breakout_dist_20", "rvol20"]
    cand_cols = [
        "candidate_rank", "ticker", "date", "tier1_composite_score", "ret_1d", "ret_5d",
        "breakout_dist_20", "rvol20", "natr14", "dollar_volume",
    ]

    def packed(df: DataFrame, columns: list[str]) -> DataFrame:
        item = F.struct(F.col("_i"), *[F.col(c).cast("string").alias(c) if c == "date" else F.col(c) for c in columns])
        listed = F.sort_array(F.collect_list(item))
        return df.agg(
            F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("items")
        )

    best = number_rows(
        latest.orderBy(F.col("tier1_composite_score").desc_nulls_last(), "ticker").limit(top_n),
        [F.col("tier1_composite_score").desc_nulls_last(), F.col("ticker")],
        "_i",
    )
    chosen = candidates.orderBy("candidate_rank", "ticker").limit(top_n).withColumn("_i", F.col("candidate_rank"))
    limits = {name: F.lit(value).alias(name) for name, value in rules.__dict__.items()}
    return facts.select(
        "*",
        F.lit(top_n).alias("top_n"),
        candidates.agg(F.count(F.lit(1))).scalar().alias("candidate_count"),
        F.struct(*limits.values()).alias("candidate_filter"),
        packed(best, top_cols).scalar().alias("top_tickers"),
        packed(chosen, cand_cols).scalar().alias("top_candidates"),
    )
