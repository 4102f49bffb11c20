"""Daily top-N picks: fitted model probability blended with turnover and return ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import band_score, change
from barloom.operators.binning import Model, fit_mappers, model_score
from barloom.operators.ranking import SLOT_ROWS, percent_ranks, top_per_group
from barloom.operators.series import latest_per_ticker, next_day_labels, with_neighbours
from barloom.session import staged

# Default blend of turnover, 1-day return and model rank.
BLEND = (0.45, 0.35, 0.20)


def normalized_weights(*weights: float) -> tuple[float, ...]:
    """Weights scaled to sum one; negatives and an all-zero set are errors."""
    if any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite and not negative")
    total = sum(weights)
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    return tuple(w / total for w in weights)


def with_names(df: DataFrame, master: DataFrame) -> DataFrame:
    """Name from the symbol master, else the ticker itself.

    No forced broadcast: the master grows with the listing, so its measured
    size decides.
    """
    names = master.select(F.upper("symbol").alias("ticker"), F.trim("name_ko").alias("name"))
    joined = df.join(names.where(F.col("name") != ""), "ticker", "left")
    return joined.withColumn("name", F.coalesce("name", "ticker"))


def future_peaks(bars: DataFrame) -> DataFrame:
    """Per bar: the highest later high of the same ticker and the first date it is reached.

    The series is walked backwards, so the frame only ever grows and each row
    costs one update. Later nulls are skipped; no later high leaves null.
    """
    # newest first: of equal highs the oldest later date must win, so the
    # comparison key is (high, -days since epoch)
    backwards = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    age = -F.unix_date(F.to_date("date"))
    best = F.max(F.when(F.col("high").isNotNull(), F.struct("high", age.alias("age")))).over(later)
    return (
        bars.select("ticker", "date", "high")
        .withColumn("_best", best)
        .select(
            "ticker",
            "date",
            F.col("_best.high").alias("peak_high"),
            F.date_from_unix_date(-F.col("_best.age")).alias("peak_date"),
        )
    )


def add_max_return_since_buy(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """Best return from the pick's close to any later high, and the date of that high.

    Only the series of picked tickers are walked, each once whatever its
    number of picks; no pick-by-bar pairs are formed.
    """
    picked = picks.select("ticker").distinct()
    peaks = future_peaks(bars.join(picked, "ticker", "left_semi"))
    usable = F.col("close") > 0
    return (
        picks.join(peaks, ["ticker", "date"], "left")
        .withColumn("max_return_since_buy", F.when(usable, change(F.col("peak_high"), F.col("close"))))
        .withColumn(
            "max_return_peak_date",
            F.when(usable & F.col("peak_high").isNotNull(), F.date_format("peak_date", "yyyy-MM-dd")).otherwise(""),
        )
        .drop("peak_high", "peak_date")
    )


def score_days(
    frame: DataFrame,
    model: Model,
    *,
    start: str | None = None,
    end: str | None = None,
    train_end: str | None = None,
    n_bins: int = 20,
    alpha: float = 120.0,
    blend: tuple[float, float, float] = BLEND,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Every row of the inference range with its ranks, blended score and 70-99 score.

    The model is fitted on all labelled rows, or on those up to ``train_end``.
    Without ``start``/``end`` the range is open on that side. The band score
    is scaled over the whole range, not per date.
    """
    turnover_w, return_w, model_w = normalized_weights(*blend)
    features = list(model.features)
    columns = list(dict.fromkeys(["ticker", "date", "close", "high", "volume", *features]))
    rows = with_neighbours(frame).select(*columns, "next_close", "prev_close")
    train = next_day_labels(rows)
    if train_end is not None:
        train = train.where(F.col("date") <= F.lit(train_end).cast("date"))
    mappers = fit_mappers(train, features, "target_up", n_bins=n_bins, alpha=alpha)[0]

    in_range = F.lit(True)
    if start is not None:
        in_range = in_range & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        in_range = in_range & (F.col("date") <= F.lit(end).cast("date"))
    scored = rows.where(in_range).select(
        "ticker",
        "date",
        "close",
        (F.col("close") * F.col("volume").cast("double")).alias("trading_value"),
        F.when(F.col("prev_close") > 0, change(F.col("close"), F.col("prev_close"))).alias("ret_1d"),
        model_score(model, mappers).alias("prob_up_next_day"),
    )
    bounds = scored.agg(F.min("prob_up_next_day").alias("lo"), F.max("prob_up_next_day").alias("hi")).first()
    low, high = (F.lit(b).cast("double") for b in (bounds.lo, bounds.hi))
    ranked = percent_ranks(
        scored,
        ["date"],
        {
            "turnover_rank_pct": "trading_value",
            "ret1d_rank_pct": "ret_1d",
            "model_rank_pct": "prob_up_next_day",
        },
        nulls="lowest",
        slot_rows=slot_rows,
    )
    return (
        ranked.withColumn("score_turnover", F.lit(turnover_w) * F.col("turnover_rank_pct"))
        .withColumn("score_ret1d", F.lit(return_w) * F.col("ret1d_rank_pct"))
        .withColumn("score_model", F.lit(model_w) * F.col("model_rank_pct"))
        .withColumn("final_score", F.col("score_turnover") + F.col("score_ret1d") + F.col("score_model"))
        .withColumn("ai_score", band_score(F.col("prob_up_next_day"), low, high, "even"))
    )


def pick_order() -> list[Column]:
    return [F.col("final_score").desc(), F.col("prob_up_next_day").desc(), F.col("ticker").asc()]


def daily_top_n(frame: DataFrame, model: Model, master: DataFrame, n: int = 5, **scoring) -> DataFrame:
    """The n best tickers of each date, with names and the best return since.

    The frame is written once with its neighbouring closes (columnar, in the
    checkpoint folder): fitting, scoring and the look-ahead each scan only the
    columns they need, and the labels are plain projections.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    columns = list(dict.fromkeys(["ticker", "date", "close", "high", "volume", *model.features]))
    table = staged(with_neighbours(frame.select(*columns)))
    picks = top_per_group(score_days(table, model, **scoring), ["date"], pick_order(), n)
    picks = with_names(add_max_return_since_buy(picks, table), master)
    return picks.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "rank", "ticker", "name", "close", "trading_value", "ret_1d", "prob_up_next_day",
        "turnover_rank_pct", "ret1d_rank_pct", "model_rank_pct", "score_turnover", "score_ret1d",
        "score_model", "final_score", "ai_score", "max_return_since_buy", "max_return_peak_date",
    )


def predict_latest(frame: DataFrame, model: Model, n: int = 25, **fit) -> DataFrame:
    """Fit on all labelled rows, score each ticker's row on the newest market date, keep the top n."""
    features = list(model.features)
    table = staged(with_neighbours(frame.select("ticker", "date", "close", *features)))
    mappers = fit_mappers(next_day_labels(table), features, "target_up", **fit)[0]
    newest = latest_per_ticker(table, require_market_date=True)
    scored = newest.select("date", "ticker", "close", model_score(model, mappers).alias("prob_up_next_day"))
    order = [F.col("prob_up_next_day").desc(), F.col("ticker").asc()]
    top = scored.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
