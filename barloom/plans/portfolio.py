"""Portfolios from signal ranges: daily returns, statistics, quality gate, leaderboard.

A strategy holds, from one close to the next, every ticker whose signal lies in
its range. Bars never meet strategies: the edges of all ranges cut a signal
into buckets, each bar is counted into one bucket per signal and day, and a
strategy's day is the sum of its buckets. So the bars are read once, whatever
the number of strategies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import change, clamp, finite
from barloom.operators.quantiles import edges_passed
from barloom.session import staged

# Fixed values of the evaluation.
COST = 0.0005
MIN_TRADES, MIN_DAYS = 20, 40
YEAR_DAYS = 252.0
NO_LOSS_FACTOR = 9.99
MIN_DRAWDOWN, MIN_WIN_RATE = -0.15, 55.0
METRICS = ["sharpe", "max_drawdown", "win_rate", "trades", "cagr", "profit_factor", "avg_trade_return"]
PARAMETERS = ["signal", "low", "high"]
KEY_DIGITS = {"low": 2, "high": 2}
MOST_EDGES = 1 << 16
DAYS_PER_BLOCK = 64


def holdings(features: DataFrame, signals: list[str], *, cost: float = COST, align: str = "date") -> DataFrame:
    """One row per bar with a later one: entry_date, exit_date, day, r (to the next close, less two costs) and the signals.

    ``day`` is the day the return falls on: its date, or with align="tail" the
    distance from the ticker's last bar, negative, so that it grows with time.
    """
    series = Window.partitionBy("ticker").orderBy("date")
    days = {
        "date": F.lead("date").over(series),
        "tail": 2 - F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc())),
    }
    gain = change(F.lead("close").over(series), F.col("close"))
    rows = features.select(
        "ticker",
        F.col("date").alias("entry_date"),
        F.lead("date").over(series).alias("exit_date"),
        days[align].alias("day"),
        (gain - F.lit(2 * cost)).alias("r"),
        *[finite(F.col(s)).alias(s) for s in signals],
    )
    return rows.where("r IS NOT NULL")


def trades(held: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every holding of every strategy: strategy_id, ticker, entry_date, exit_date, trade_return."""
    chosen = strategies.select("strategy_id", "signal", "low", "high")
    rows = _by_signal(held, "ticker", "entry_date", "exit_date", "r")
    inside = rows.join(chosen, "signal").where("x >= low AND x < high")
    return inside.select("strategy_id", "ticker", "entry_date", "exit_date", F.col("r").alias("trade_return"))


def _by_signal(held: DataFrame, *columns: str) -> DataFrame:
    signals = [c for c in held.columns if c not in ("ticker", "entry_date", "exit_date", "day", "r")]
    known = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("x")) for s in signals])
    return held.select(*columns, F.explode(known).alias("s")).select(*columns, "s.signal", "s.x").where("x IS NOT NULL")


def _edges(strategies: DataFrame) -> DataFrame:
    """(signal, sorted edges of all ranges)."""
    ends = strategies.select("signal", F.explode(F.array("low", "high")).alias("edge"))
    return ends.groupBy("signal").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


SUMS = ["n", "total", "wins", "gains", "losses"]


def bucket_days(held: DataFrame, strategies: DataFrame) -> DataFrame:
    """(signal, bucket, day) with count and sums of the returns; bucket b holds the values at or above b of the edges."""
    rows = _by_signal(held, "day", "r").join(_edges(strategies), "signal")
    r = F.col("r")
    return rows.groupBy("signal", edges_passed(F.col("x"), F.col("edges"), MOST_EDGES).alias("bucket"), "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("r").alias("total"),
        F.count_if(r > 0).alias("wins"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gains"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("losses"),
    )


def strategy_days(held: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, day): r, the mean over the holdings of the day, and their count and sums. Days without holdings have no row."""
    place = [edges_passed(F.col(c), F.col("edges"), MOST_EDGES).alias(f"_{c}") for c in ("low", "high")]
    ranges = strategies.join(_edges(strategies), "signal").where("low < high").select("strategy_id", "signal", *place)
    covered = ranges.select("strategy_id", "signal", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("bucket"))
    days = covered.join(bucket_days(held, strategies), ["signal", "bucket"]).groupBy("strategy_id", "day")
    return days.agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("r", F.col("total") / F.col("n"))


# --- drawdown as a mergeable state ---------------------------------------------


def log_gross(r: Column) -> Column:
    """Log of the gross return, so that long products neither over- nor underflow; minus infinity for a total loss."""
    gross = F.lit(1.0) + r
    return F.when(gross > 0, F.ln(gross)).when(gross.isNotNull(), F.lit(float("-inf")))


def _state(total: Column, highest: Column, lowest: Column, fall: Column) -> Column:
    return F.struct(total.alias("total"), highest.alias("highest"), lowest.alias("lowest"), fall.alias("fall"))


def merged_path(a: Column, b: Column) -> Column:
    """State of two stretches one after the other; a null one is empty.

    A state is the sum of the log returns, the highest and the lowest sum after
    any of its days, and the worst fall from one of its days to a later one. A
    fall that spans both starts at the highest of the first.
    """
    joined = _state(
        a["total"] + b["total"],
        F.greatest(a["highest"], a["total"] + b["highest"]),
        F.least(a["lowest"], a["total"] + b["lowest"]),
        F.least(a["fall"], b["fall"], a["total"] + b["lowest"] - a["highest"]),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(joined)


def path_states(daily: DataFrame) -> DataFrame:
    """(strategy_id, path): the state of each strategy's whole series of (day, r).

    Days are folded in blocks of the calendar first, blocks then; neither step
    gathers more than a block of days or the blocks of one series.
    """
    step = log_gross(F.col("r"))
    day = F.col("day") if dict(daily.dtypes)["day"] == "int" else F.unix_date("day")
    points = daily.select("strategy_id", F.floor(day / DAYS_PER_BLOCK).alias("block"), "day", _state(step, step, step, F.lit(0.0)).alias("s"))
    empty = F.lit(None).cast("struct<total:double,highest:double,lowest:double,fall:double>")

    def fold(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, "s")))
        return df.groupBy(*keys).agg(F.aggregate(F.transform(ordered, lambda x: x["s"]), empty, merged_path).alias("s"))

    blocks = fold(points, ["strategy_id", "block"], "day")
    return fold(blocks, ["strategy_id"], "block").withColumnRenamed("s", "path")


def equity_days(daily: DataFrame) -> DataFrame:
    """Log equity, its running peak and the drawdown per strategy and day; a series is as long as the calendar."""
    path = Window.partitionBy("strategy_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = daily.withColumn("log_equity", F.sum(log_gross(F.col("r"))).over(path))
    out = out.withColumn("log_peak", F.max("log_equity").over(path))
    return out.withColumn("drawdown", F.exp(F.col("log_equity") - F.col("log_peak")) - F.lit(1.0))


# --- statistics -----------------------------------------------------------------


def fitness() -> Column:
    """Sharpe plus small credits for profit factor and win rate, minus a drawdown penalty."""
    c = F.col
    penalty = F.greatest(F.lit(0.0), (-c("max_drawdown") - 0.15) * 4.0)
    return c("sharpe") + 0.15 * c("profit_factor") + 0.02 * (c("win_rate") - 50.0) - penalty


def portfolio_metrics(daily: DataFrame) -> DataFrame:
    """Metrics and fitness per strategy from its days; strategies with too few trades or days give no row."""
    sums = daily.groupBy("strategy_id").agg(*[F.sum(c).alias(f"_{c}") for c in SUMS]).where(F.col("_n") >= MIN_TRADES)
    outcomes = sums.select(
        "strategy_id",
        (F.col("_wins") * 100.0 / F.col("_n")).alias("win_rate"),
        F.col("_n").alias("trades"),
        F.when(F.col("_losses") > 1e-12, F.try_divide("_gains", "_losses")).otherwise(F.lit(NO_LOSS_FACTOR)).alias("profit_factor"),
        (F.col("_total") / F.col("_n")).alias("avg_trade_return"),
    )
    return path_metrics(daily, outcomes, MIN_DAYS)


def path_metrics(daily: DataFrame, outcomes: DataFrame, min_days: int) -> DataFrame:
    """Metrics and fitness of the strategies in ``outcomes`` (win_rate, trades, profit_factor, avg_trade_return) over their (day, r)."""
    n, mean, std = F.col("days").cast("double"), F.col("_mean"), F.col("_std")
    moments = daily.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("days"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_std")
    )
    enough = moments.where(F.col("days") >= min_days).join(outcomes, "strategy_id").join(path_states(daily), "strategy_id")
    years = F.greatest(n / YEAR_DAYS, F.lit(1.0 / YEAR_DAYS))
    return enough.select(
        "strategy_id",
        F.when(std > 1e-10, F.sqrt(F.lit(YEAR_DAYS)) * mean / std).otherwise(F.lit(0.0)).alias("sharpe"),
        (F.exp("path.fall") - 1.0).alias("max_drawdown"),
        "win_rate",
        "trades",
        (F.exp(F.col("path.total") / years) - 1.0).alias("cagr"),
        (F.col("path.total") / years).alias("log_cagr"),
        "profit_factor",
        "avg_trade_return",
    ).withColumn("fitness", fitness())


def backtest_metrics(features: DataFrame, signals: list[str], strategies: DataFrame, *, align: str = "date", cost: float = COST) -> DataFrame:
    """Metrics of every strategy over the bars' signals; the days are written once for the two passes over them."""
    held = holdings(features, signals, cost=cost, align=align)
    return portfolio_metrics(staged(strategy_days(held, strategies)))


def add_gate(metrics: DataFrame, min_drawdown: float = MIN_DRAWDOWN, min_win_rate: float = MIN_WIN_RATE) -> DataFrame:
    """accepted, reject_reason and the near-miss score of every evaluated strategy."""
    deep = F.col("max_drawdown") < min_drawdown
    weak = F.col("win_rate") < min_win_rate
    reason = F.when(deep & weak, "mdd_and_win_rate").when(deep, "mdd_only").when(weak, "win_rate_only").otherwise("")
    win_part = clamp(F.col("win_rate") / min_win_rate, 0.0, 1.0)
    gap = F.abs(F.lit(min_drawdown) - F.col("max_drawdown"))
    depth_part = F.when(deep, clamp(1.0 - gap / 0.30, 0.0, 1.0)).otherwise(F.lit(1.0))
    sharpe_part = clamp((F.col("sharpe") + 0.5) / 2.5, 0.0, 1.0)
    return metrics.select(
        "*",
        (~deep & ~weak).alias("accepted"),
        reason.alias("reject_reason"),
        (0.55 * win_part + 0.35 * depth_part + 0.10 * sharpe_part).alias("near_miss_score"),
    )


def near_misses(gated: DataFrame, keep: int = 20) -> DataFrame:
    order = [F.col("near_miss_score").desc(), F.col("sharpe").desc(), F.col("strategy_id")]
    return gated.where(~F.col("accepted")).orderBy(*order).limit(keep)


def sweep_summary(strategies: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: counts per reject reason (unevaluated ones are no_result), accept rate, metric means."""
    means = [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in METRICS]
    base = gated.agg(
        F.count(F.lit(1)).alias("evaluable"),
        F.count_if("accepted").alias("accepted"),
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in ("mdd_only", "win_rate_only", "mdd_and_win_rate")],
        *means,
    )
    total = strategies.agg(F.count(F.lit(1))).scalar()
    return (
        base.withColumn("total_candidates", total)
        .withColumn("no_result", F.col("total_candidates") - F.col("evaluable"))
        .withColumn("rejected", F.col("total_candidates") - F.col("accepted"))
        .withColumn("accept_rate", F.round(F.try_divide(F.col("accepted"), F.col("total_candidates")), 6))
    )


def leaderboard(strategies: DataFrame, metrics: DataFrame, keep: int = 30) -> DataFrame:
    """Best result per rounded parameter set, the ``keep`` best by Sharpe, ranked."""
    return leaderboard_by(strategies, metrics, PARAMETERS, KEY_DIGITS, keep)


def leaderboard_by(strategies: DataFrame, metrics: DataFrame, parameters: list[str], digits: dict[str, int], keep: int) -> DataFrame:
    keys = [(F.round(c, digits[c]) if c in digits else F.col(c)).alias(f"_k_{c}") for c in parameters]
    joined = strategies.join(metrics, "strategy_id")
    best = joined.groupBy(*keys).agg(F.max_by(F.struct(*joined.columns), F.struct(_tied("sharpe"), -F.col("strategy_id"))).alias("row"))
    order = [_tied("sharpe").desc(), _tied("fitness").desc(), F.col("strategy_id")]
    top = best.select("row.*").orderBy(*order).limit(keep)
    # at most ``keep`` rows from here on
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _tied(metric: str) -> Column:
    """The metric without the last bits, which the merge order of sums decides: equal results must tie."""
    return F.rint(F.col(metric) * 1e9) / 1e9


def leaderboard_payload(board: DataFrame) -> DataFrame:
    """One nested row: strategies[{rank, fitness, metrics{}, params{}}], rounded for display."""
    digits = dict.fromkeys(METRICS, 6) | {"win_rate": 4}
    metrics = F.struct(*[F.round(m, d).alias(m) if m != "trades" else F.col(m) for m, d in digits.items()])
    item = F.struct("rank", F.round("fitness", 6).alias("fitness"), metrics.alias("metrics"), F.struct(*PARAMETERS).alias("params"))
    return board.agg(F.sort_array(F.collect_list(item)).alias("strategies"))
