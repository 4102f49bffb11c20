"""Portfolios of signal ranges against a plain loop over days."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans import portfolio, universe
from barloom.schema import STRATEGY_SCHEMA

STRATEGIES = [(1, "f", 0.0, 1.0), (2, "f", 0.5, 2.5), (3, "g", 1.0, 3.0), (4, "f", 0.001, 1.0), (5, "g", 99.0, 100.0), (6, "f", 2.0, 2.0)]
COST = 0.0005


@pytest.fixture(scope="module")
def closes():
    rng = np.random.default_rng(11)
    return {f"T{i}": (100 * np.exp(rng.normal(0, 0.02, n).cumsum())).tolist() for i, n in enumerate((150, 300, 90, 1))}


@pytest.fixture
def features(make_bars, closes):
    bars = make_bars(closes)
    return bars.withColumn("f", F.when(F.col("close") % 7 > 1, F.col("close") % 3)).withColumn("g", F.col("close") % 5)


def table(spark, rows=STRATEGIES):
    return spark.createDataFrame(rows, STRATEGY_SCHEMA)


def plain(closes, signal, low, high, align):
    """Returns by day and all returns, one bar at a time."""
    days, every = {}, []
    for series in closes.values():
        for t, (now, after) in enumerate(zip(series, series[1:])):
            x = {"f": now % 3 if now % 7 > 1 else None, "g": now % 5}[signal]
            if x is not None and low <= x < high:
                r = after / now - 1 - 2 * COST
                days.setdefault(t if align == "date" else t - len(series), []).append(r)
                every.append(r)
    return [np.mean(days[d]) for d in sorted(days)], np.array(every)


@pytest.mark.parametrize("align", ["date", "tail"])
def test_metrics_match_a_plain_loop(spark, features, closes, align):
    got = {r.strategy_id: r for r in portfolio.backtest_metrics(features, ["f", "g"], table(spark), align=align).collect()}
    assert set(got) == {1, 2, 3, 4}  # nothing is held by the others
    for i, signal, low, high in STRATEGIES[:4]:
        daily, every = plain(closes, signal, low, high, align)
        r, m = np.array(daily), got[i]
        equity = np.cumprod(1 + r)
        assert m.trades == len(every)
        assert m.sharpe == pytest.approx(math.sqrt(252) * r.mean() / r.std(ddof=1))
        assert m.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
        assert m.cagr == pytest.approx(equity[-1] ** (252 / len(r)) - 1) and math.exp(m.log_cagr) - 1 == pytest.approx(m.cagr)
        assert m.win_rate == pytest.approx(100 * (every > 0).mean())
        assert m.profit_factor == pytest.approx(every[every > 0].sum() / -every[every < 0].sum())
        assert m.avg_trade_return == pytest.approx(every.mean())


def test_bars_are_read_once_and_not_multiplied(spark, features):
    plan = portfolio.strategy_days(portfolio.holdings(features, ["f", "g"]), table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(close") == 1


def test_trades_are_the_holdings_in_range(spark, features, closes):
    rows = portfolio.trades(portfolio.holdings(features, ["f", "g"]), table(spark)).collect()
    for i, signal, low, high in STRATEGIES:
        have = sorted(r.trade_return for r in rows if r.strategy_id == i)
        np.testing.assert_allclose(have, sorted(plain(closes, signal, low, high, "date")[1]))


def test_drawdown_states_merge_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    series = {i: rng.normal(0, 0.3, n).clip(-0.99, None) for i, n in enumerate((1, 2, 63, 64, 65, 700))}
    series[6] = np.array([0.1, -1.0, 0.5])  # everything lost on the second day
    series[7] = rng.normal(-0.5, 0.1, 3000).clip(-0.99, None)  # a product far below the smallest double
    rows = [(i, day, float(r)) for i, x in series.items() for day, r in enumerate(x)]
    daily = spark.createDataFrame(rows, "strategy_id long, day int, r double").repartition(5)
    states = {r.strategy_id: r.path for r in portfolio.path_states(daily).collect()}
    falls = {r.strategy_id: r.fall for r in portfolio.equity_days(daily).groupBy("strategy_id").agg(F.min("drawdown").alias("fall")).collect()}
    for i, x in series.items():
        with np.errstate(divide="ignore"):
            path = np.log1p(x).cumsum()
        fall = (path - np.maximum.accumulate(path)).min()
        assert states[i].total == pytest.approx(path[-1]) and states[i].fall == pytest.approx(fall)
        assert states[i].highest == pytest.approx(path.max()) and states[i].lowest == pytest.approx(path.min())
        assert falls[i] == pytest.approx(math.exp(fall) - 1)


def test_gate_reasons_and_leaderboard(spark):
    rows = [(1, 1.0, -0.1, 60.0, 30, 0.1, 1.5, 0.01), (2, 2.0, -0.2, 60.0, 30, 0.1, 1.5, 0.01), (4, 0.5, -0.2, 50.0, 30, 0.1, 1.5, 0.01)]
    metrics = spark.createDataFrame(
        rows, "strategy_id long, sharpe double, max_drawdown double, win_rate double, trades long, cagr double, profit_factor double, avg_trade_return double"
    ).withColumn("fitness", portfolio.fitness())
    gated = {r.strategy_id: r for r in portfolio.add_gate(metrics).collect()}
    assert [gated[i].reject_reason for i in (1, 2, 4)] == ["", "mdd_only", "mdd_and_win_rate"]
    assert gated[2].near_miss_score == pytest.approx(0.55 + 0.35 * (1 - 0.05 / 0.3) + 0.1)
    assert [r.strategy_id for r in portfolio.near_misses(portfolio.add_gate(metrics)).collect()] == [2, 4]
    board = portfolio.leaderboard(table(spark), metrics)
    # 4 rounds to the parameters of 1, which is better
    assert [(r.rank, r.strategy_id) for r in board.orderBy("rank").collect()] == [(1, 2), (2, 1)]
    payload = portfolio.leaderboard_payload(board).first().strategies
    assert payload[0]["metrics"]["sharpe"] == 2.0 and payload[0]["params"]["signal"] == "f"
    summary = portfolio.sweep_summary(table(spark), portfolio.add_gate(metrics)).first()
    assert (summary.total_candidates, summary.no_result, summary.accepted, summary.mdd_only, summary.accept_rate) == (6, 3, 1, 1, pytest.approx(1 / 6, abs=1e-6))


def test_universe_fallback_and_sample(spark, make_bars):
    bars = make_bars({"A": [10.0] * 30, "B": [20.0] * 30, "C": [99.0] * 5})
    pick = lambda **k: [r.ticker for r in universe.universe_by_liquidity(bars, 5, min_bars=20, **k).collect()]
    assert pick() == ["B", "A"] and pick(start="2030-01-01") == ["B", "A"]
    assert pick(start="2030-01-01", allow_fallback=False) == []
    # in the range C has the most bars per day traded, but only B and A have enough
    assert pick(start="2020-01-05") == ["B", "A"] and pick(start="2020-01-28") == ["B", "A"]
    late = bars.unionByName(make_bars({"C": [99.0] * 25}, start=dt.date(2021, 1, 1)))
    ranged = lambda **k: [(r.ticker, r.bars, r.liquidity) for r in universe.universe_by_liquidity(late, 5, min_bars=20, **k).collect()]
    assert ranged(start="2021-01-01") == [("C", 25, 9900.0)] and ranged() == [("C", 30, 9900.0), ("B", 30, 2000.0), ("A", 30, 1000.0)]
    plans = [universe.universe_by_liquidity(late, 5, min_bars=20, start=day)._jdf.queryExecution().optimizedPlan().toString() for day in ("2021-01-01", "2030-01-01")]
    assert re.sub(r"#\d+L?|\d{4}-\d\d-\d\d|\d{5}", "", plans[0]) == re.sub(r"#\d+L?|\d{4}-\d\d-\d\d|\d{5}", "", plans[1])
    symbols = bars.select("ticker").distinct()
    first = [r.ticker for r in universe.seeded_sample(symbols, 2, 7).collect()]
    assert first == [r.ticker for r in universe.seeded_sample(symbols.repartition(3), 2, 7).collect()]
