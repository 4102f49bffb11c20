"""Min-periods edges, RSI variants, guards, indicators against plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import Frames
from barloom.operators import indicators, recursive, series
from barloom.operators.cross_section import add_date_context, market_days
from barloom.plans import analytics, technical, tier1


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy("ticker", order).collect()]


def walk(n, seed=5, start=100.0):
    rng = np.random.default_rng(seed)
    return (start * np.exp(np.cumsum(rng.normal(0, 0.03, n)))).tolist()


@pytest.mark.parametrize("bars,first", [(19, None), (20, 19), (21, 19)])
def test_sma_needs_full_frame(make_bars, bars, first):
    df = make_bars({"A": [float(i) for i in range(1, bars + 1)]})
    f = Frames()
    got = column(f.select(df, "*", f.mean(F.col("close"), 20).alias("s")), "s")
    known = [i for i, v in enumerate(got) if v is not None]
    assert (known[0] if known else None) == first
    if first is not None:
        assert got[first] == pytest.approx(10.5)


def test_null_inside_frame_blanks_it(make_bars):
    closes = [1.0, 2.0, None, 4.0, 5.0, 6.0]
    df = make_bars({"A": closes}).withColumn("close", F.col("close"))
    f = Frames()
    got = column(f.select(df, "*", f.mean(F.col("close"), 3).alias("s")), "s")
    assert got == [None, None, None, None, None, 5.0]


def test_rsi_variants_differ_where_they_should(make_bars):
    ramp = make_bars({"A": [float(i) for i in range(1, 21)]})
    f, x = Frames(), F.col("close")
    got = f.select(
        ramp, "ticker", "date",
        indicators.rsi(f, x, 14, "null_seed").alias("a"),
        indicators.rsi(f, x, 14, "zero_seed").alias("b"),
        indicators.rsi(f, x, 14, "unguarded").alias("c"),
    )
    assert column(got, "a") == [None] * 20 and column(got, "b") == [None] * 20
    assert column(got, "c") == [None] * 13 + [100.0] * 7

    closes = walk(16)
    f = Frames()
    got = f.select(
        make_bars({"A": closes}), "ticker", "date", indicators.rsi(f, x, 14, "null_seed").alias("a"), indicators.rsi(f, x, 14, "zero_seed").alias("b")
    )
    a, b = column(got, "a"), column(got, "b")
    assert [v is None for v in a[12:]] == [True, True, False, False]
    assert [v is None for v in b[12:]] == [True, False, False, False]
    moves = np.diff(closes)
    gain, loss = np.clip(moves[:14], 0, None).mean(), np.clip(-moves[:14], 0, None).mean()
    assert a[14] == pytest.approx(100 - 100 / (1 + gain / loss))
    assert a[15] == pytest.approx(b[15])


def test_flat_series_gives_nulls_not_errors(make_bars):
    flat = make_bars({"A": [50.0] * 30}).withColumns({"high": F.col("close"), "low": F.col("close")})
    out = tier1.symbol_features(flat).orderBy("date").collect()[-1]
    assert out.ret_20d == 0 and out.bb_percent_b20 is None and out.dollar_volume_z20 is None
    window = indicators.window_indicators(flat.select("ticker", "date", "high", "low", "close", "volume"))
    last = window.orderBy("date").collect()[-1]
    assert last.cci_14 is None and last.willr_14 is None and last.stoch_k is None and last.mfi_14 is None
    assert last.obv == 0 and last.cmf_20 == 0


def test_single_bar_has_true_range(make_bars):
    f = Frames()
    got = f.select(make_bars({"A": [10.0]}), "ticker", "date", indicators.true_range(f, F.col("high"), F.col("low"), F.col("close")).alias("tr"))
    assert column(got, "tr") == [2.0]


def test_clean_bars_nan_and_repeated_dates(spark):
    nan = float("nan")
    rows = [("A", "2020-01-01", 1.0, nan, 1), ("A", "2020-01-02", nan, 1.0, 2), ("A", "2020-01-03", 3.0, 9.0, 3)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double, adj_close double, volume long")
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    got = series.clean_bars(df).orderBy("date").collect()
    assert [(r.date, r.close, r.adj_close) for r in got] == [("2020-01-01", 1.0, 1.0), ("2020-01-03", 3.0, 9.0)]
    doubled = df.unionByName(df.withColumn("volume", F.col("volume") + 10))
    last = series.keep_last(doubled, ["ticker", "date"], ["volume"])
    assert sorted(r.volume for r in last.collect()) == [11, 12, 13]


def test_trailing_window_is_anchored_and_checked(make_bars):
    df = make_bars({"A": [1.0] * 400})
    assert series.trailing_window(df, 365).count() == 366
    assert series.trailing_window(df, 30, "2020-03-01").count() == 31
    with pytest.raises(ValueError):
        series.trailing_window(df, 30, "03/01/2020")


def test_year_partitions_are_pruned_without_a_date(make_bars, spark, tmp_path):
    bars = make_bars({"A": [float(i + 1) for i in range(1500)], "B": [2.0] * 900})
    bars.withColumn("year", F.year("date")).write.partitionBy("year").parquet(str(tmp_path / "lake"))
    lake = spark.read.parquet(str(tmp_path / "lake"))
    for lake in (lake, lake.withColumn("year", F.col("year").cast("string"))):
        got = analytics.high_low_52_week(lake)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, analytics.high_low_52_week(bars).collect()))
        assert series.trailing_window(lake, 365).count() == 366
    got = analytics.high_low_52_week(spark.read.parquet(str(tmp_path / "lake")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in part and "Subquery" in part.split("PushedFilters")[0] for part in plan.split("FileScan")[1:])
    got.collect()
    read = [m for m in _scans(got) if "ticker" in m[0]]
    assert read and all(partitions == 2 for _, partitions in read)  # of five years


def _scans(df):
    """(output, partitions read) of the file scans that ran."""
    out, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            out.append((node.output().toString(), node.metrics().apply("numPartitions").value()))
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out


def test_a_bad_series_leaves_the_others_standing(make_bars, spark):
    good = make_bars({"A": walk(60), "B": walk(40, 2)}).select("ticker", "date", *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    a_day = good.where("ticker = 'A'").limit(1)
    raw = good.unionByName(a_day.withColumn("ticker", F.lit("twice"))).unionByName(a_day.withColumn("ticker", F.lit("twice")))
    raw = raw.unionByName(good.where("ticker = 'B'").withColumns({"ticker": F.lit("words"), "close": F.lit("n/a")}))
    raw = raw.unionByName(a_day.withColumn("ticker", F.lit(None).cast("string")))
    raw = raw.unionByName(a_day.withColumns({"ticker": F.lit("A"), "date": F.lit(None).cast("date")}))
    out, faults = technical.indicators_or_errors(raw)
    want = technical.technical_indicators(make_bars({"A": walk(60), "B": walk(40, 2)}))
    assert sorted(map(repr, out.select("ticker", "date", "rsi_14", "psar_af", "sma_20").collect())) == sorted(map(repr, want.select("ticker", "date", "rsi_14", "psar_af", "sma_20").collect()))
    assert sorted(map(tuple, faults.collect()), key=repr) == sorted(
        [("twice", technical.REPEATED, 2), ("words", technical.NO_ROWS, 40), (None, technical.NO_TICKER, 1)], key=repr
    )
    out, faults = technical.indicators_or_errors(raw.limit(0))
    assert out.count() == faults.count() == 0


def test_recurrences_need_no_python(make_bars):
    bars = make_bars({"A": walk(150, 1), "B": walk(3)})
    for out in (technical.technical_indicators(bars), recursive.ewm_columns(bars, adjust=True), recursive.ewm_columns(bars, adjust=False)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "FlatMapGroups", "MapIn"))
        assert plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("adjust", [False, True])
def test_unseeded_means_over_gaps_match_pandas(spark, adjust):
    rng = np.random.default_rng(5)
    closes = [None if i < 3 or rng.random() < 0.3 else float(x) for i, x in enumerate(rng.normal(50, 5, 300))]
    rows = [("A", i, c) for i, c in enumerate(closes)]
    out = recursive.ewm_columns(spark.createDataFrame(rows, "ticker string, date int, close double"), adjust=adjust).orderBy("date").toPandas()
    s = pd.Series([np.nan if c is None else c for c in closes])
    line = s.ewm(span=12, adjust=adjust).mean() - s.ewm(span=26, adjust=adjust).mean()
    np.testing.assert_allclose(out["macd"], line, atol=1e-9)
    np.testing.assert_allclose(out["macd_signal"], line.ewm(span=9, adjust=adjust).mean(), atol=1e-9)


def test_stale_ticker_and_market_date(make_bars):
    df = make_bars({"A": [1.0] * 5, "B": [1.0] * 3})
    assert series.latest_per_ticker(df).count() == 2
    assert [r.ticker for r in series.latest_per_ticker(df, require_market_date=True).collect()] == ["A"]


def test_shuffled_input_changes_nothing(make_bars, spark):
    df = make_bars({"A": walk(80, 1), "B": walk(70, 2)})
    want = tier1.tier1_features(df).orderBy("ticker", "date").toPandas()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = tier1.tier1_features(df.orderBy(F.rand(3)).repartition(5)).orderBy("ticker", "date").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(got, want)


def test_tier1_windows_use_one_exchange(make_bars):
    df = make_bars({"A": walk(30)}).coalesce(3)
    plan = tier1.symbol_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_market_index_and_regime(make_bars):
    df = make_bars({"A": walk(40, 1), "B": walk(40, 2), "C": [5.0] * 40})
    returns = series.returns(df)
    days = market_days(returns).orderBy("date").toPandas()
    frame = df.toPandas().sort_values(["ticker", "date"])
    frame["r"] = frame.groupby("ticker")["close"].pct_change()
    valid = frame.dropna(subset=["r"]).groupby("date")["r"]
    index = (1 + valid.mean()).cumprod()
    np.testing.assert_allclose(days["market_ret_5d"][5:], index.pct_change(5).dropna(), rtol=1e-9)
    assert days["market_ret_5d"][:5].isna().all() and days["market_ret_20d"][:20].isna().all()
    np.testing.assert_allclose(days["breadth_up_ratio"], valid.apply(lambda x: (x > 0).mean()))
    ctx = add_date_context(tier1.symbol_features(df), ["ret_5d"]).toPandas()
    assert set(ctx["risk_on_regime"]) <= {0, 1} and len(ctx) == 120
    z = ctx.groupby("date")["ret_5d"].transform(lambda s: (s - s.mean()) / s.std(ddof=0))
    np.testing.assert_allclose(ctx["z_ret_5d"].dropna(), z.dropna(), rtol=1e-9)


# --- recurrences against plain loops -----------------------------------------------


def loop_smooth(x, n, alpha):
    out, known, y = [], [], None
    for v in x:
        if v is None or math.isnan(v):
            out.append(None)
            continue
        known.append(v)
        if len(known) == n:
            y = sum(known) / n
        elif len(known) > n:
            y = alpha * v + (1 - alpha) * y
        out.append(y if len(known) >= n else None)
    return out


@pytest.mark.parametrize("bars", [1, 13, 14, 15, 30, 90])
def test_wilder_and_ema_follow_the_textbook(make_bars, bars):
    closes = walk(bars)
    out = recursive.recursive_indicators(make_bars({"A": closes}), ["macd", "rsi", "atr"]).orderBy("date").collect()

    def same(name, want):
        got = [r[name] for r in out]
        assert [g is None for g in got] == [w is None for w in want]
        np.testing.assert_allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-9)

    fast, slow = loop_smooth(closes, 12, 2 / 13), loop_smooth(closes, 26, 2 / 27)
    line = [None if a is None or b is None else a - b for a, b in zip(fast, slow)]
    same("ema_12", fast)
    same("macd", line)
    same("macd_signal", loop_smooth([math.nan if v is None else v for v in line], 9, 0.2))
    gain = [math.nan] + [max(b - a, 0) for a, b in zip(closes, closes[1:])]
    loss = [math.nan] + [max(a - b, 0) for a, b in zip(closes, closes[1:])]
    g, l = loop_smooth(gain, 14, 1 / 14), loop_smooth(loss, 14, 1 / 14)
    same("rsi_14", [None if a is None else 100 * a / (a + b) for a, b in zip(g, l)])
    tr = [2.0] + [max(2.0, abs(b + 1 - a), abs(b - 1 - a)) for a, b in zip(closes, closes[1:])]
    same("atr_14", loop_smooth(tr, 14, 1 / 14))


def test_parabolic_stop_on_a_ramp_and_a_reversal(make_bars):
    closes = [10.0 + i for i in range(8)] + [17.0 - 3 * i for i in range(1, 6)]
    out = recursive.recursive_indicators(make_bars({"A": closes}), ["psar"]).orderBy("date").collect()
    assert out[0].psar_long is None and out[1].psar_long == 9.0
    flips = [i for i, r in enumerate(out) if r.psar_reversal == 1.0]
    assert len(flips) == 1 and flips[0] >= 8
    assert out[flips[0]].psar_short == max(r.high for r in out[: flips[0]])
    assert all(r.psar_long is None for r in out[flips[0] :])


def test_plain_ewm_matches_pandas(make_bars):
    closes = walk(60)
    for adjust in (False, True):
        out = recursive.ewm_columns(make_bars({"A": closes}), adjust=adjust).orderBy("date").toPandas()
        s = pd.Series(closes)
        line = s.ewm(span=12, adjust=adjust).mean() - s.ewm(span=26, adjust=adjust).mean()
        np.testing.assert_allclose(out["macd"], line, atol=1e-9)
        np.testing.assert_allclose(out["macd_signal"], line.ewm(span=9, adjust=adjust).mean(), atol=1e-9)


def test_technical_set_shape_and_helpers(make_bars, spark):
    df = make_bars({"A": walk(130), "B": walk(5)})
    out = technical.technical_indicators(df)
    assert out.count() == 135 and "atr_14" in out.columns and "adj_close" not in out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    kept = technical.keep_indicator_columns(spark.range(1).selectExpr("1 AS close", "2 AS isa_9", "3 AS its_9", "4 AS foo"))
    assert kept.columns == ["close", "its_9"]
    aligned = technical.align_columns(kept, spark.range(1).selectExpr("1D AS its_9", "'x' AS extra").schema)
    assert aligned.first().asDict() == {"its_9": 3.0, "extra": None}
    assert dict(technical.downcast(df).dtypes)["close"] == "float"


def test_batches_walk_like_arrays(spark):
    rng = np.random.default_rng(11)
    rows = []
    for ticker, (n, gaps) in {"A": (150, 0.0), "B": (3, 0.0), "C": (1, 0.0), "D": (200, 0.2), "E": (40, 0.05), "F": (60, 0.0), None: (30, 0.1)}.items():
        close = 50.0
        for i in range(n):
            close = 7.0 if ticker == "F" else max(1.0, close + float(rng.choice([-1.0, 0.0, 0.5, rng.normal()])))
            prices = [close, close + float(rng.random()), close - float(rng.random()), close]
            prices = [None if rng.random() < gaps else float("nan") if ticker == "E" and rng.random() < 0.03 else x for x in prices]
            rows.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), *prices, int(rng.integers(0, 500))))
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")
    for run in (technical.technical_indicators, recursive.recursive_indicators):
        want, got = (run(bars, batches=b).orderBy("ticker", "date") for b in (False, True))
        assert want.schema == got.schema
        assert [repr(r).replace("-0.0", "0.0") for r in want.collect()] == [repr(r).replace("-0.0", "0.0") for r in got.collect()]


def test_batched_indicators_shuffle_once_and_walk_no_arrays(make_bars):
    plan = technical.technical_indicators(make_bars({"A": walk(150, 1), "B": walk(3)}), batches=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "aggregate(" not in plan and "collect_list(struct" not in plan


def test_batches_of_chosen_indicators(make_bars):
    bars, shown = make_bars({"A": walk(150, 1), "B": walk(3)}), ["ticker", "date", "rsi_14", "stoch_k", "stoch_d", "obv"]
    want, got = (technical.technical_indicators(bars, **how).select(*shown).orderBy("ticker", "date").collect() for how in ({}, {"batches": True, "only": shown}))
    assert want == got
    assert set(technical.technical_indicators(bars, batches=True, only=shown).columns) == {*technical.BASE, *shown}
