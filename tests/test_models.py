"""Probability model, daily picks, walk-forward, variance report, next-day score."""

import datetime as dt
import os
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries

from barloom.functions.numeric import band_score, decimal4, half_up_at, to_number
from barloom.operators.binning import Mapper, Model, fit_mappers, mapped_probability
from barloom.plans import daily_top, next_day, technical, tier1, variance, walk_forward
from barloom.session import shared_path, staged_by


def labelled(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    rows = [(float(a), float(round(a)), 1.0, int(b)) for a, b in zip(x, y)]
    rows += [(float("nan"), None, 1.0, 1), (float("inf"), None, 1.0, 0)]
    return spark.createDataFrame(rows, "x double, coarse double, flat double, y int"), x, y


def test_mapper_matches_plain_numpy(spark):
    df, x, y = labelled(spark)
    fit = fit_mappers(df, ["x", "coarse", "flat"], "y")[0]
    for name, values in (("x", x), ("coarse", np.round(x))):
        edges = np.unique(np.quantile(values, np.linspace(0, 1, 21)))
        inner = edges[1:-1]
        place = np.searchsorted(inner, values, side="right")
        base = y.mean()
        want = [(y[place == k].sum() + 120 * base) / ((place == k).sum() + 120) for k in range(len(inner) + 1)]
        np.testing.assert_allclose(fit[name].inner, inner, rtol=1e-12)
        np.testing.assert_allclose(fit[name].probs, want, rtol=1e-12)
    assert fit["flat"].inner == () and fit["flat"].probs == (fit["flat"].base,)


def test_few_rows_fall_back_to_the_label_mean(spark):
    df = spark.createDataFrame([(float(i), i % 4 == 0) for i in range(40)], "x double, up boolean")
    fit = fit_mappers(df.withColumn("y", F.col("up").cast("int")), ["x"], "y")[0]["x"]
    assert fit == Mapper((), (0.25,), 0.25)


def test_apply_is_left_closed_and_defaults_to_base(spark):
    mapper = Mapper((1.0, 2.0), (0.1, 0.2, 0.3), 0.5)
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 2.0, 9.0, float("nan"), float("inf"), None)], "x double")
    got = [r[0] for r in df.select(mapped_probability("x", mapper)).collect()]
    assert got == [0.1, 0.2, 0.2, 0.3, 0.3, 0.5, 0.5, 0.5]


def test_model_and_weights_are_validated():
    with pytest.raises(ValueError):
        Model(("a", "b"), (1.0,))
    assert daily_top.normalized_weights(1, 1, 2) == (0.25, 0.25, 0.5)
    for bad in ((-1, 1, 1), (0, 0, 0)):
        with pytest.raises(ValueError):
            daily_top.normalized_weights(*bad)


def test_score_band_rounding_modes(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    lo, hi = F.lit(0.0), F.lit(1.0)
    even = [r[0] for r in df.select(band_score(F.col("x"), lo, hi, "even")).collect()]
    up = [r[0] for r in df.select(band_score(F.col("x"), lo, hi, "up")).collect()]
    assert even == [70, 84, 99, None] and up == [70, 85, 99, None]
    assert [r[0] for r in df.select(band_score(F.col("x"), lo, lo, "up")).collect()] == [85, 85, 85, None]


def test_numbers_and_decimals(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("abc",), ("NaN",), ("Infinity",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number(F.col("s"))).collect()] == [1.5, 2.0, None, None, None, None]
    d = spark.createDataFrame([(1.00005,), (-1.00005,), (float("nan"),), (None,)], "x double")
    assert [str(r[0]) for r in d.select(decimal4(F.col("x"))).collect()] == ["1.0001", "-1.0001", "None", "None"]
    assert spark.range(1).select(half_up_at(F.lit(2.25), 1)).first()[0] == 2.3


def test_max_return_since_buy(spark):
    rows = [
        ("A", 1, 10.0, 11.0), ("A", 2, 10.0, 20.0), ("A", 3, 10.0, 20.0), ("A", 4, 10.0, None),
        ("B", 1, 10.0, 50.0), ("C", 1, 0.0, 1.0), ("C", 2, 5.0, 9.0),
    ]
    bars = spark.createDataFrame(
        [(t, dt.date(2020, 1, d), c, h) for t, d, c, h in rows], "ticker string, date date, close double, high double"
    )
    out = daily_top.add_max_return_since_buy(bars.drop("high"), bars)
    got = {(r.ticker, r.date.day): (r.max_return_since_buy, r.max_return_peak_date) for r in out.collect()}
    assert got[("A", 1)] == (1.0, "2020-01-02")  # first of two equal peaks
    assert got[("A", 2)] == (1.0, "2020-01-03")  # strictly after the pick
    assert got[("A", 3)] == (None, "") and got[("B", 1)] == (None, "")
    assert got[("C", 1)] == (None, "")  # no usable price


def test_daily_top_picks_are_stable_and_named(spark, make_bars):
    rng = np.random.default_rng(0)
    bars = make_bars({t: (100 + rng.normal(size=200).cumsum()).tolist() for t in ("A.KS", "B.KS", "C.KQ")})
    frame = bars.withColumn("f", F.col("close") % 7)
    master = spark.createDataFrame([("a.ks", " Alpha ")], "symbol string, name_ko string")
    out = daily_top.daily_top_n(frame, Model(("f",), (1.0,)), master, 2, start="2020-03-01", end="2020-03-10")
    rows = out.collect()
    assert len(rows) == 20 and {r.rank for r in rows} == {1, 2}
    assert {r.name for r in rows} <= {"Alpha", "B.KS", "C.KQ"}
    small = daily_top.daily_top_n(frame, Model(("f",), (1.0,)), master, 2, start="2020-03-01", end="2020-03-10", slot_rows=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, rows))
    with pytest.raises(ValueError):
        daily_top.daily_top_n(frame, Model(("f",), (1.0,)), master, 0)


def test_fold_plan_needs_enough_dates(spark, make_bars):
    assert walk_forward.fold_plan(make_bars({"A": [1.0] * 399})).count() == 0
    folds = walk_forward.fold_plan(make_bars({"A": [1.0] * 400})).orderBy("fold").collect()
    first = dt.date(2020, 1, 1)
    assert [(r.train_end - first).days + 1 for r in folds] == [int(400 * s) for s in (0.55, 0.65, 0.75, 0.85)]
    assert all(r.val_end > r.train_end for r in folds)


def frame_of_walks(make_bars, tickers, days, seed=2):
    rng = np.random.default_rng(seed)
    bars = make_bars({f"T{i}": (50 * np.exp(rng.normal(0, 0.05, days).cumsum())).tolist() for i in range(tickers)})
    return bars.withColumn("f", F.when(F.col("close") % 11 > 0.5, F.col("close") % 5)).withColumn("g", F.col("close") % 3)


CANDIDATES = "candidate_id long, features array<string>, weights array<double>"


def plain_scores(wf, fold, features, weights, frame):
    total = 0.0
    for c in wf.features:
        mapper = wf.mappers[fold][c]
        x = frame[c].to_numpy(float)
        at = np.where(np.isfinite(x), np.searchsorted(mapper.inner, x, side="right"), len(mapper.probs))
        total = total + dict(zip(features, weights)).get(c, 0.0) * np.array([*mapper.probs, mapper.base])[at]
    return np.clip(total, 1e-4, 1 - 1e-4)


def test_walk_forward_metrics_brute_force(spark, make_bars, monkeypatch):
    monkeypatch.setattr("barloom.operators.scoring.STEP", 100)
    monkeypatch.setattr("barloom.operators.scoring.HELD", 2)
    wf = walk_forward.WalkForward(frame_of_walks(make_bars, 8, 420), ["f", "g"], min_train_rows=100, min_val_rows=20)
    rng = np.random.default_rng(4)
    models = [(1, ["f"], [1.0]), (2, ["f", "g"], [0.3, 0.7]), (3, ["g", "f"], [-0.5, 1.5]), (4, ["g"], [0.0])]
    models += [(i, ["f", "g"], rng.uniform(0, 1, 2).tolist()) for i in range(5, 500)]
    table = spark.createDataFrame(models, CANDIDATES)
    got = {(r.candidate_id, r.fold): r for r in wf.fold_metrics(table, block=64).collect()}
    assert len(got) == len(models) * len(wf.folds)
    rows = wf.rows.toPandas()
    for fold in wf.folds:
        part = rows[(rows["date"] > fold.train_end) & (rows["date"] <= fold.val_end)]
        y = part["target_up"].to_numpy(float)
        assert (fold.val_rows, fold.val_base_rate) == (len(y), pytest.approx(y.mean()))
        for i, features, weights in models[:40]:
            p, one = plain_scores(wf, fold.fold, features, weights, part), got[i, fold.fold]
            hit = y[p >= np.sort(p)[-max(1, int(len(p) * 0.1))]].mean()
            safe = np.clip(p, 1e-5, 1 - 1e-5)
            assert one.brier == pytest.approx(((p - y) ** 2).mean())
            assert one.logloss == pytest.approx(-(y * np.log(safe) + (1 - y) * np.log(1 - safe)).mean())
            assert one.top_hit == pytest.approx(hit)
            assert one.lift == pytest.approx(hit / y.mean())
    plan = wf.fold_metrics(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row per candidate


def test_candidates_in_blocks(spark, make_bars):
    wf = walk_forward.WalkForward(frame_of_walks(make_bars, 4, 410), ["f"], min_train_rows=10, min_val_rows=5)
    table = spark.createDataFrame([(i, ["f"], [1.0 / i]) for i in range(1, 6)], CANDIDATES)
    one, many = wf.evaluate(table), wf.evaluate(table.repartition(3), block=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert walk_forward.unseen(table, table.limit(1)).count() == 0
    assert wf.evaluate(table.limit(0)).count() == 0
    for bad in (["f", "f"], [1.0]), (["h"], [1.0]):
        with pytest.raises(Exception, match="candidate 9"):
            wf.evaluate(spark.createDataFrame([(9, *bad)], CANDIDATES)).count()


def test_dropped_folds_say_why(spark, make_bars):
    frame = frame_of_walks(make_bars, 4, 410)
    days = walk_forward.day_counts(frame.withColumn("up", F.lit(1)), "up")
    reasons = lambda **limits: [r.dropped for r in walk_forward.fold_report(days, **limits).orderBy("fold").collect()]
    sizes = [int(410 * s) * 4 for s in (0.55, 0.65, 0.75, 0.85)]
    assert reasons(min_train_rows=sizes[1], min_val_rows=1) == ["few_train_rows", None, None, None]
    assert reasons(min_train_rows=1, min_val_rows=10**6) == ["few_validation_rows"] * 4
    few = walk_forward.fold_report(walk_forward.day_counts(frame.where("date < '2020-06-01'").withColumn("up", F.lit(1)), "up"))
    assert {r.dropped for r in few.collect()} == {"few_dates"}
    assert [r.dropped for r in walk_forward.fold_report(days, [(0.2, 0.1), (0.5, 0.0)], 1, 1).orderBy("fold").collect()] == ["few_train_dates", "no_validation_dates"]
    with pytest.raises(ValueError, match="few_train_rows"):
        walk_forward.WalkForward(frame, ["f"], min_train_rows=10**9)


def test_golden_final_score(spark):
    row = spark.range(1).select(variance.final_score(F.lit(92.3), F.lit(96.2))).first()
    assert row[0] == 93.4


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.03, 0.0300001, 0.1, 0.2, 0.21, None)], "x double")
    _, bounds, labels = variance.BUCKETS["momentum_bucket"]
    got = [r[0] for r in df.select(variance.bucket(F.col("x"), bounds, labels)).collect()]
    assert got == ["weak", "building", "building", "strong", "extreme", None]


def test_signal_score_by_hand(spark):
    df = spark.createDataFrame(
        [("A", 10.0, 9.0, 8.0, 7.0, 9.0, 5.0, 30.0, 2.0, 1.0), ("B", 1.0, 2.0, 3.0, 4.0, -1.0, -1.0, -1.0, None, None)],
        "ticker string, close double, sma20 double, sma60 double, sma120 double, ret_1d double, ret_5d double, ret_20d double,"
        " volume_ratio_20d double, breakout_ratio_20d double",
    )
    a, b = next_day.add_signal_score(df).orderBy("ticker").collect()
    assert a.score == 15 + 12 + 10 + 8 + 15 + 6 + 10 + 10 - 8
    assert a.probability_next_up == pytest.approx(28 + 0.72 * a.score, abs=0.005)
    assert a.reason.split(",")[0] == "close>sma20" and a.reason.endswith("overheated_1d")
    assert (b.score, b.probability_next_up, b.reason) == (0.0, 28.0, "")


def test_candidate_features_are_all_that_the_score_and_the_filter_read(make_bars):
    rng = np.random.default_rng(4)
    bars = make_bars({t: [float(c) for c in 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))] for t in "ABC"})
    rules = tier1.CandidateRules(0.0, 9.0, 0.0, 99.0, -9.0, -9.0, 9.0, -9.0, True)
    whole = tier1.tier1_features(bars)
    some = tier1.tier1_features(bars, only=tier1.CANDIDATE_FEATURES)
    assert "realized_vol20" in whole.columns and "realized_vol20" not in some.columns
    shown = ["ticker", "date", "tier1_composite_score", "candidate_rank"]
    a, b = (sorted(tuple(r) for r in tier1.buy_candidates(f, rules, per_date=True).select(*shown).collect()) for f in (whole, some))
    assert a and a == b


def many_series(make_bars):
    rng = np.random.default_rng(6)
    lengths = {"A": 90, "B": 70, "C": 19, "D": 1, "E": 20, "F": 64}
    return make_bars({t: [float(c) for c in 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))] for t, n in lengths.items()})


@pytest.mark.parametrize("only", [None, tier1.CANDIDATE_FEATURES])
def test_features_are_the_same_whether_written_or_not(make_bars, only):
    bars = many_series(make_bars)
    want, got = (tier1.tier1_features(bars, only=only, written=w) for w in (True, False))
    assert want.columns == got.columns
    want, got = (x.orderBy("ticker", "date").toPandas() for x in (want, got))
    assert len(got) == 90 + 70 + 20 + 64 and got.isna().equals(want.isna())
    for c in got.columns:
        np.testing.assert_array_equal(got[c], want[c]) if got[c].dtype == object else np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12)


def test_series_in_buckets_need_no_shuffle(spark, make_bars):
    bars = many_series(make_bars).union(make_bars({None: [1.0]})).repartition(3)
    table = staged_by(bars, "ticker")
    assert sorted(map(str, table.collect())) == sorted(map(str, bars.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("barloom")]
    out = technical.technical_indicators(table, batches=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert staged_by(bars.where("false"), "ticker").count() == 0


def test_queries_over_all_bars_write_no_more_than_they_read(spark, tmp_path):
    rows = [(k, 1, 1, k % 3, dt.datetime(2020, 1, 1) + dt.timedelta(days=k // 3), 2.0, 100.0 + k % 7) for k in range(120)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = os.path.dirname(urlparse(shared_path(spark, "any")).path)

    def written(name):
        before = set(os.listdir(folder))
        out = queries()[name](spark, str(tmp_path))
        assert out.count()
        return out, [set(spark.read.parquet(f"{folder}/{d}").columns) for d in set(os.listdir(folder)) - before if d.startswith("stage-")]

    bars = {"ticker", "date", "open", "high", "low", "close", "volume", "adj_close"}
    out, tables = written("technical_indicators")
    assert tables == [bars] and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    _, tables = written("tier1_features")
    assert bars in tables and not [t for t in tables if t & {"sma20", "bb_mid20"}]
    _, tables = written("tier1_summary")
    assert bars in tables and set(tier1.SUMMARY_COLUMNS) in tables and not [t for t in tables if "bb_mid20" in t]
