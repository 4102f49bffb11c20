"""Ranks, quantiles and numbering: groups cut into slots and whole ones must equal brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import quantiles, ranking


def skewed(spark, rows=4000, seed=3):
    """Two groups; one holds nine tenths of the rows, and one value a third of those. Some nulls."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        group = "hot" if rng.random() < 0.9 else "cold"
        roll = rng.random()
        value = 7.0 if roll < 0.33 else None if roll < 0.38 else rng.lognormvariate(0, 3) - 2
        data.append((i, group, value))
    return spark.createDataFrame(data, "id long, g string, x double")


@pytest.mark.parametrize("slot_rows", [10_000_000, 500, 40])
@pytest.mark.parametrize("nulls", ["lowest", "keep"])
def test_percent_rank_matches_pandas(spark, slot_rows, nulls):
    df = skewed(spark)
    got = ranking.percent_ranks(df, ["g"], {"p": "x"}, nulls=nulls, slot_rows=slot_rows)
    assert got.count() == 4000
    frame = got.toPandas().sort_values("id").reset_index(drop=True)
    x = frame["x"].fillna(-np.inf) if nulls == "lowest" else frame["x"]
    want = x.groupby(frame["g"]).rank(pct=True, method="average")
    pd.testing.assert_series_equal(frame["p"], want, check_names=False)


def test_percent_rank_descending_and_several_columns(spark):
    df = skewed(spark, 500).withColumn("y", F.col("id") % 7)
    for slot_rows in (10_000, 100, 20):
        got = ranking.percent_ranks(
            df, ["g"], {"p": "x", "q": "y"}, nulls="keep", ascending=False, slot_rows=slot_rows
        ).toPandas()
        by = got.groupby("g")
        pd.testing.assert_series_equal(got["p"], by["x"].rank(pct=True, ascending=False), check_names=False)
        pd.testing.assert_series_equal(got["q"], by["y"].rank(pct=True, ascending=False), check_names=False)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_match_numpy(spark, accuracy):
    df = skewed(spark).withColumn("y", F.col("id") % 13).withColumn("none", F.lit(None).cast("double"))
    steps = [i / 20 for i in range(21)] + [0.333]
    groups = {"hot": F.col("g") == "hot", "cold": F.col("g") == "cold", "half": F.col("id") < 2000, "no": F.lit(False)}
    got = quantiles.exact_quantiles(df, ["x", "y", "none"], steps, groups, accuracy)
    frame = df.toPandas()
    sets = {"hot": frame["g"] == "hot", "cold": frame["g"] == "cold", "half": frame["id"] < 2000}
    assert set(got) == {(g, c) for g in sets for c in "xy"}
    for g, rows in sets.items():
        for c in "xy":
            np.testing.assert_allclose(got[g, c], np.quantile(frame[rows][c].dropna(), steps), rtol=1e-12)


def test_quantiles_where_the_summary_is_off(spark, monkeypatch):
    """Brackets that miss their ranks are made good by another scan."""
    df = skewed(spark, 600)
    monkeypatch.setattr(quantiles, "_brackets", lambda *_: [(-1.0, 0.0), (500.0, 501.0)])
    got = quantiles.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 1.0])
    np.testing.assert_allclose(got[0, "x"], np.quantile(df.toPandas()["x"].dropna(), [0.0, 0.1, 0.5, 1.0]))


def test_number_rows_is_dense_and_ordered(spark):
    df = skewed(spark, 1500).repartition(7)
    got = ranking.number_rows(df, [F.col("x").desc_nulls_last(), F.col("id")], "n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    frame = got.toPandas()
    want = frame.sort_values(["x", "id"], ascending=[False, True], na_position="last")
    assert want["n"].tolist() == list(range(1, 1501))
    assert ranking.number_rows(df.limit(0), [F.col("id")], "n").count() == 0


def test_heavy_values_are_borders_and_travel_without_the_ladder(spark):
    df = skewed(spark).where("g = 'hot'")
    ranked = ranking.percent_ranks(df, ["g"], {"p": "x"}, nulls="lowest", slot_rows=300)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("_ladder" in line for line in exchanges)
    ladder = ranking._ladders(df.withColumn("_x0", F.coalesce("x", F.lit(float("-inf")))), ["g"], ["_x0"], 300).first()._ladder._x0
    heavy = ladder.borders.index(7.0)
    assert ladder.slots[2 * heavy + 1].n == df.where("x = 7").count() and ladder.size == df.count()


def test_ties_keep_average_rank_and_null_lowest(spark):
    df = spark.createDataFrame([("d", v) for v in (1.0, 2.0, 2.0, None)], "date string, x double")
    low = {r.x: r.p for r in ranking.percent_ranks(df, ["date"], {"p": "x"}, nulls="lowest").collect()}
    keep = {r.x: r.p for r in ranking.percent_ranks(df, ["date"], {"p": "x"}, nulls="keep").collect()}
    assert low == {None: 0.25, 1.0: 0.5, 2.0: 0.875}
    assert keep == {None: None, 1.0: pytest.approx(1 / 3), 2.0: pytest.approx(2.5 / 3)}


def test_top_per_group_limits_before_the_shuffle(spark):
    df = skewed(spark, 300)
    top = ranking.top_per_group(df, ["g"], [F.col("x").desc(), F.col("id")], 3)
    assert top.groupBy("g").count().agg(F.max("count")).first()[0] == 3
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("below", [False, True])
def test_edges_are_counted_in_generated_code(spark, below):
    edges = [[], [0.5], [0.0, 0.0, 1.0, 2.0, 5.0]]
    rows = [(i, x) for i in (0, 1, 2, 3, None) for x in (-1.0, 0.0, 0.5, 1.0, 3.0, 5.0, 9.0, None)]
    df = spark.createDataFrame(rows, "i int, x double")
    table = F.get(quantiles.edge_table(edges), F.col("i"))
    out = quantiles.add_edges_passed(df, {"n": (F.col("x"), table)}, 5, below=below)
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    side = "left" if below else "right"
    for row in out.collect():
        known = row.i in (1, 2) and row.x is not None
        assert row.n == (np.searchsorted(edges[row.i], row.x, side=side) if known else 0)


def test_bins_and_slots_need_no_lambda(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), (F.col("id") % 97).cast("double").alias("x"))
    out = ranking.percent_ranks(df, ["k"], {"p": "x"}, nulls="keep", slot_rows=100)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
