"""Long frames in Arrow batches against Spark's own frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling
from barloom.functions.frames import Frames
from barloom.plans import tier1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for ticker, n in ((None, 30), ("a", 70), ("b", 1), ("c", 25), ("d", 11)):
        for i, x in enumerate(rng.normal(0, 3, n).tolist()):
            gap = ticker == "a" and i in (5, 6, 40) or ticker == "d"
            out.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(i), x, None if gap else x * x, i * 7))
    return spark.createDataFrame(out, "ticker string, date date, x double, y double, v long").repartition(3)


def columns(f):
    c = {}
    for name in ("x", "y", "v"):
        for dense in (True, False):
            for agg in ("mean", "total", "highest", "lowest"):
                c[f"{name}_{agg}_{dense}"] = getattr(f, agg)(F.col(name).cast("double"), 9, shift=int(dense), dense=dense)
            for ddof in (0, 1):
                c[f"{name}_std{ddof}_{dense}"] = f.std(F.col(name).cast("double"), 10, ddof=ddof, dense=dense)
    change = F.col("x") - f.lag("x")
    c["built"] = f.mean(f.highest("x", 9, dense=True) - change, 8)
    mean = f.mean(F.col("x"), 8, dense=True)
    c["away"] = F.when(mean.isNotNull(), f.deviation(F.col("x"), mean, 8))
    return [x.alias(name) for name, x in c.items()]


@pytest.mark.parametrize("batch_rows", [1, 20, 50_000])
def test_batches_equal_spark_frames(rows, monkeypatch, batch_rows):
    monkeypatch.setattr(rolling, "BATCH_ROWS", batch_rows)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got, want = [
            sorted(map(repr, f.select(rows, "ticker", "date", *columns(f)).collect())) for f in (Frames(batches=True), Frames())
        ]
    finally:
        rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_long_frames_leave_the_windows(make_bars):
    bars = make_bars({"A": [float(i) for i in range(30)]})
    plan = tier1.symbol_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RowFrame, -19" not in plan and "RowFrame, -59" not in plan
    some = tier1.symbol_features(bars, ["ret_5d", "rvol20"])
    assert some.columns == [*bars.columns, "ret_5d", "rvol20"]
    assert "_w" not in "".join(some.columns) and some.count() == 30


def test_what_no_column_needs_is_left_out(make_bars):
    f = Frames(batches=True)
    f.std(F.col("close"), 20, ddof=1)
    out = f.select(make_bars({"A": [1.0, 2.0]}), "ticker", f.lag("close").alias("before"))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.before for r in out.collect()] == [None, 1.0]
