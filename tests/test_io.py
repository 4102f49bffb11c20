"""Readers, writers, upserts, incremental loads and the file stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import symbols
from barloom.operators import merge
from barloom.plans import analytics, ingest, master, relational, serving
from barloom.sources import files, snapshots, tables, writers
from barloom.streaming import feed


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# --- readers ---------------------------------------------------------------------------


def test_csv_folder_with_mixed_headers(spark, tmp_path):
    write(tmp_path / "005930.ks.csv", "Date,Open,High,Low,Close,Volume,Adj Close\n2020-01-02,1,2,0.5,1.5,10,1.4\n2020-01-03,1,2,0.5,bad,10,1\n2020-01-02,9,9,9,9,9,9\n")
    write(tmp_path / "B.csv", "volume, close ,low,high,open,date\n,2,1,3,2,2020-01-02 00:00:00+09:00\n")
    write(tmp_path / "BAD.csv", "date,open,close\n2020-01-01,1,1\n")
    rows = {(r.ticker, str(r.date)): r for r in files.read_ticker_csvs(spark, str(tmp_path)).collect()}
    assert set(rows) == {("005930.KS", "2020-01-02 00:00:00"), ("B", "2020-01-01 15:00:00")}
    last = rows[("005930.KS", "2020-01-02 00:00:00")]
    assert (last.open, last.adj_close) == (9.0, 9.0)
    b = rows[("B", "2020-01-01 15:00:00")]
    assert b.volume is None and b.adj_close == 2.0
    with pytest.raises(ValueError, match="missing required"):
        files.read_ticker_csvs(spark, str(tmp_path), on_bad="raise")


def test_tolerant_csv(spark, tmp_path):
    write(tmp_path / "X.csv", "Time-Stamp,OPEN,High,low,CLOSE,Vol ume\n2020-01-02,1,2,1,2,\n")
    row = files.read_ticker_csvs(spark, str(tmp_path), tolerant=True).first()
    assert (row.ticker, row.volume, row.close) == ("X", 0.0, 2.0)


def test_table_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", "A", 1.0, 1.0, 1.0, 1.0, 5.0)], "Date string, Ticker string, Open double, High double, Low double, Close double, Volume double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert files.read_table(spark, str(tmp_path / "t.parquet")).columns == ["date", "ticker", "open", "high", "low", "close", "volume"]
    assert files.read_table(spark, str(tmp_path / "t.csv")).first().volume == 5.0
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")
    with pytest.raises(KeyError, match="available"):
        files.resolve_columns(["a"], {"b": ["b", "B"]})


def test_wide_matrix_either_level_order(spark):
    one = spark.createDataFrame([("d1", 1.0, 2.0, 3.0, 4.0, 5.0, None)], "Date string, `Open|A.KS` double, `High|A.KS` double, `Low|A.KS` double, `Close|A.KS` double, `Volume|A.KS` double, `Close|B` double")
    two = spark.createDataFrame([("d1", 4.0, 9.0)], "Date string, `A.KS|Close` double, `B|Close` double")
    a = files.wide_to_long(one).collect()
    assert [tuple(r) for r in a] == [("d1", "A.KS", 1.0, 2.0, 3.0, 4.0, 5.0)]
    b = files.wide_to_long(two).orderBy("ticker").collect()
    assert [(r.ticker, r.open, r.close) for r in b] == [("A.KS", None, 4.0), ("B", None, 9.0)]


def test_vendor_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 5)], "Date timestamp, Open double, High double, Low double, Close double, Volume long")
    assert files.from_vendor(df, "A").first().adj_close == 1.0


def test_model_file(spark, tmp_path):
    body = {"best": {"feature_names": ["a", "b"], "weights": [0.4, 0.6]}}
    for i, payload in enumerate((body, body["best"])):
        model = tables.load_model(spark, write(tmp_path / f"m{i}.json", json.dumps(payload, indent=1)))
        assert model.features == ("a", "b") and model.weights == (0.4, 0.6)
    with pytest.raises(ValueError):
        tables.load_model(spark, write(tmp_path / "bad.json", json.dumps({"feature_names": ["a"], "weights": [1, 2]})))
    with pytest.raises(ValueError):
        tables.load_model(spark, write(tmp_path / "none.json", json.dumps({"x": 1})))
    for run in ("run_1", "run_2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        write(tmp_path / "runs" / run / "best_logic.json", json.dumps(body))
    assert "run_2" in snapshots.latest_model_path(spark, str(tmp_path / "runs"))


def test_snapshots(spark, tmp_path):
    head = "ticker,name\n"
    write(tmp_path / "tier1_buy_candidates_20200101_000000.csv", "﻿" + head + 'A,"x, ""y"" "\n\n')
    write(tmp_path / "tier1_buy_candidates_20200102_000000.csv", head)
    write(tmp_path / "daily_top5_recommendations_20200101.csv", head)
    write(tmp_path / "daily_top5_recommendations_20191201_to_20200103.csv", head)
    write(tmp_path / "other.csv", head)
    folder = str(tmp_path)
    assert snapshots.latest_snapshot(spark, folder, snapshots.CANDIDATES).endswith("20200102_000000.csv")
    assert snapshots.latest_snapshot(spark, folder, snapshots.DAILY_PICKS).endswith("to_20200103.csv")
    assert snapshots.latest_snapshot(spark, folder, snapshots.CANDIDATES, "other.csv") is None
    assert snapshots.latest_snapshot(spark, folder, snapshots.FEATURES) is None
    row = snapshots.latest_nonempty_snapshot(spark, folder, snapshots.CANDIDATES).first()
    assert row.ticker == "A" and row["name"].startswith('x, "y"')


# --- lake ---------------------------------------------------------------------------------


def source_rows(spark, rows):
    schema = "ticker string, date timestamp, open double, high double, low double, close double, volume long, adj_close double"
    return spark.createDataFrame([(t, dt.datetime(y, m, d), c, c, c, c, v, None) for t, y, m, d, c, v in rows], schema)


@pytest.mark.parametrize("layout", ["year", "year_ticker"])
def test_lake_round_trip_and_idempotent_merge(spark, tmp_path, layout):
    root = str(tmp_path / "lake")
    ingest.lake_export(source_rows(spark, [(" 005930 ", 2020, 1, 2, 1.0, 5), ("A", 2021, 1, 2, 2.0, 5), (None, 2021, 1, 2, 2.0, 5)]), root, layout)
    lake = files.read_lake(spark, root)
    assert {(r.ticker, r.year, r.adj_close) for r in lake.collect()} == {("005930", 2020, 1.0), ("A", 2021, 2.0)}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "year=2020").rglob("*.parquet")}
    new = source_rows(spark, [("A", 2021, 1, 2, 3.0, 7), ("A", 2021, 1, 3, 4.0, 7), ("B", 2022, 1, 3, 4.0, 7)])
    for _ in range(2):
        ingest.merge_into_lake(spark, new, root, layout)
        got = {(r.ticker, r.date.day, r.year, r.close) for r in files.read_lake(spark, root).collect()}
        assert got == {("005930", 2, 2020, 1.0), ("A", 2, 2021, 3.0), ("A", 3, 2021, 4.0), ("B", 3, 2022, 4.0)}
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "year=2020").rglob("*.parquet")}
    assert before == after  # an untouched year is not rewritten


def test_slice_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "lake")
    ingest.lake_export(source_rows(spark, [("A", y, 1, 2, 1.0, 5) for y in (2019, 2020, 2021)]), root)
    picked = analytics.report("get_prices", files.read_lake(spark, root), ticker="A", start="2020-01-01", end="2021-01-01")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert picked.count() == 1 and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(ticker,A)" in plan
    with pytest.raises(KeyError, match="known"):
        analytics.report("nope", picked)


def test_stream_feed_is_idempotent(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "lake")
    batch = source_rows(spark, [("A", 2020, 1, 2, 1.0, 5), ("A", 2020, 1, 3, 2.0, 5)])
    batch.write.parquet(str(inbox / "b1"))
    late = source_rows(spark, [("A", 2020, 1, 2, 9.0, 5)])
    stream = lambda: feed.bar_stream(spark, str(inbox / "*"))
    feed.start_feed(stream(), root, str(tmp_path / "cp")).awaitTermination()
    late.write.parquet(str(inbox / "b2"))
    for folder in ("cp", "cp", "cp2"):  # the last replays everything from scratch
        feed.start_feed(stream(), root, str(tmp_path / folder)).awaitTermination()
    got = sorted((r.date.day, r.volume) for r in files.read_lake(spark, root).collect())
    assert got == [(2, 5), (3, 5)]


def test_refresh_runs_a_report(spark, tmp_path):
    root = str(tmp_path / "lake")
    out = ingest.refresh(
        spark, root, initial=source_rows(spark, [("A", 2020, 1, 2, 1.0, 5)]),
        incoming=source_rows(spark, [("A", 2020, 1, 3, 4.0, 5)]), name="high_low_52_week",
    )
    assert tuple(out.first()) == ("A", 4.0, 1.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "2020-01-02", 'say "hi", x'), ("B", "2020-01-01", None)], "ticker string, date string, note string")
    writers.write_sorted(df, str(tmp_path / "s"))
    assert [r.ticker for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["B", "A"]
    writers.write_csv(df, str(tmp_path / "c"))
    assert snapshots.read_snapshot(spark, str(tmp_path / "c")).orderBy("ticker").first().note == 'say "hi", x'
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    bars = df.select("ticker", F.to_timestamp("date").alias("date"))
    for _ in range(2):
        writers.append_days(bars, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    writers.compact_years(bars, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


# --- upserts and plans ----------------------------------------------------------------------


def test_upsert_keeps_created_and_takes_last(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    have = spark.createDataFrame([("A", 1, 1.0, "keep", old, old), ("B", 1, 1.0, "keep", old, old)], "symbol string, d int, x double, extra string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("A", 1, 5.0, 1), ("A", 1, 6.0, 2), ("C", 1, 7.0, 1)], "symbol string, d int, x double, seq int")
    stamp = F.lit(now)
    got = merge.upsert(have, new, ["symbol", "d"], stamp, ["seq"])
    rows = {r.symbol: (r.x, r.extra, r.created_at, r.updated_at) for r in got.collect()}
    assert rows == {"A": (6.0, "keep", old, now), "B": (1.0, "keep", old, old), "C": (7.0, None, now, now)}
    again = merge.upsert(got, new, ["symbol", "d"], stamp, ["seq"])
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_range_replace_only_inside_the_range(spark):
    have = spark.createDataFrame([("A", d, 0.0) for d in range(1, 7)] + [("B", 3, 0.0)], "symbol string, trade_date int, x double")
    new = spark.createDataFrame([("A", 2, 1.0), ("A", 4, 1.0)], "symbol string, trade_date int, x double")
    got = sorted((r.symbol, r.trade_date, r.x) for r in merge.range_replace(have, new).collect())
    assert got == [("A", 1, 0.0), ("A", 2, 1.0), ("A", 4, 1.0), ("A", 5, 0.0), ("A", 6, 0.0), ("B", 3, 0.0)]


def test_restart_has_no_warm_up_gap(spark, make_bars):
    closes = [100.0 + (i * 7) % 13 for i in range(135)]
    bars = make_bars({"A": closes})
    cut = dt.date(2020, 1, 1) + dt.timedelta(days=129)
    stored, new = bars.where(F.col("date") <= cut), bars.where(F.col("date") > cut)
    part = ingest.incremental_features(stored, new, relational.relational_features).orderBy("trade_date").collect()
    full = relational.relational_features(bars).orderBy("trade_date").collect()[-5:]
    assert part == full and all(r.sma_120 is not None for r in part)


def test_incremental_plan_modes(spark, make_bars):
    bars = make_bars({"A": [1.0] * 10})
    wanted = spark.createDataFrame([(" a ",), ("B",), ("",)], "ticker string")
    end = F.lit(dt.date(2020, 1, 10))
    rows = {r.ticker: (r.start_date.isoformat(), r.skip) for r in ingest.incremental_plan(wanted, bars, "2010-01-01", end).collect()}
    assert rows == {"A": ("2020-01-11", True), "B": ("2010-01-01", False)}
    full = ingest.incremental_plan(wanted, bars, "2010-01-01", end, full=True)
    assert {r.start_date.isoformat() for r in full.collect()} == {"2010-01-01"}


def test_symbol_master_codes(spark):
    listing = spark.createDataFrame([("5930.0", " S "), ("5930", "dup"), ("ABC", "x")], "Code string, Name string")
    rows = master.symbol_master({"KOSPI": listing, "KOSDAQ": listing.limit(1)}).collect()
    assert [(r.market, r.symbol) for r in rows] == [("KOSDAQ", "005930.KQ"), ("KOSPI", "005930.KS")]


def test_symbol_text(spark):
    df = spark.createDataFrame([("A.KS",), ("A.KQ",), ("AAPL",)], "s string")
    x = F.col("s")
    got = df.select(symbols.country_of(x), symbols.currency_of(x), symbols.market_label(x), symbols.bare_code(x)).collect()
    assert [tuple(r) for r in got] == [("KR", "KRW", "코스피", "A"), ("KR", "KRW", "코스닥", "A"), ("US", "USD", "", "AAPL")]
    assert spark.range(1).select(symbols.split_tickers(F.lit(" a, ,b "))).first()[0] == ["A", "B"]
    assert symbols.checked_day("2020-1-1") is None and symbols.checked_day(" 2020-01-01 ") == "2020-01-01"


# --- serving -----------------------------------------------------------------------------------


CANDS = "ticker string, date string, candidate_rank double, tier1_composite_score double, ret_1d double, ret_5d double"


def test_home_rankings_and_search(spark, make_bars):
    cands = spark.createDataFrame(
        [("005930.KS", "2026-02-11 00:00:00", 1.0, 2.0, 0.01, 0.052), ("000660.KS", "2026-02-11", 2.0, 1.0, 0.03, None)], CANDS
    )
    listed = spark.createDataFrame([("KOSPI", "005930", "005930.KS", "Samsung")], "market string, ticker string, symbol string, name_ko string")
    top = serving.home_rankings(cands, listed).orderBy("rank").collect()
    assert [(r.rank, r.name, r.confluence_score, r.win_rate, r.avg_return) for r in top] == [
        (1, "Samsung", 99, 95.0, 5.2), (2, "000660.KS", 70, 55.0, 3.0),
    ]
    bars = make_bars({"000100.KQ": [1.0, 2.0]})
    asked = spark.createDataFrame([("005930",), ("000100",), ("nope",), (" ",)], "symbol string")
    found = {r.input: r for r in serving.symbol_search(asked, cands, listed, bars).collect()}
    assert set(found) == {"005930", "000100"}
    assert (found["005930"].sector, found["005930"].ranking_date, found["005930"].rank) == ("KOSPI", "2026-02-11", 1)
    assert (found["000100"].ticker, found["000100"].ranking_date, found["000100"].rank) == ("000100.KQ", "2020-01-02", None)


def test_daily_payload_from_text_snapshot(spark):
    rows = [
        ("2026-02-10", "1", "a.ks", "", "10", "0.6", "2500000000", "0.0125", "84.5", "oops"),
        ("2026-02-10", "2", "B.KS", "Bee", "10", "0.5", "", "", "", ""),
        ("2026-02-11 00:00", "1", "C.KS", "Cee", "10", "0.5", "1", "-0.5", "70", "2026-02-12"),
        ("bad", "1", "D", "D", "1", "1", "", "", "", ""),
        ("2026-02-11", "x", "E", "E", "1", "1", "", "", "", ""),
    ]
    snap = spark.createDataFrame(
        rows, "Date string, rank string, Ticker string, name string, Close string, prob_up_next_day string, trading_value string, ret_1d string, ai_score string, max_return_peak_date string"
    )
    items = serving.daily_items(snap, "en", start="not a date", per_day=1)
    days = serving.daily_payload(items).collect()
    assert [(d.date, len(d["items"])) for d in days] == [("2026-02-11", 1), ("2026-02-10", 1)]
    a = days[1]["items"][0]
    assert (a.id, a.symbol, a.name, a.ai_score) == ("2026-02-10-A.KS-1", "A.KS", "A.KS", 85)
    assert a.reasoning.startswith("Turnover 25eok KRW (top -), 1D return +1.25% (top -)") and a.reasoning.endswith("(peak -).")
    korean = serving.daily_items(snap, None, per_day=1).where("symbol = 'A.KS'").first().reasoning
    assert korean.startswith("거래대금 25억(상위 -)")
    assert [r.symbol for r in serving.latest_day_items(items).collect()] == ["C.KS"]


# --- cases that clean inputs do not show ---------------------------------------------------


def test_a_file_without_a_required_column_is_seen(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,1,1,1,5\n")
    (tmp_path / "B.csv").write_text("Date,High,Low,Close,Volume\n2020-01-01,1,1,1,5\n")
    assert [r.ticker for r in files.read_ticker_csvs(spark, str(tmp_path)).collect()] == ["A"]
    with pytest.raises(ValueError, match="open"):
        files.read_ticker_csvs(spark, str(tmp_path), on_bad="raise")


def test_snapshots_keep_their_own_header(spark, tmp_path):
    (tmp_path / "tier1_buy_candidates_20200101_000000.csv").write_text("ticker,date,close\nOLD,2020-01-01,1\n")
    (tmp_path / "tier1_buy_candidates_20200102_000000.csv").write_text("date,ticker,close\n2020-01-02,NEW,2\n")
    (tmp_path / "tier1_buy_candidates_20200103_000000.csv").write_text("date,ticker,close\n")
    row = snapshots.latest_nonempty_snapshot(spark, str(tmp_path), snapshots.CANDIDATES).first()
    assert (row["ticker"], row["date"]) == ("NEW", "2020-01-02")


def test_the_row_that_arrived_last_wins(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = source_rows(spark, [("A", 2020, 1, 2, 1.0, 100), ("A", 2020, 1, 2, 2.0, 50)])
    with pytest.raises(ValueError, match="arrived"):
        ingest.merge_into_lake(spark, rows, root)
    arrived = rows.withColumn("seq", F.when(F.col("close") == 2.0, 2).otherwise(1))
    ingest.merge_into_lake(spark, arrived, root, order=["seq"])
    assert [(r.close, r.volume) for r in files.read_lake(spark, root).collect()] == [(2.0, 50)]


def test_features_after_a_correction_and_a_gap(spark, make_bars):
    bars = make_bars({"A": [100.0 + i for i in range(200)], "B": [5.0] * 30})
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=d) for d in (150, 199)]
    fixed = bars.where((F.col("ticker") == "A") & F.col("date").isin(days)).withColumn("close", F.col("close") + 1)
    whole = bars.join(fixed.select("ticker", "date"), ["ticker", "date"], "left_anti").unionByName(fixed)
    want = relational.relational_features(whole).where((F.col("symbol") == "A") & (F.col("trade_date") >= days[0]))
    got = ingest.incremental_features(bars, fixed, relational.relational_features)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 50
