"""Steps whose cost must not grow faster than the tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelloom.functions import windows
from panelloom.operators import backtest, explain, features, news, opinions
from panelloom.plans import catalogue
from panelloom.sources import adapters

D = dt.date


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_values_equal_pandas_over_series_and_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", D(2000, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.1 else float(round(rng.normal(), 1))) for k in range(4) for i in range(150 + 40 * k)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double").repartition(3)
    kinds = {"mean": 200, "min": 100, "max": 7, "deviation": 20, "rank": 60}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = windows.rolling(df, {k: (k, "x", n, 5) for k, n in kinds.items()} | {"_twice": lambda made: 2 * made["deviation"], "again": ("mean", "_twice", 30, 3)}, ["symbol"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = got.sort_values(["symbol", "date"])
    for _, g in got.groupby("symbol"):
        x = g["x"].astype(float)
        want = {k: x.rolling(n, min_periods=5) for k, n in kinds.items()}
        want = {"mean": want["mean"].mean(), "min": want["min"].min(), "max": want["max"].max(), "deviation": want["deviation"].std(), "rank": want["rank"].rank(pct=True).where(x.notna())}
        want["again"] = (2 * want["deviation"]).rolling(30, min_periods=3).mean()
        for k, w in want.items():
            pd.testing.assert_series_equal(g[k].astype(float), w, check_names=False, rtol=1e-9, atol=1e-12)
    assert "_twice" not in got.columns


def test_equal_values_have_no_deviation(spark):
    df = spark.range(40).selectExpr("'a' as symbol", "date_add(date'2020-01-01', cast(id as int)) as date", "0.1D as x")
    assert {r["s"] for r in windows.rolling(df, {"s": ("deviation", "x", 20, 20)}, ["symbol"]).collect()} == {None, 0.0}


@pytest.mark.parametrize("table", ["regime", "features"])
def test_long_frames_are_not_read_again_at_every_row(spark, table):
    bars = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, date date, open double, high double, low double, close double, volume double")
    macro = spark.createDataFrame([(D(2020, 1, 1), 1.0, 0.0, 10.0, 0.5)], "date date, index_close double, index_mom_20d double, vix double, vix_percentile double")
    text = plan(features.regime_table(bars, macro) if table == "regime" else features.window_features(bars))
    assert "RowFrame, -19," not in text and "RowFrame, -199," not in text and "RowFrame, -251," not in text


def test_attribution_reads_the_opinions_once(spark):
    ops = spark.createDataFrame([("a", D(2020, 1, 1), "x", 0.5, 0.4, False), ("a", D(2020, 1, 1), "y", -1.0, 0.1, False), ("a", D(2020, 1, 2), "x", 0.0, 0.0, True)], "symbol string, date date, agent string, stance double, confidence double, abstained boolean")
    shares = explain.attribution(ops)
    assert "Join" not in plan(shares)
    assert [pytest.approx(r["share"]) for r in shares.orderBy("date", "agent").collect()] == [0.4, -0.2, 0.0]


@pytest.mark.parametrize("name", ["k2_cost_gated_sizes", "k8_demoted_actions", "x3_text_consistency"])
def test_sizes_read_one_written_regime_table(spark, name):
    assert "lineitem" not in plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001")) and "MapInArrow" not in plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))


def test_a_track_is_dealt_by_its_number_of_rows(spark):
    rows = [("p", D(2020, 1, 1 + i), f"s{k}", float((i * k) % 3), 0.01 * ((i + k) % 5 - 2)) for i in range(20) for k in range(9)]
    signals = spark.createDataFrame(rows, "strategy string, date date, symbol string, score double, fwd_ret double")
    whole, some = (backtest.tracks(backtest.weights(signals, parts=n), parts=n) for n in (None, 7))
    assert "RepartitionByExpression [strategy" in plan(some) and ", 7" in plan(some)
    got, want = (t.orderBy("date").toPandas() for t in (some, whole))
    pd.testing.assert_frame_equal(got, want)


def test_partitions_grow_with_line_items(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert adapters.parts(spark, "/root/testdata/sf0.001") is None
    assert adapters.parts(spark, "/root/testdata/sf0.001", n // 20) in (20, 21)


def test_runs_of_an_ensemble_are_averaged_where_their_day_is(spark):
    df = catalogue.queries()["m4_seed_ensemble"](spark, "/root/testdata/sf0.001")
    assert "Union" not in plan(df)
    assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(date") == 0


def test_a_regime_opinion_is_plain_arithmetic(spark):
    schema = "symbol string, date date, trend double, rel_strength_60d double, pos_52w double, index_mom_20d double, vol_percentile double, vix_percentile double, vol_20 double"
    rows = [("a", D(2020, 1, 1), 1.0, 0.1, 0.6, None, None, 0.5, 0.3), ("b", D(2020, 1, 1), -1.0, 0.4, 0.1, 0.05, 0.2, None, None), ("c", D(2020, 1, 1), None, 0.1, 0.6, 0.1, 0.1, 0.1, 0.2)]
    df = opinions.regime(spark.createDataFrame(rows, schema), ("vol_20",))
    assert "lambda" not in plan(df)
    got = {r["symbol"]: (r["stance"], r["confidence"], r["abstained"], r["vol_20"]) for r in df.collect()}
    for name, votes, calm, vol in (("a", [1.0, 0.5, 0.2], 0.8, 0.3), ("b", [-1.0, 1.0, -0.8, 0.4], 0.9, None)):
        assert got[name] == (pytest.approx(np.mean(votes)), pytest.approx((1 - np.std(votes)) * calm), False, vol)
    assert got["c"] == (0.0, 0.0, True, 0.2)


def test_bars_meet_the_sessions_without_a_shuffle_by_date(spark):
    bars = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, date date, open double, high double, low double, close double, volume double")
    macro = spark.createDataFrame([(D(2020, 1, 1), 1.0, 0.0, 10.0, 0.5)], "date date, index_close double, index_mom_20d double, vix double, vix_percentile double")
    assert "strategy=broadcast" in plan(features.regime_table(bars, macro))


def test_scenarios_make_their_regime_table_once(spark):
    df = catalogue.queries()["c1_c5_scenarios"](spark, "/root/testdata/sf0.001")
    assert plan(df).count("MapInArrow") == 1


def test_a_title_is_shuffled_once_however_many_terms_it_holds(spark):
    rows = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else None) for i in range(6)], "id int, title string")
    names = spark.createDataFrame([("a", "alpha"), ("a", "lpha"), ("b", "beta"), ("g", "delta")], "symbol string, term string")
    got = news.tag_companies(rows, names)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert sum("title#" in line for line in text.splitlines() if "Exchange hashpartitioning" in line) <= 1 and text.count("Exchange hashpartitioning(id#") == 0
    assert sorted(map(tuple, got.select("id", "tagged").collect())) == [(i, s) for i in (1, 3, 5) for s in "ab"]
