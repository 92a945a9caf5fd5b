"""Findings of round 4: small inputs, and steps whose disk and memory grew faster than the input."""

import datetime as dt
import math
import os
import pickle
import re
from functools import reduce

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import tables
from panelloom.operators import backtest, boosting, features, sizing, walkforward
from panelloom.plans import catalogue
from panelloom.sources import adapters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _row(values):
    return tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5g}" if isinstance(v, float) else str(v) for v in values)


def both(spark, name, sf):
    """A query's rows and those of its SQL."""
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    return sorted(_row(r[c] for c in cols) for r in df.collect()), sorted(_row(r[names.index(c)] for c in cols) for r in found.fetchall())


@pytest.mark.parametrize("docs", [0, 8, 100])
def test_predictability_of_few_events_equals_its_sql(spark, tmp_path, docs):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.connect().execute(f"copy (select * from '{SF}/documents.parquet' where doc_id < {docs}) to '{tmp_path}/documents.parquet' (format parquet)")
    got, want = both(spark, "e11_predictability", str(tmp_path))
    assert len(want) == 1 and got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_tracks_from_counts_are_tracks_of_weights(spark, seed):
    """With days that a strategy or all of them lack, names that come back, and days without a name."""
    rng = np.random.default_rng(seed)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    rows = []
    for k in range(7):
        for i, d in enumerate(days):
            if rng.random() < (0.15 if i % 4 == 3 else 0.6):
                rows.append((f"s{k}", d, None if rng.random() < 0.1 else float(rng.normal(0, 0.02)), None if rng.random() < 0.2 or i in (0, 9) else bool(rng.random() < 0.6), bool(i != 12 and rng.random() < 0.4), True))
    df = spark.createDataFrame(rows, "symbol string, date date, fwd_ret double, a boolean, b boolean, c boolean")
    sessions = spark.createDataFrame([(d,) for d in days], "date date")
    got = backtest.equal_tracks(backtest.equal_days(df, {"x": F.col("a"), "y z": F.col("b"), "w": F.col("c")}, sessions))
    signals = reduce(DataFrame.unionByName, (df.where(f"{c} is not null").select(F.lit(k).alias("strategy"), "date", "symbol", F.col(c).cast("int").cast("double").alias("score"), "fwd_ret") for k, c in (("x", "a"), ("y z", "b"), ("w", "c"))))
    want = backtest.tracks(backtest.weights(signals))
    one, two = (t.select(want.columns).orderBy("strategy", "date").toPandas() for t in (got, want))
    pd.testing.assert_frame_equal(one, two, atol=1e-12, check_exact=False)


@pytest.mark.parametrize("name", ["te_ta_wide_tracks", "tv_ablation", "tq_i3_comparisons_with_every_benchmark"])
def test_portfolios_of_equal_weights_do_not_shuffle_their_names(spark, monkeypatch, name):
    made = []
    keep = backtest.written
    monkeypatch.setattr(backtest, "written", lambda df, *a: made.append(re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())) or keep(df, *a))
    monkeypatch.setattr(backtest, "weights", None)
    monkeypatch.setattr(backtest, "changes", None)
    df = catalogue.queries()[name](spark, SF)
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", made[0])
    assert keys.count("symbol") == 1 and set(keys) <= {"symbol", "date", "d"}  # the ticks; days of tasks, sessions and the macro series
    assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["te_ta_wide_tracks", "tv_ablation", "tw_tp_tb_tracks", "b1_baseline_performance"])
def test_tracks_equal_their_sql(spark, name):
    got, want = both(spark, name, SF)
    assert got == want


def _sized(spark, n, days):
    rng = np.random.default_rng(5)
    rows = [(a, band, dt.date(2020, 1, 1) + dt.timedelta(days=i), f"s{k:03d}", float(rng.choice([0.0, 0.2, 0.19, 0.01])), None if rng.random() < 0.1 else float(rng.normal(-0.004, 0.03))) for a, band in (("a", 0.02), ("b", 0.0)) for i in range(days) for k in range(n) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "account string, band double, date date, symbol string, size double, fwd_ret double")


def test_a_task_of_decisions_holds_a_day_and_not_a_year(spark):
    rows = _sized(spark, 5, 90)
    made = sizing.decide_block(rows, spark.createDataFrame([], sizing.STATE))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "collect_list" not in plan and "MapInArrow" in plan
    key = lambda df: sorted(map(tuple, df.collect()))
    want, end = sizing.decide(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got, state = sizing.decide(rows, most=10)  # a stretch for each month, days over several batches
        assert key(got) == key(want) and key(state) == key(end)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    twice = rows.unionByName(rows.withColumn("size", F.lit(0.2)).where("symbol = 's001'"))
    assert key(sizing.decide(twice)[0]) == key(sizing.decide(rows.withColumn("size", F.when(F.col("symbol") == "s001", 0.2).otherwise(F.col("size"))))[0])


def test_stretches_are_months_of_few_rows():
    m = [dt.date(2020, i, 1) for i in range(1, 7)]
    assert sizing.stretches(list(zip(m, (4, 4, 4, 30, 1, 9), strict=True)), 10) == [(m[0], m[1]), (m[2], m[2]), (m[3], m[3]), (m[4], m[5])]
    assert sizing.stretches([], 10) == []


def test_all_features_of_one_pass_equal_those_of_steps(spark):
    made = adapters.bars(spark, SF)
    flat = spark.createDataFrame([("flat", dt.date(2020, 1, 1) + dt.timedelta(days=i), *[7.3] * 4, 5.0) for i in range(250)], made.schema)
    made = made.unionByName(flat).repartition(3, "symbol").sortWithinPartitions("symbol", "date")
    want = features.recursive_features(features.window_features(made)).orderBy("symbol", "date").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        one = features.all_features(made)
        assert "Exchange hashpartitioning(symbol" not in re.sub(r"#\d+L?", "", one._jdf.queryExecution().executedPlan().toString()).split("MapInArrow")[0]
        got = one.orderBy("symbol", "date").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-11)
    assert (got[got.symbol == "flat"]["macd_hist"] == 0).all()


@pytest.mark.parametrize("name", ["m1_m3_walk_forward", "m2_fold_summary"])
def test_walk_forward_writes_its_features_once(spark, monkeypatch, name):
    monkeypatch.setattr(features, "ewm", None)
    monkeypatch.setattr(walkforward, "walk_forward", lambda rows, *a: rows.select("date", F.col("fwd_ret").alias("prob_up"), "y", F.lit(0).alias("fold")))
    catalogue.queries()[name](spark, SF)


def test_boosting_leaves_no_checkpoints_and_renews_its_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 32, (600, 2)).astype(np.uint8)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=int(i)), int(rng.random() < (0.8 if b[0] > 15 else 0.3)), bytes(b), bool(rng.random() < 0.2)) for i, b in zip(rng.integers(0, 90, 600), x, strict=True)]
    df = tables.written(spark.createDataFrame(rows, "date date, y int, bins binary, held boolean"))
    folds = [(dt.date(2020, 1, 1), dt.date(2020, 3, 1)), (dt.date(2020, 1, 20), dt.date(2020, 3, 20))]
    settings = boosting.Settings(trees=9, depth=2, patience=50)
    whole, again = (boosting.train(df, folds, 2, settings, renew) for renew in (50, 3))
    assert len(whole.value) == 9
    for a, b in zip(whole.feature + whole.cut + whole.value, again.feature + again.cut + again.value, strict=True):
        np.testing.assert_array_equal(a, b)
    assert not [p for p, _, _ in os.walk(tables.shared_dir(spark).removeprefix("file://")) if os.path.basename(p).startswith("rdd-")]
    block = boosting.Block(({"date": r[0], "y": r[1], "bins": r[2], "held": r[3]} for r in rows), folds, np.ones(2), np.zeros(2))
    back = pickle.loads(pickle.dumps(block, 5))
    assert len(pickle.dumps(block, 5)) < 8 * len(block.row) + 4 * len(rows) + 2000
    assert (back.row == block.row).all() and (back.fold == block.fold).all()
