"""A symbol's rows are shuffled once, in partitions of a size that doesn't grow."""

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import windows
from panelloom.functions.rounding import half_up
from panelloom.operators import features
from panelloom.plans import catalogue, decisions
from panelloom.sources import adapters

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["o11_conviction_gate", "o8_blended_scores", "o9_o12_escalation_rate", "o1_o3_opinions"])
def test_ticks_bars_and_opinions_take_one_shuffle_by_symbol(spark, monkeypatch, name):
    monkeypatch.setattr(adapters, "parts", lambda *a: 7)
    text = physical(catalogue.queries()[name](spark, SF))
    by_symbol = [x for x in re.findall(r"Exchange hashpartitioning\((.*?, \d+)\)", text) if x.split(",")[0] in ("k", "symbol") and "date" not in x and "_groupingexpression" not in x]  # without the debates' day
    assert by_symbol == ["symbol, 7"]


def test_opinions_pass_spark_windows_once_and_carry_no_more_than_agents_read(spark):
    text = physical(decisions._beside(spark, SF))
    own = [x for x in text.splitlines() if "Window [" in x and "windowspecdefinition(symbol, date" in x]
    assert len(own) == 1
    assert not re.search(r"MapInArrow run\([^)]*\b(vix|volume|open)\b(?!_)", text)


def test_bars_are_the_same_however_many_partitions_they_are_dealt_to(spark, monkeypatch):
    want = adapters.bars(spark, SF).orderBy("symbol", "date").collect()
    monkeypatch.setattr(adapters, "parts", lambda *a: 5)
    dealt = adapters.bars(spark, SF)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.orderBy("symbol", "date").collect() == want


def test_half_up_is_round_to_the_last_bit(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x = [*(rng.normal(size=n) * 10.0 ** rng.integers(-9, 14, n)), *((rng.integers(-(10**9), 10**9, n) * 2 + 1) / 2e6), *(rng.integers(-99, 99, n) + 0.5), 0.0, -0.0, -1e-9, 0.49999999999999994, math.nan, math.inf, -math.inf, 1e300, 5e-324]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for places in (0, 5, 6, 12):
        other = df.where(~half_up("x", places).cast("string").eqNullSafe(F.round("x", places).cast("string")))  # -0.0 is not 0.0 as text
        assert other.collect() == []


def test_lags_equal_pandas_over_series_and_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{k}", dt.date(2000, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.1 else float(i)) for k in range(3) for i in range(40 + 60 * k)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = windows.rolling(df, {"one": ("lag", "x", 1, 1), "far": ("lag", "x", 50, 1), "_d": lambda made: made["x"] - made["far"], "again": ("lag", "_d", 30, 1)}, ["symbol"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, g in got.sort_values(["symbol", "date"]).groupby("symbol"):
        x = g["x"].astype(float)
        for c, w in {"one": x.shift(1), "far": x.shift(50), "again": (x - x.shift(50)).shift(30)}.items():
            pd.testing.assert_series_equal(g[c].astype(float), w, check_names=False)


def test_a_return_over_nothing_is_null(spark):
    macro = spark.createDataFrame([(dt.date(2020, 1, 1 + i), 10.0 + i, 0.1, 12.0, 0.5) for i in range(3)], "date date, index_close double, index_mom_20d double, vix double, vix_percentile double")
    bars = spark.createDataFrame([("a", dt.date(2020, 1, 1 + i), 1.0, 1.0, 1.0, c, 1.0) for i, c in enumerate((0.0, 2.0, 3.0))], "symbol string, date date, open double, high double, low double, close double, volume double")
    assert [r["ret_1d"] for r in features.regime_table(bars, macro).orderBy("date").collect()] == [None, None, 0.5]
