"""Opinions, sizes and rules are made where a symbol's rows are."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import boosting, explain, features, opinions
from panelloom.plans import catalogue, decisions

D = dt.date


def shuffled_by(df) -> list[str]:
    """The keys of a plan's hash exchanges, without the numbers of its columns."""
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())]


def test_opinions_beside_each_other_combine_like_stacked_ones(spark):
    rows = [
        ("a", D(2020, 1, 1), 0.5, 0.4, False, -0.25, 0.8, False),
        ("b", D(2020, 1, 1), 0.0, 0.0, True, -0.25, 0.8, False),
        ("c", D(2020, 1, 1), None, None, None, 0.5, 0.0, False),
        ("d", D(2020, 1, 1), None, None, None, 0.0, 0.0, True),
        ("e", D(2020, 1, 1), 0.0, 0.0, True, 0.0, 0.0, True),
    ]
    df = spark.createDataFrame(rows, "symbol string, date date, technical_stance double, technical_confidence double, technical_abstained boolean, regime_stance double, regime_confidence double, regime_abstained boolean")
    stacked = opinions.stacked(df, decisions.AGENTS)
    assert stacked.count() == 8
    want = opinions.combine(stacked)
    got = opinions.combine_beside(df, decisions.AGENTS)
    assert got.select(want.columns).orderBy("symbol").collect() == want.orderBy("symbol").collect()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    lines = {r["symbol"]: r["brief"] for r in opinions.brief(stacked).collect()}
    assert {r["symbol"]: r["b"] for r in df.select("symbol", opinions.brief_beside(decisions.AGENTS).alias("b")).collect()} == lines


@pytest.mark.parametrize("name", ["o1_o3_opinions", "o6_combined_scores", "o9_o12_escalation_rate", "o11_conviction_gate", "p14_usage_statistics", "x6_rubric_agreement"])
def test_opinions_are_not_shuffled_by_symbol_and_date(spark, name):
    df = decisions._sized(decisions._beside(spark, "/root/testdata/sf0.001", sizes=True)) if name == "x6_rubric_agreement" else catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert "symbol, date" not in shuffled_by(df) and "date, symbol" not in shuffled_by(df)
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_blended_scores_shuffle_their_decisions_for_the_debates_only(spark):
    df = catalogue.queries()["o8_blended_scores"](spark, "/root/testdata/sf0.001")
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rationales_are_made_without_a_join(spark):
    assert "Join" not in catalogue.queries()["x3_text_consistency"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_rules_write_only_what_they_read(spark, monkeypatch):
    made = []
    keep = features.ewm
    monkeypatch.setattr(features, "ewm", lambda df, *a, **b: made.append(df.columns) or keep(df, *a, **b))
    catalogue.queries()["b1_b2_recursive_rules"](spark, "/root/testdata/sf0.001")
    assert {"stoch_k", "fwd_ret"} <= set(made[0]) and not {"volume", "vol_z20", "bb_pos", "dist_sma200"} & set(made[0])


def test_rank_correlation_counts_equal_pairs_once(spark):
    rng = np.random.default_rng(5)
    rows = [(float(min(rng.integers(0, 6), 3)), None if i % 50 == 7 else float(round(rng.normal(), 1))) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double")
    got, x = explain.spearman(df, "a", "b").first(), pd.DataFrame(rows, columns=["a", "b"]).dropna()
    assert (got["n"], got["rho"]) == (len(x), pytest.approx(x["a"].rank().corr(x["b"].rank()), abs=1e-12))
    pairs = explain.counted(df.where("b is not null"), "a", "b")
    assert pairs.count() == len(x.drop_duplicates()) < len(x)
    one = explain.spearman(df.where("a = 3 and b is not null").withColumn("b", F.lit(1.0)), "a", "b").first()
    assert one["n"] > 0 and one["rho"] is None
    none = explain.spearman(df.where("a > 9"), "a", "b").first()
    assert (none["n"], none["rho"]) == (0, None)


def test_a_block_holds_little_for_each_pair_and_reads_rows_as_they_come():
    rows = [{"date": D(2020, 1, 1) + dt.timedelta(days=i), "bins": bytes([i % 32, 3]), "y": i % 2, "held": i % 5 == 0} for i in range(40)]
    spans = [(D(2020, 1, 1), D(2020, 1, 21)), (D(2020, 1, 11), D(2020, 2, 1))]
    block = boosting.Block(iter(rows), spans, np.array([2.0, 1.0]), np.zeros(2))
    assert sum(x.itemsize for x in (block.row, block.fold, block.score)) <= 14 and not hasattr(block, "weight")
    h = block.histogram(np.full((2, 31), -1), np.zeros((2, 31), int), 0, 32, np.ones(2, bool))
    fit = [[r for r in rows if lo <= r["date"] < hi and not r["held"]] for lo, hi in spans]
    assert [h[2, f, 0, 1, 3] for f in (0, 1)] == [len(x) for x in fit]
    assert h[0, 0, 0, 0].sum() == pytest.approx(sum(-0.5 * 2 if r["y"] else 0.5 for r in fit[0]))
    assert boosting.Block(iter([]), spans, np.ones(2), np.zeros(2)).loss(2).sum() == 0
