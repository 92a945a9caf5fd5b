"""Hand-made cases of the panel operators."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pytest

from panelloom.functions import folds
from panelloom.functions.distributions import two_sided_t
from panelloom.operators import backtest, features, fundamentals, inference, labels, metrics, news, quality, sentiment
from panelloom.sources import corpus
from pyspark.sql import functions as F

D = dt.date


def bars(spark, closes, symbol="a", volumes=None):
    day = D(2020, 1, 1)
    rows = [(symbol, day + dt.timedelta(days=i), c, c * 1.01, c * 0.99, c, (volumes or {}).get(i, 100.0)) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_features_are_causal(spark):
    base = [100 + (i * 7 % 13) for i in range(60)]
    a = features.recursive_features(features.window_features(bars(spark, base))).orderBy("date").toPandas()
    b = features.recursive_features(features.window_features(bars(spark, base[:-1] + [base[-1] * 1.5]))).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(a.iloc[:-1], b.iloc[:-1])
    assert a["rsi_14"].iloc[0] == 0.5


def test_recursive_mean_equals_pandas(spark):
    base = [100 + (i * 7 % 13) for i in range(50)]
    got = features.recursive_features(bars(spark, base)).orderBy("date").toPandas()["macd_hist"]
    s = pd.Series(base, dtype=float)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    want = (macd - macd.ewm(span=9, adjust=False).mean()) / s
    assert abs(got - want).max() < 1e-12


def test_forward_return_enters_on_the_next_open(spark):
    out = bars(spark, [10, 11, 22, 33]).select("date", labels.forward_return(1).alias("r")).orderBy("date").collect()
    assert [r["r"] for r in out] == [1.0, 0.5, None, None]


def test_audit_faults(spark):
    closes = [100.0] * 3 + [100.0, 100.0, 100.0, 80.0] + [80.0 + i for i in range(3)]
    index = bars(spark, [1000.0] * 10).select("date", "close")
    kinds = {(r["kind"], r["date"].day) for r in quality.audit(bars(spark, closes, volumes={8: 0.0}), index).collect()}
    assert kinds == {("corporate_action", 7), ("zero_volume", 9), ("stale_run", 6)}
    assert quality.audit(bars(spark, []), index).count() == 0


def test_backtest_charges_a_held_position_once_and_sells_absent_rows(spark):
    rows = [("s", D(2020, 1, d), x, w, 0.0) for d, x, w in ((1, "a", 0.2), (2, "a", 0.2), (3, "b", 0.2), (4, "b", 0.2))]
    df = spark.createDataFrame(rows, "strategy string, date date, symbol string, weight double, fwd_ret double")
    out = [round(r["turnover"], 10) for r in backtest.tracks(df).orderBy("date").collect()]
    assert out == [0.2, 0.0, 0.4, 0.0]


def test_drawdown_of_a_gain_and_a_loss(spark):
    df = spark.createDataFrame([("s", D(2020, 1, 1), 0.10), ("s", D(2020, 1, 2), -0.50)], "strategy string, date date, net_return double")
    assert metrics.performance(df, "net_return", ["strategy"]).first()["max_drawdown"] == pytest.approx(-0.5)
    lost = df.unionByName(spark.createDataFrame([("s", D(2020, 1, 3), -1.0)], df.schema))
    row = metrics.performance(lost, "net_return", ["strategy"]).first()
    assert row["cagr"] == -1.0 and row["total_return"] == -1.0
    assert metrics.performance(df.limit(0), "net_return", ["strategy"]).count() == 0


def test_perfect_classifier(spark):
    df = spark.createDataFrame([("m", 0.9, 1), ("m", 0.8, 1), ("m", 0.1, 0)], "model string, prob_up double, y int")
    row = metrics.classification(df, ["model"]).first()
    assert (row["auc"], row["accuracy"], row["mcc"]) == (1.0, 1.0, 1.0)


def test_holm_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.01), ("c", None), ("d", 0.5)], "strategy string, p_value double")
    got = {r["strategy"]: r["p_adjusted"] for r in inference.holm(df).collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.03), "c": None, "d": 0.5}


def test_t_distribution():
    assert two_sided_t(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_labels_of_periods(spark):
    df = spark.createDataFrame([("Mar 2019",), ("Mar 2016 9m",), ("TTM",), (None,)], "fiscal string")
    end, months = fundamentals.period_end(F.col("fiscal"))
    assert [(r[0], r[1]) for r in df.select(end, months).collect()] == [(D(2019, 3, 31), 12), (D(2016, 3, 31), 9), (None, None), (None, None)]


def test_weekend_news_goes_to_monday(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 6)), ("a", D(2024, 1, 9))], "symbol string, date date")
    sessions = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),)], "date date")
    assert [r["date"] for r in news.to_sessions(rows, sessions).collect()] == [D(2024, 1, 8)]


@pytest.mark.parametrize("n, sizes", [(4, [1, 1, 2]), (5, [2, 1, 2]), (7, [2, 2, 3])])
def test_terciles(spark, n, sizes):
    df = spark.createDataFrame([("k", f"s{i}", D(2020, 1, 1), 1.0) for i in range(n)], "study string, symbol string, date date, sentiment double")
    got = {r["bucket"]: r["count"] for r in sentiment.terciles(df, ["study"]).groupBy("bucket").count().collect()}
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 3, labels=["neg", "neu", "pos"]).value_counts().to_dict()
    assert got == want


def test_average_cost_fold():
    q, avg, _, _ = folds.average_cost(0, 0, "buy", 10, 100, 0)
    q, avg, _, _ = folds.average_cost(q, avg, "buy", 10, 200, 0)
    assert (q, avg) == (20, 150)
    assert folds.average_cost(q, avg, "sell", 5, 160, 1)[2] == 49
    assert folds.average_cost(q, avg, "sell", 50, 160, 1)[3]


def test_drawdown_brake_and_band():
    days = [{"date": 1, "symbols": ["a"], "sizes": [0.2], "returns": [-1.0]}, {"date": 2, "symbols": ["a"], "sizes": [0.21], "returns": [0.0]}]
    out = folds.fold_days(days, 0.05, 0.0)
    assert out[0]["equity"] == pytest.approx(0.8) and out[1]["weights"]["a"] == pytest.approx(folds.drawdown_factor(-0.2) * 0.2, abs=0.06)


def test_power_resamples_the_history():
    rng = np.random.default_rng(3)
    r = rng.normal(0.0005, 0.01, 130)
    got = inference.lower_bounds(r, [0.0, 2.0], 40, 20, (1, 2))
    rng = np.random.default_rng((1, 2))
    circle = lambda starts, n: np.concatenate([np.arange(s, s + 20) % n for s in starts])[:n]
    history = (r - r.mean())[circle(rng.integers(0, 130, 7), 130)]
    drawn = [history[circle(starts, 130)] for starts in rng.integers(0, 130, (40, 7))]
    for t, low in zip([0.0, 2.0], got, strict=True):
        assert low == pytest.approx(np.percentile([(x.mean() + t * r.std(ddof=1) / 252**0.5) / x.std(ddof=1) for x in drawn], 2.5))


def test_resampling_counts(spark, monkeypatch):
    from panelloom.plans import decisions

    asked = {}
    for name in ("sharpe_intervals", "compare_to", "power_curve"):
        def spy(*args, _name=name, _made=getattr(inference, name), **options):
            asked[_name] = inspect.signature(_made).bind(*args, **options)
            asked[_name].apply_defaults()
            return _made(*args, **options)

        monkeypatch.setattr(inference, name, spy)
    for query in (decisions.i1_i2_whole_bootstrap_intervals, decisions.i3_i7_comparisons_with_buyhold, decisions.i9_i10_power):
        query(spark, "/root/testdata/sf0.001")
    assert asked["sharpe_intervals"].arguments["n_boot"] == asked["compare_to"].arguments["n_boot"] == 5000
    assert (asked["power_curve"].arguments["n_sims"], asked["power_curve"].arguments["n_boot"]) == (200, 500)


def test_walk_forward_query_boosts_trees_on_all_features(spark, monkeypatch):
    from panelloom.operators import walkforward
    from panelloom.plans import decisions

    asked = {}

    def spy(rows, folds, names, model="logistic"):
        asked.update(folds=folds.count(), names=set(names), model=model)
        return rows.select("date", "symbol", "fwd_ret").limit(0)

    monkeypatch.setattr(walkforward, "walk_forward", spy)
    decisions.m1_m3_walk_forward(spark, "/root/testdata/sf0.001")
    assert asked["model"] == "gbt" and {"ret_20d", "bb_pos", "dist_sma200", "rsi_14", "macd_hist", "atr_14"} <= asked["names"] and asked["folds"] > 0
    trees = walkforward.classifier("gbt")
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()) == (200, 4, 0.05)


def test_marked_equity_counts_holdings(spark):
    from panelloom.operators import ledger

    fills = spark.createDataFrame(
        [(0, "a", 1, "2020-01-01", "buy", 10.0, 100.0, 1.0, 10.0, False), (0, "b", 1, "2020-01-02", "buy", 5.0, 20.0, 0.0, 5.0, False), (0, "a", 2, "2020-01-03", "sell", 4.0, 120.0, 0.0, 6.0, False), (0, "b", 2, "2020-01-03", "sell", 9.0, 20.0, 0.0, 5.0, True)],
        "account long, symbol string, trade_id long, d string, side string, quantity double, fill_price double, cost double, quantity_after double, rejected boolean",
    ).selectExpr("* except (d)", "cast(d as date) as d")
    quotes = spark.createDataFrame([("a", "2020-01-01", 100.0), ("a", "2020-01-02", 110.0), ("a", "2020-01-03", 120.0), ("b", "2020-01-02", 20.0), ("b", "2020-01-04", 30.0), ("c", "2020-01-02", 1.0)], "symbol string, date string, close double").selectExpr("symbol", "cast(date as date) as date", "close")
    got = [(str(r["date"]), round(r["cash"], 6), round(r["holdings"], 6)) for r in ledger.marked_equity(fills, quotes, 10_000.0).orderBy("date").collect()]
    assert got == [("2020-01-01", 8999.0, 1000.0), ("2020-01-02", 8899.0, 1200.0), ("2020-01-03", 9379.0, 820.0), ("2020-01-04", 9379.0, 870.0)]


def test_ranks_in_ranges_equal_ranks_over_all(spark):
    rows = spark.createDataFrame([("a", float(i * 7919 % 400 // 3)) for i in range(400)] + [("b", 1.0)], "k string, x double")
    got = metrics.average_ranks(rows, "x", "r", ["k"]).where("k = 'a'").collect()
    values = [r["x"] for r in got]
    assert len(got) == 400 and all(r["r"] == sum(v < r["x"] for v in values) + (values.count(r["x"]) + 1) / 2 for r in got)
    assert metrics.average_ranks(rows.limit(0), "x", "r", ["k"]).count() == 0


def test_section_table_has_any_number_of_columns(spark):
    head, cells = ("".join(f"<{t}>{x}</{t}>" for x in row) for t, row in (("th", ["", *range(1500)]), ("td", ["Sales +", *("1,0%" for _ in range(1500))])))
    page = f'<div id="x"><table><tr>{head}</tr><tr>{cells}</tr></table>'
    got = corpus.section_table(spark.createDataFrame([(1, page), (2, "")], "page_id int, html string"), "x").collect()
    assert len(got) == 1500 and {(r["label"], r["value"]) for r in got} == {("Sales", 10.0)} and {r["fiscal"] for r in got} == {str(i) for i in range(1500)}


def test_feed_items(spark):
    item = lambda title, at, link="u": f"<item><title>{title}</title><link>{link}</link><pubDate>{at}</pubDate></item>"
    day = "Mon, 01 Jan 2024 10:00:00 GMT"
    raw = "<rss>" + item("A &amp; B", day, "first") + item("a &amp; b", day, "second") + item("", day) + item("C", "soon") + item("D", day) + "</rss>"
    got = news.feed_items(spark.createDataFrame([("s", raw), ("t", ""), ("u", None)], "symbol string, raw string"), "raw", ["symbol"]).orderBy("title").collect()
    assert [(r["symbol"], r["title"], r["link"], r["published"].hour) for r in got] == [("s", "A & B", "first", 10), ("s", "D", "u", 10)]


def test_corpus_files(spark, tmp_path):
    line = '{"symbol": "%s", "date": "2024-01-0%d", "title": "t", "source": "s", "url": "u", "published_utc": "2024-01-01"}'
    (tmp_path / "c.jsonl").write_text("\n".join([line % ("a", 1), "", "{broken", line % ("a", 2), line % ("b", 3)]))
    read = lambda **k: sorted(r["date"][-1] for r in corpus.read_corpus(spark, str(tmp_path / "c.jsonl"), **k).collect())
    assert read() == ["1", "2", "3"] and read(symbol="a", start="2024-01-02") == ["2"] and read(end="2024-01-02") == ["1", "2"]


def test_run_and_statement_files(spark, tmp_path):
    (tmp_path / "oos_one.csv").write_text("symbol,p\na,0.5\n")
    (tmp_path / "oos_two.csv").write_text("symbol,p\nb,0.25\n")
    runs = corpus.read_runs(spark, str(tmp_path / "oos_*.csv"), "symbol string, p double")
    assert sorted(map(tuple, runs.collect())) == [("a", 0.5, "one"), ("b", 0.25, "two")]
    (tmp_path / "TCS.json").write_text('{"ratios": {"Mar 2024": {"roe": 1.5, "gap": null}, "Mar 2023": {}}}')
    got = corpus.read_statements(spark, str(tmp_path / "TCS.json")).collect()
    assert {tuple(r) for r in got} == {("TCS", "ratios", "Mar 2024", "roe", 1.5), ("TCS", "ratios", "Mar 2024", "gap", None)}


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_exports_are_replaced(spark, tmp_path, kind):
    for n in (3, 2):
        corpus.export({"t": spark.range(n)}, str(tmp_path / "x"), kind)
    reader = spark.read.schema("id long")
    at = str(tmp_path / "x" / "t")
    assert sorted(r["id"] for r in (reader.json(at) if kind == "json" else reader.option("header", True).csv(at)).collect()) == [0, 1]
