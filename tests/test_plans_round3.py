"""Boosted trees, recursive means, rolling ranks, as-of joins, tagging, factor regressions and page tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from panelloom.functions import windows
from panelloom.functions.distributions import two_sided_t
from panelloom.operators import boosting, labels, metrics, news
from panelloom.sources import corpus
from pyspark.sql import functions as F

D = dt.date


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- boosted trees ------------------------------------------------------------------------------


def _block(x, y, folds, held=None, edges=None):
    edges = edges or [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
    day = D(2020, 1, 1)
    rows = [{"date": day + dt.timedelta(days=i), "bins": b.tobytes(), "y": int(v), "held": bool(held[i]) if held is not None else False} for i, (b, v) in enumerate(zip(bins, y, strict=True))]
    return boosting.Block(rows, folds, np.ones(len(folds)), np.zeros(len(folds))), bins


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 1] + 0.3 * rng.normal(size=400) > 0.4).astype(int)
    spans = [(D(2020, 1, 1), D(2021, 3, 1)), (D(2020, 6, 1), D(2020, 12, 1))]
    block, bins = _block(x, y, spans)
    empty = np.full((2, 31), -1)
    h = block.histogram(empty, empty * 0, 0, 32, np.ones(2, bool))
    feature, cut, gain = boosting.best_splits(h, 1.0, 20, 1e-3)
    for f, (lo, hi) in enumerate(spans):
        use = np.arange((lo - D(2020, 1, 1)).days, min(400, (hi - D(2020, 1, 1)).days))
        g, best = 0.5 - y[use], (-1.0, None, None)
        for j in range(3):
            for c in range(31):
                left = bins[use, j] <= c
                if min(left.sum(), (~left).sum()) >= 20:
                    score = sum(g[s].sum() ** 2 / (0.25 * s.sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (0.25 * len(g) + 1)
                    best = max(best, (score, -j, -c))
        assert gain[f, 0] == pytest.approx(best[0]) and (feature[f, 0], cut[f, 0]) == (-best[1], -best[2])


def _panel(spark, n_days=700, symbols=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_days):
        for s in range(symbols):
            a, b = rng.normal(size=2)
            up = int(a * b > 0)
            rows.append((D(2020, 1, 1) + dt.timedelta(days=i), f"s{s}", up if rng.random() < 0.9 else 1 - up, 0.01, float(a), float(b)))
    return spark.createDataFrame(rows, "date date, symbol string, y int, fwd_ret double, a double, b double")


def test_walk_forward_learns_and_keeps_the_order_of_time(spark):
    rows = _panel(spark)
    folds = labels.folds(rows.select("date"), train_years=1, test_months=3, embargo_days=10)
    s = boosting.Settings(trees=30, rate=0.3)
    got = boosting.walk_forward(rows, folds, ["a", "b"], s)
    spans = {r["fold"]: r for r in folds.collect()}
    out = got.collect()
    assert {r["fold"] for r in out} == set(spans)
    assert all(spans[r["fold"]]["test_lo"] <= r["date"] < spans[r["fold"]]["test_hi"] for r in out)
    assert len({(r["date"], r["symbol"]) for r in out}) == len(out)
    summary = {r["fold"]: r for r in boosting.fold_summary(got).collect()}
    assert summary[None]["n"] == len(out) and summary[None]["accuracy"] > 0.8
    assert [summary[f]["first_date"] for f in sorted(spans)] == sorted(summary[f]["first_date"] for f in spans)
    # Labels and features from the embargo on change no prediction of the first fold.
    first = spans[0]
    flipped = rows.withColumns({"y": F.when(F.col("date") >= F.lit(first["train_hi"]), 1 - F.col("y")).otherwise(F.col("y"))})
    again = boosting.walk_forward(flipped, folds.where("fold = 0"), ["a", "b"], s).collect()
    before = {(r["date"], r["symbol"]): r["prob_up"] for r in out if r["fold"] == 0}
    assert {(r["date"], r["symbol"]): r["prob_up"] for r in again} == pytest.approx(before)
    assert boosting.walk_forward(rows.limit(0), labels.folds(rows.limit(0).select("date")), ["a", "b"]).count() == 0


def test_boosting_stops_and_weighs_classes():
    x = np.random.default_rng(5).normal(size=(300, 2))
    block, bins = _block(x, np.zeros(300), [(D(2020, 1, 1), D(2021, 1, 1))], held=np.arange(300) % 5 == 0)
    assert block.loss(1)[0, 0] / block.loss(1)[1, 0] == pytest.approx(np.log(2))
    forest = boosting.Forest(np.zeros(1), [np.array([[1, -1, -1]])], [np.array([[3, 0, 0]])], [np.array([[0.0, -1.0, 2.0]])])
    assert (forest.scores(bins, np.zeros(300, int)) == np.where(bins[:, 1] > 3, 2.0, -1.0)).all()


# --- windows --------------------------------------------------------------------------------------


def test_recursive_means_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s in "abcd":
        n = {"a": 1500, "b": 1, "c": 900, "d": 40}[s]
        x = rng.normal(100, 20, n)
        x[rng.random(n) < 0.2] = np.nan
        x[: {"a": 3, "b": 0, "c": 600, "d": 40}[s]] = np.nan
        days = np.sort(rng.choice(4000, n, replace=False))
        rows += [(s, D(2000, 1, 1) + dt.timedelta(days=int(d)), None if np.isnan(v) else float(v)) for d, v in zip(days, x, strict=True)]
        for alpha in (1 / 14, 0.2, 2 / 27):
            want[s, alpha] = pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    got = windows.ewm(df, {f"y{i}": ("x", a) for i, a in enumerate((1 / 14, 0.2, 2 / 27))}, ["symbol"], block_days=128)
    assert not {"Python", "Arrow", "Pandas"} & set(_plan(got).replace("(", " ").split()) and "InArrow" not in _plan(got)
    pdf = got.orderBy("symbol", "date").toPandas()
    for s in "abcd":
        for i, alpha in enumerate((1 / 14, 0.2, 2 / 27)):
            np.testing.assert_allclose(pdf[pdf.symbol == s][f"y{i}"].to_numpy(float), want[s, alpha], rtol=1e-12)


def test_rolling_ranks_equal_pandas(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400), 1)
    x[rng.random(400) < 0.1] = np.nan
    df = spark.createDataFrame([("a", D(2020, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol string, date date, x double")
    got = windows.pct_ranks(df, {"r": ("x", 50, 20)}, ["symbol"]).orderBy("date").toPandas()["r"]
    np.testing.assert_allclose(got.to_numpy(float), pd.Series(x).rolling(50, min_periods=20).rank(pct=True).to_numpy(), rtol=1e-12)
    native = df.withColumn("r", windows.pct_rank("x", 50, windows.by("symbol"), 20)).orderBy("date").toPandas()["r"]
    np.testing.assert_allclose(got.to_numpy(float), native.to_numpy(float))


def test_as_of_join_of_many_events(spark):
    day = D(2000, 1, 1)
    events = spark.range(10_000).select(F.lit("k").alias("key"), F.date_add(F.lit(day), F.col("id").cast("int")).alias("since"), F.col("id").alias("value"))
    rows = spark.createDataFrame([("k", day - dt.timedelta(days=1), 1), ("k", day, 2), ("k", day + dt.timedelta(days=20_000), 3), ("other", day, 4), (None, day, 5), ("k", None, 6), ("k", day, 2)], "key string, at date, row int")
    out = windows.as_of_backward(rows, events, ["key"], "at", "since")
    got = sorted((r["row"], r["value"]) for r in out.collect())
    assert got == [(1, None), (2, 0), (2, 0), (3, 9999), (4, None), (5, None), (6, None)]
    assert "Join" not in _plan(out)


# --- tagging --------------------------------------------------------------------------------------


def test_tagging_with_many_terms(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("symbol"), F.concat(F.lit("company nr "), "id", F.lit(".")).alias("term"))
    terms = terms.unionByName(spark.createDataFrame([("x", "AB"), ("y", "abcdefgh"), ("z", "ab"), ("e", ""), ("n", None)], "symbol string, term string"))
    rows = spark.createDataFrame([(1, "news of Company nr 77. and COMPANY NR 99999."), (2, "xabcdefgh"), (3, None), (4, ""), (5, "company nr 7"), (2, "xabcdefgh")], "id int, title string")
    got = sorted((r["id"], r["tagged"]) for r in news.tag_companies(rows, terms).collect())
    assert got == [(1, "s77"), (1, "s99999"), (2, "x"), (2, "y"), (2, "z")]
    assert news.tag_companies(rows, terms.limit(0)).count() == 0


# --- factor regressions -----------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_factor_regression_equals_least_squares(spark, k):
    rng = np.random.default_rng(k)
    n = 300
    x = rng.normal(0, 0.01, (n, k)) @ rng.normal(size=(k, k))
    names = [f"f{i}" for i in range(k)]
    rows, want = [], {}
    for s, alpha in (("low", -0.001), ("high", 0.002)):
        y = alpha + x @ np.arange(1, k + 1) + rng.normal(0, 0.004, n)
        rows += [(s, float(v), *map(float, r)) for v, r in zip(y, x, strict=True)]
        big = np.column_stack([np.ones(n), x])
        b = np.linalg.lstsq(big, y, rcond=None)[0]
        left = y - big @ b
        t = b / np.sqrt(left @ left / (n - k - 1) * np.diag(np.linalg.inv(big.T @ big)))
        want[s] = [(1 + b[0]) ** 252 - 1, t[0], two_sided_t(t[0], n - k - 1), *(v for j in range(1, k + 1) for v in (b[j], t[j], two_sided_t(t[j], n - k - 1))), 1 - left @ left / ((y - y.mean()) ** 2).sum()]
    rows.append(("low", None, *[0.0] * k))
    df = spark.createDataFrame(rows, ", ".join(["strategy string, y double", *(f"{f} double" for f in names)]))
    got = metrics.factor_regression(df, "y", names, ["strategy"]).collect()
    assert [r["strategy"] for r in got] == ["high", "low"] and all(r["n"] == n for r in got)
    for r in got:
        np.testing.assert_allclose(list(r)[2:], want[r["strategy"]], rtol=1e-6, atol=1e-12)


def test_factor_regression_needs_days_and_free_factors(spark):
    df = spark.createDataFrame([("s", 0.01 * i, float(i % 3), float(2 * (i % 3))) for i in range(20)], "strategy string, y double, a double, b double")
    row = metrics.factor_regression(df, "y", ["a", "b"], ["strategy"]).first()
    assert row["b_beta"] is None and row["n"] == 20
    with pytest.raises(Exception, match="too few"):
        metrics.factor_regression(df.limit(3), "y", ["a", "b"], ["strategy"]).collect()


# --- page tables ------------------------------------------------------------------------------------


def test_section_tables_with_nested_tables_and_missing_cells(spark):
    page = """<div id="other"><table><tr><th>no</th></tr></table></div><section id='pl'><p>text</p>
    <table><thead><tr><th></th><th>Mar&nbsp;2023<th colspan=2>Mar 2024<th>Mar 2025</thead>
    <tr><td>Sales&nbsp;+<td>1,234<td>5%<td>ignored<td>--
    <tr><td>Deep <table><tr><td>inner</td><td>9</td></tr></table></td><td>7</td></tr>
    <tr></tr></table><table><tr><td>second</td></tr></table></section>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, '<table id="pl">'), (4, "<p id=pl>none")], "page_id int, html string")
    got = [(r["page_id"], r["row"], r["label"], r["fiscal"], r["raw"], r["value"]) for r in corpus.section_tables(df, ["pl", "absent"]).orderBy("row", "fiscal", "raw").collect()]
    assert {(x[1], x[2]) for x in got} == {(0, "Sales"), (1, "Deep inner9")}
    sales = {(f, v) for _, n, _, f, _, v in got if n == 0}
    assert ("Mar 2023", 1234.0) in sales and ("Mar 2024", 5.0) in sales and ("Mar 2025", None) in sales
    deep = {(f, v) for _, n, _, f, _, v in got if n == 1}
    assert ("Mar 2023", 7.0) in deep and ("Mar 2024", None) in deep and ("Mar 2025", None) in deep
    assert {x[0] for x in got} == {1}


# --- decisions, scorers, logs, stored models --------------------------------------------------------


def _sized_rows(spark):
    rng = np.random.default_rng(6)
    rows = []
    for account, band in (("a", 0.0), ("b", 0.02)):
        for i in range(500):
            day = D(2019, 6, 1) + dt.timedelta(days=2 * i)
            rows += [(account, band, day, f"s{k}", float(rng.choice([0.0, 0.2, 0.19, 0.15])), None if rng.random() < 0.03 else float(rng.normal(-0.002, 0.03))) for k in range(6) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "account string, band double, date date, symbol string, size double, fwd_ret double")


def _key(rows):
    return {(r["account"], r["date"], r["symbol"]): (r["weight"], r["equity"], r["peak"], r["drawdown_before"]) for r in rows}


def test_decisions_in_one_pass_resumed_and_of_one_fold_agree(spark):
    from panelloom.functions.folds import fold_days
    from panelloom.operators import sizing

    rows = _sized_rows(spark)
    whole, end = sizing.decide(rows)
    cut = D(2020, 9, 13)
    first, state = sizing.decide(rows.where(F.col("date") < F.lit(cut)))
    second, end_2 = sizing.decide(rows.where(F.col("date") >= F.lit(cut)), state=state)
    want = _key(whole.collect())
    assert _key(first.unionByName(second).collect()) == want
    assert sorted(map(str, end.collect())) == sorted(map(str, end_2.collect()))
    for account, band in (("a", 0.0), ("b", 0.02)):
        mine = rows.where(F.col("account") == account).orderBy("date", "symbol").toPandas()
        days = [{"date": d, "symbols": x["symbol"].tolist(), "sizes": x["size"].tolist(), "returns": [None if v != v else v for v in x["fwd_ret"]]} for d, x in mine.groupby("date")]
        for d in fold_days(days, band, 1.06 ** (1 / 252) - 1):
            for s, w in d["weights"].items():
                assert want[account, d["date"], s] == (w, d["equity"], d["peak"], d["drawdown_before"])
    assert any(v[3] < -0.15 for v in want.values())
    none, kept = sizing.decide(rows.limit(0), state=end)
    assert none.count() == 0 and kept.count() == 2


def test_decisions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    from panelloom.operators import sizing
    from panelloom.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _sized_rows(spark).where("date < date'2019-09-01'")
        folder = str(tmp_path / "in")
        for lo, hi in (("2019-06-01", "2019-07-10"), ("2019-07-10", "2019-09-01")):
            rows.where(f"date >= date'{lo}' and date < date'{hi}'").coalesce(1).write.mode("append").parquet(folder)
        stream = streams.decisions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        q = stream.writeStream.format("memory").queryName("dec").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        got, want = _key(spark.sql("select * from dec").collect()), _key(sizing.decide(rows)[0].collect())
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _once(allowed):
    """A scorer that may be called for some texts only, two at a time; its class is local, so tasks get its code."""

    class Once:
        labels, name = ("x", "y"), "once"

        def score(self, texts):
            assert len(texts) <= 2 and set(texts) <= allowed, texts
            return np.array([[len(t), 1.0] for t in texts])

    return Once()


def test_a_second_run_scores_nothing(spark, tmp_path):
    from panelloom.operators import scoring

    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "aa", 5), (2, "b", 5), (3, "aa", 5), (4, None, 5), (5, "", 5)], "doc_id int, text string, hit_before int")
    first = scoring.scored(df, "text", _once({"aa", "b", ""}), cache, batch_size=2)
    assert sorted((r["doc_id"], r["p_x"], r["p_y"], r["hit"]) for r in first.collect()) == [(1, 2.0, 1.0, False), (2, 1.0, 1.0, False), (3, 2.0, 1.0, False), (4, 0.0, 1.0, False), (5, 0.0, 1.0, False)]
    more = df.unionByName(spark.createDataFrame([(6, "new", 5)], df.schema))
    second = {r["doc_id"]: r for r in scoring.scored(more, "text", _once({"new"}), cache, batch_size=2).collect()}
    assert [second[i]["hit"] for i in range(1, 7)] == [True] * 5 + [False] and second[6]["p_x"] == 3.0
    other = scoring.scored(df, "text", scoring.LetterShares(("p", "q"), "ab"), cache)
    assert not any(r["hit"] for r in other.collect())
    assert scoring.scored(df.limit(0), "text", _once(set()), cache).count() == 0


def test_a_replayed_batch_leaves_the_log_equal(spark, tmp_path):
    from panelloom.sources import ledger_log

    log, schema = str(tmp_path / "log"), "k string, v int"
    assert ledger_log.read_log(spark, log, schema).count() == 0
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    ledger_log.append_once(batch(("a", 1), ("b", 2)), log, "one")
    ledger_log.append_once(batch(("c", 3)), log, "two")
    before = sorted(map(tuple, ledger_log.read_log(spark, log, schema).collect()))
    ledger_log.append_once(batch(("a", 9)), log, "one")
    batch(("lost", 0)).write.parquet(f"{log}/data-{'0' * 32}")  # a writer that was lost before it committed
    sink = ledger_log.log_sink(log)
    for _ in range(2):
        sink(batch(("d", 4)), 7)
    after = sorted(map(tuple, ledger_log.read_log(spark, log, schema).collect()))
    assert after == sorted([*before, ("d", 4, "stream-7")]) and len(before) == 3


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    from panelloom.sources import ledger_log

    at = tmp_path / "t"
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit(1).alias("seq"))
    assert ledger_log.upsert_into(rows, str(at), ["k"], ["seq"], parts=8) == 8
    files = {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    one = spark.createDataFrame([("5", 2, 2), ("5", 3, 3), ("5", 0, 0)], "k string, v int, seq int")
    for _ in range(2):
        assert ledger_log.upsert_into(one, str(at), ["k"], ["seq"], parts=8) == 1
    got = {r["k"]: r["v"] for r in spark.read.parquet(str(at)).collect()}
    assert len(got) == 200 and got.pop("5") == 3 and set(got.values()) == {1}
    assert sum(p in files for p in at.rglob("*.parquet")) == 7
    assert ledger_log.upsert_into(rows.limit(0), str(at), ["k"], ["seq"], parts=8) == 0


def test_stored_and_fresh_scores_are_equal(spark, tmp_path):
    from panelloom.operators import stored

    rng = np.random.default_rng(9)
    rows = []
    for s in range(3):
        for i in range(120):
            a = float(rng.normal())
            rows.append((f"s{s}", D(2020, 1, 1) + dt.timedelta(days=i), a, 5.0, float(rng.normal() + 0.5 * a) if i < 119 else None))
    df = spark.createDataFrame(rows, "symbol string, date date, a double, flat double, fwd_ret double")
    path = str(tmp_path / "m")
    model = stored.fit_and_store(df.where("date < date'2020-04-01'"), ["a", "flat"], path, length=5)
    by = lambda x: {r["symbol"]: r["prob_up"] for r in x.collect()}
    fresh = by(stored.score_latest(spark, df, path, "2020-04-20", model))
    assert by(stored.score_latest(spark, df, path, "2020-04-20")) == fresh and len(fresh) == 3
    wild = df.withColumn("a", F.when((F.col("symbol") == "s0") & (F.col("date") == F.lit("2020-04-20").cast("date")), 1e9).otherwise(F.col("a")))
    row = spark.read.parquet(f"{path}/statistics").where("feature = 'a'").first()
    at_limit = df.withColumn("a", F.when((F.col("symbol") == "s0") & (F.col("date") == F.lit("2020-04-20").cast("date")), row["mean"] + 8 * row["std"]).otherwise(F.col("a")))
    assert by(stored.score_latest(spark, wild, path, "2020-04-20")) == pytest.approx(by(stored.score_latest(spark, at_limit, path, "2020-04-20")))
    late = df.where("symbol <> 's2' or date < date'2020-03-01'")
    assert {r["date"] for r in stored.score_latest(spark, late, path, "2020-04-20").collect()} == {D(2020, 2, 29)}


# --- small rules ------------------------------------------------------------------------------------


def test_every_provider_failing_is_an_error(spark):
    from panelloom.operators import sentiment

    schema = "item int, provider string, label string, p double"
    rows = [(1, "a", "x", 0.2), (1, "a", "y", 0.8), (1, "b", "x", None), (1, "b", "y", 0.5)]
    got = {r["label"]: (r["p"], r["n_providers"], r["agreement"]) for r in sentiment.ensemble(spark.createDataFrame(rows, schema), ["item"]).collect()}
    assert got == {"x": (0.2, 1, 1.0), "y": (0.8, 1, 1.0)}
    with pytest.raises(Exception, match="every provider failed"):
        sentiment.ensemble(spark.createDataFrame([*rows, (2, "a", "x", None), (2, "b", "x", None)], schema), ["item"]).collect()


def test_a_benchmark_is_filled_with_a_flag(spark):
    from panelloom.operators import baselines

    dates = spark.createDataFrame([(D(2020, 1, d),) for d in (1, 2, 2, 3, 4)], "date date")
    bench = spark.createDataFrame([(D(2020, 1, 1), 0.0), (D(2020, 1, 3), 0.5), (D(2020, 1, 4), None), (D(2020, 1, 9), 1.0)], "date date, ret double")
    got = sorted((r["date"].day, r["ret"], r["has_bench"]) for r in baselines.align_benchmark(dates, bench).collect())
    assert got == [(1, 0.0, True), (2, 0.0, False), (3, 0.5, True), (4, 0.0, False)]


def test_macro_columns_are_filled_forward(spark):
    from panelloom.operators import features

    days = [D(2020, 1, d) for d in range(1, 6)]
    bars = spark.createDataFrame([("a", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in days], "symbol string, date date, open double, high double, low double, close double, volume double")
    macro = spark.createDataFrame([(days[1], 100.0, 0.1, 20.0, 0.5), (days[3], 110.0, None, 21.0, None)], "date date, index_close double, index_mom_20d double, vix double, vix_percentile double")
    got = features.regime_table(bars, macro).orderBy("date").collect()
    assert [r["index_close"] for r in got] == [None, 100.0, 100.0, 110.0, 110.0] and [r["vix_percentile"] for r in got] == [None, 0.5, 0.5, 0.5, 0.5]


def test_demoted_actions(spark):
    from panelloom.operators import sizing

    rows = [("BUY", 0.0, 0.0, []), ("BUY", 0.2, 0.1, ["x"]), ("FLAT", 0.0, 0.0, None)]
    got = [(r["action"], r["risk_notes"]) for r in sizing.demoted(spark.createDataFrame(rows, "action string, size_before double, size double, risk_notes array<string>").coalesce(1)).collect()]
    assert got == [("HOLD", []), ("BUY", ["x", "scaled to the gross cap"]), ("FLAT", None)]


def test_block_sums_of_every_start_equal_brute_force(spark):
    from panelloom.operators import inference

    rng = np.random.default_rng(1)
    rows = [(s, D(2020, 1, 1) + dt.timedelta(days=i), float(v)) for s, n in (("a", 47), ("b", 40), ("c", 61)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "strategy string, date date, r double")
    got = inference.block_moments(inference.numbered(df, ["r"]), ["r"], 20).collect()
    assert len(got) == 148
    for s in "abc":
        x = np.array([v for k, _, v in rows if k == s])
        c, n, last = x - x.mean(), len(x), (len(x) - 1) % 20 + 1
        for m in (m for m in got if m["strategy"] == s):
            at = lambda k, i=m["i"]: c[np.arange(i, i + k) % n]  # noqa: E731, B023
            assert [m["s_r"], m["q_r"], m["l_s_r"], m["l_q_r"]] == pytest.approx([at(20).sum(), (at(20) ** 2).sum(), at(last).sum(), (at(last) ** 2).sum()])
