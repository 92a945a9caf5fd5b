"""Streams give what the same rows give in a batch."""

import datetime as dt

import pytest

from panelloom.streaming import streams


def _run(spark, rows, schema, make, name, tmp_path, pieces=2):
    folder = str(tmp_path / "in")
    n = -(-len(rows) // pieces)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_bars_of_a_stream(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(t(1, 1), "a", 10.0, 1.0, 1), (t(1, 5), "a", 12.0, 2.0, 2), (t(1, 9), "a", 11.0, 1.0, 3), (t(9, 1), "a", 5.0, 1.0, 4), (t(20, 1), "a", 5.0, 1.0, 5)]
    got = _run(spark, rows, "ts timestamp, symbol string, price double, quantity double, seq int", streams.bars, "sb", tmp_path)
    one = next(r for r in got if r["start"].day == 1)
    assert (one["open"], one["high"], one["low"], one["close"], one["volume"]) == (10.0, 12.0, 10.0, 11.0, 4.0)


def test_sessions_of_headlines(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("a", "x", t(1, 1)), ("a", "y", t(1, 3)), ("a", "z", t(2, 9)), ("a", "late", t(20, 1)), ("a", "later", t(25, 1))]
    got = _run(spark, rows, "symbol string, title string, published_utc timestamp", streams.bursts, "sh", tmp_path)
    assert sorted(r["n_headlines"] for r in got)[-1] == 2


def test_headlines_stay_once(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "x", t(1)), ("a", "x", t(1)), ("b", "x", t(1)), ("a", "y", t(1)), ("a", "x", t(1)), ("a", "x", t(2))]
    got = _run(spark, rows, "symbol string, title string, published_utc timestamp", streams.distinct_headlines, "sd", tmp_path)
    assert sorted(map(tuple, got)) == sorted(set(rows))


def test_headlines_go_to_their_session(spark, tmp_path):
    calendar = spark.createDataFrame([(dt.date(2024, 1, d), dt.date(2024, 1, max(d, 8) if d > 5 else d)) for d in range(1, 10)], "day date, date date")
    rows = [("a", dt.datetime(2024, 1, 5, 9)), ("a", dt.datetime(2024, 1, 5, 11)), ("a", dt.datetime(2024, 1, 9, 12))]
    got = _run(spark, rows, "symbol string, published_utc timestamp", lambda r: streams.to_sessions(r, calendar), "st", tmp_path)
    assert sorted(r["date"].day for r in got) == [5, 8]  # the last one's day is after the calendar


def test_silent_spells(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", t(1)), ("a", t(2)), ("b", t(1)), ("a", t(10)), ("a", t(30)), ("b", t(31))]
    got = _run(spark, rows, "symbol string, ts timestamp", streams.staleness, "ss", tmp_path)
    assert {("a", t(2), t(6)), ("b", t(1), t(5))} <= {tuple(r) for r in got}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_account_keeps_its_peak_over_batches(spark, tmp_path, rocks):
    rows = [("x", "2024-01-01", 0.5), ("y", "2024-01-01", 0.1), ("x", "2024-01-02", -0.4), ("x", "2024-01-03", 0.1)]
    got = _run(spark, rows, "account string, date string, ret double", streams.accounts, "sa", tmp_path)
    last = max((r for r in got if r["account"] == "x"), key=lambda r: r["date"])
    assert len(got) == 4 and last["peak"] == pytest.approx(1.5) and last["brake"] < 1
    assert last["equity"] == pytest.approx(0.9 * (1 + 0.1 * last["brake"]))


def test_gap_alert_over_batches(spark, tmp_path, rocks):
    bar = lambda d, o, c: ("a", f"2024-01-{d:02d}", o, max(o, c), min(o, c), c)
    rows = [bar(1, 10.0, 10.0), bar(2, 10.0, 10.1), bar(3, 9.7, 9.8), bar(4, 9.8, 9.8)]
    got = _run(spark, rows, "symbol string, date string, open double, high double, low double, close double", streams.alerts, "sg", tmp_path)
    assert [tuple(r) for r in got] == [("a", "2024-01-03", "gap_down")]


def test_sink_replaces_rows_by_key(spark, tmp_path):
    write, path = streams.idempotent_sink(str(tmp_path / "out"), ["account", "date"]), str(tmp_path / "out")
    batch = lambda *rows: spark.createDataFrame(list(rows), "account string, date string, equity double")
    first = batch(("x", "d1", 1.0), ("y", "d1", 2.0))
    for number, rows in enumerate((first, first, batch(("x", "d1", 3.0), ("x", "d2", 4.0)), first.limit(0))):
        write(rows, number)
    got = spark.read.schema(first.schema).parquet(path).collect()
    assert sorted((r["account"], r["date"], r["equity"]) for r in got) == [("x", "d1", 3.0), ("x", "d2", 4.0), ("y", "d1", 2.0)]
