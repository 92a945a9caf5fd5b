"""Queries over parameter sweeps with resampled intervals, and over feeds, files and exports that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.costs import DELIVERY, rate, with_round_trip
from panelloom.functions.tables import shared_dir, written
from panelloom.operators import backtest, baselines, inference, labels, metrics, news, opinions, sizing
from panelloom.plans import audits, decisions, panel
from panelloom.plans.registry import Registry, rounded
from panelloom.sources import adapters as src
from panelloom.sources import corpus

R = Registry()

# --- sweeps with resampled intervals -------------------------------------------------------------

_N_BOOT = 2000  # draws


def _resampled(cells: str) -> str:
    """SQL of Sharpe ratios and their intervals by circular blocks, of a view with strategy, date, net_return, blen and ppy."""
    return f"""{decisions.drawn(_N_BOOT, cells, "ppy, net_return", "blen")},
bo AS (SELECT strategy, rep, (avg(net_return) - (pow(1.06, 1 / ppy) - 1)) / stddev_samp(net_return) * sqrt(ppy) AS sharpe FROM dw GROUP BY strategy, rep, ppy),
iv AS (SELECT strategy, quantile_cont(sharpe, 0.025) AS low, quantile_cont(sharpe, 0.975) AS high FROM bo GROUP BY strategy),
pt AS (SELECT strategy, count(*) AS n, (avg(net_return) - (pow(1.06, 1 / ppy) - 1)) / stddev_samp(net_return) * sqrt(ppy) AS sharpe FROM {cells} GROUP BY strategy, ppy)
SELECT pt.strategy, n, round(sharpe, 5) + 0.0 AS sharpe, round(low, 5) + 0.0 AS low, round(high, 5) + 0.0 AS high FROM pt LEFT JOIN iv USING (strategy)"""


def with_intervals(track: DataFrame, block: int, periods: int, n_boot: int = 5000, seed: int = 5) -> DataFrame:
    """n, Sharpe ratio and its resampled interval of every strategy of a track."""
    point = metrics.performance(track, "net_return", ["strategy"], periods=periods).select("strategy", "n", "sharpe")
    return point.join(inference.sharpe_intervals(track, n_boot=n_boot, block=block, seed=seed, periods=periods).select("strategy", "low", "high"), "strategy", "left")


_BPS = (10.0, 32.0, 60.0)
_HORIZONS = (5, 10)


@R.add("predictions bars", f"""WITH fh AS (SELECT symbol, date, lead(open, 6) OVER w / lead(open, 1) OVER w - 1 AS f5, lead(open, 11) OVER w / lead(open, 1) OVER w - 1 AS f10 FROM bars {panel._W}),
hs AS (SELECT 'h1' AS strategy, 1 AS h, date, symbol, prob_up, fwd_ret FROM predictions WHERE fwd_ret IS NOT NULL UNION ALL SELECT 'h5', 5, date, symbol, prob_up, f5 FROM predictions JOIN fh USING (symbol, date) WHERE f5 IS NOT NULL UNION ALL SELECT 'h10', 10, date, symbol, prob_up, f10 FROM predictions JOIN fh USING (symbol, date) WHERE f10 IS NOT NULL),
signals AS (SELECT strategy, date, symbol, CASE WHEN round(prob_up, 12) > 0.5 THEN 1.0 ELSE 0.0 END AS score, fwd_ret FROM (SELECT *, dense_rank() OVER (PARTITION BY h ORDER BY date) - 1 AS k FROM hs) WHERE k % h = 0)""" + audits._AFTER_SIGNALS + f""",
sc AS (SELECT * FROM (VALUES {", ".join(f"('h1', 'h1@{b:g}', 252.0::DOUBLE, 20, {rate('buy', with_round_trip(b, DELIVERY))!r}::DOUBLE, {rate('sell', with_round_trip(b, DELIVERY))!r}::DOUBLE)" for b in _BPS)}, {", ".join(f"('h{h}', 'h{h}@32', {252 / h!r}::DOUBLE, {max(2, 20 // h)}, {rate('buy', with_round_trip(32.0, DELIVERY))!r}::DOUBLE, {rate('sell', with_round_trip(32.0, DELIVERY))!r}::DOUBLE)" for h in _HORIZONS)}) v(base, name, ppy, blen, cb, cs)),
cells AS (SELECT name AS strategy, date, blen, ppy, r + greatest(1 - exposure, 0) * (pow(1.06, 1 / ppy) - 1) - buy * cb - sell * cs AS net_return FROM tracks JOIN sc ON strategy = base), """ + _resampled("cells"))  # fmt: skip
def to_cost_and_horizon_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs crossed at a horizon of one day, horizons at 32 basis points: each cell's Sharpe ratio with its resampled interval.

    Longer horizons trade on every h-th session only; their years have 252 / h periods and their blocks 20 / h, 2 at least.
    """
    said = src.predictions(spark, sf_dir).withColumn("score", F.when(F.round("prob_up", 12) > 0.5, 1.0).otherwise(0.0))
    far = src.bars(spark, sf_dir).select("symbol", "date", *(labels.forward_return(h).alias(f"f{h}") for h in _HORIZONS))
    rows = written(said.select("symbol", "date", "score", "fwd_ret").join(far, ["symbol", "date"]), "signals")
    one = backtest.weights(rows.where("fwd_ret is not null").select(F.lit("h1").alias("strategy"), "date", "symbol", "score", "fwd_ret"))
    out = with_intervals(written(backtest.net_tracks(one, {f"{b:g}": with_round_trip(b, DELIVERY) for b in _BPS}), "cells"), 20, 252, _N_BOOT)
    for h in _HORIZONS:
        some = labels.every_hth_session(rows.where(f"f{h} is not null").select(F.lit(f"h{h}").alias("strategy"), "date", "symbol", "score", F.col(f"f{h}").alias("fwd_ret")), h)
        cells = backtest.net_tracks(backtest.weights(some), {"32": with_round_trip(32.0, DELIVERY)}, periods=252 / h)
        out = out.unionByName(with_intervals(written(cells, "cells"), max(2, 20 // h), 252 / h, _N_BOOT))
    return rounded(out, 5)


_FLOORS = (0.05, 0.1, 0.2)


@R.add(decisions._VIEWS + " scored", "WITH " + decisions._SIZED + ", " + audits._ARGS + f""",
cv AS (SELECT symbol, date, min(stance * confidence) FILTER (WHERE NOT abstained) AS lo, max(stance * confidence) FILTER (WHERE NOT abstained) AS hi FROM op GROUP BY 1, 2),
fl AS (SELECT printf('floor%.2f', f) AS strategy, symbol, date, vol_20, trigger, bull IS NOT NULL AND round(hi, 12) > f AND round(lo, 12) < -f AS debated, score, confidence, bull, bear FROM sz JOIN cv USING (symbol, date) LEFT JOIN db USING (symbol, date), (VALUES {", ".join(f"({f}::DOUBLE)" for f in _FLOORS)}) v(f)),
bl AS (SELECT strategy, symbol, date, vol_20, trigger, CASE WHEN debated THEN least(greatest(0.65 * score + 0.35 * least(greatest(bull - bear, -1.0), 1.0), -1.0), 1.0) ELSE score END AS score, CASE WHEN debated AND bull > 0.3 AND bear > 0.3 THEN confidence * 0.7 ELSE confidence END AS confidence FROM fl),
s1 AS (SELECT *, CASE WHEN trigger IS NOT NULL OR score <= 0 OR confidence < 0.10 THEN 0 ELSE least(0.2 * (CASE WHEN vol_20 > 1e-6 THEN least(greatest(0.2 / vol_20, 0.25), 1.5) ELSE 1.0 END), 0.2) END AS s0 FROM bl),
wt AS (SELECT strategy, s1.symbol, s1.date, CASE WHEN sum(s0) OVER (PARTITION BY strategy, s1.date) > 1 THEN s0 / sum(s0) OVER (PARTITION BY strategy, s1.date) ELSE s0 END AS weight, fwd_ret FROM s1 JOIN predictions p ON p.symbol = s1.symbol AND p.date = s1.date WHERE fwd_ret IS NOT NULL),
""" + audits._AFTER_SIGNALS[audits._AFTER_SIGNALS.index("grid AS") :] + ", cells AS (SELECT strategy, date, net_return, 20 AS blen, 252.0::DOUBLE AS ppy FROM tracks), " + _resampled("cells"))  # fmt: skip
def to_conviction_floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debate's conviction floor from gate to Sharpe ratio: gated days take the debated score, sizes and tracks follow; all floors in one job."""
    rows = decisions._scored(decisions._panel(spark, sf_dir)).where("technical_abstained is not null and fwd_ret is not null").withColumns({c: F.round(c, 12) for c in ("lowest_conviction", "highest_conviction")})
    debates = opinions.debate_residual(audits._arguments(spark, sf_dir)).select("symbol", "date", "residual", "contested")
    rows = rows.join(debates, ["symbol", "date"], "left")
    flags = F.array(*(F.struct(F.format_string("floor%.2f", F.lit(f)).alias("strategy"), opinions.gate_conviction(f).alias("_gated")) for f in _FLOORS))
    floors = rows.select("*", F.inline(flags))
    at = floors.withColumn("_debated", F.col("_gated") & F.col("residual").isNotNull())
    score = F.when(F.col("_debated"), F.least(F.greatest(0.65 * F.col("score") + 0.35 * F.col("residual"), F.lit(-1.0)), F.lit(1.0))).otherwise(F.col("score"))
    confidence = F.when(F.col("_debated") & F.col("contested"), F.col("confidence") * 0.7).otherwise(F.col("confidence"))
    sized = sizing.capped(at.withColumns({"score": score, "confidence": confidence}).withColumn("weight", sizing.base_size()), ["strategy", "date"], "weight")
    track = written(backtest.tracks(sized.select("strategy", "date", "symbol", "weight", "fwd_ret")), "floors")
    return rounded(with_intervals(track, 20, 252, _N_BOOT), 5)


# --- tables of reports ----------------------------------------------------------------------------


@R.add("bars", "WITH " + panel._TRACKS + ", cells AS (SELECT strategy, date, net_return, 20 AS blen, 252.0::DOUBLE AS ppy FROM tracks), bm AS (SELECT date, avg(fwd_ret) AS b FROM signals WHERE strategy = 'BuyHold' GROUP BY date), j AS (SELECT strategy, net_return AS r, b FROM tracks JOIN bm USING (date)), att AS (SELECT strategy, covar_samp(r, b) / var_samp(b) AS beta, avg(r - b) / stddev_samp(r - b) * sqrt(252) AS ir FROM j GROUP BY strategy), " + panel._perf_sql("tracks", "net_return", "strategy") + """, eq AS (SELECT date, avg(fwd_ret) AS ret FROM signals WHERE strategy = 'BuyHold' GROUP BY date),
be AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS e FROM eq), bd AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM be),
bp AS (SELECT 'equal' AS strategy, count(*) AS n, max_by(e, date) - 1 AS tr, pow(max_by(e, date), 252.0 / count(*)) - 1 AS cagr, (avg(ret) - (pow(1.06, 1/252.0) - 1)) / stddev_samp(ret) * sqrt(252) AS sharpe, min(dd) AS mdd FROM bd)
SELECT strategy, 'strategy' AS kind, n, round(total_return, 5) + 0.0 AS total_return, round(cagr, 5) + 0.0 AS cagr, round(sharpe, 5) + 0.0 AS sharpe, round(mdd, 5) + 0.0 AS max_drawdown, round(beta, 5) + 0.0 AS beta, round(ir, 5) + 0.0 AS information_ratio FROM perf JOIN att USING (strategy)
UNION ALL SELECT strategy, 'benchmark', n, round(tr, 5) + 0.0, round(cagr, 5) + 0.0, round(sharpe, 5) + 0.0, round(mdd, 5) + 0.0, NULL, NULL FROM bp""")  # fmt: skip
def p13_factsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance of every strategy with beta and information ratio beside it, and the benchmark's own row."""
    signals = panel._signals(spark, sf_dir)
    n = src.parts(spark, sf_dir)
    track = written(backtest.tracks(backtest.weights(signals, parts=n), parts=n), "tracks")
    equal = written(baselines.equal_weight(signals.where("strategy = 'BuyHold'")).select("date", "ret"), "equal")
    names = ["n", "total_return", "cagr", "sharpe", "max_drawdown"]
    own = metrics.performance(track, "net_return", ["strategy"]).select("strategy", *names).join(metrics.attribution(track, equal.withColumn("name", F.lit("equal"))).select("strategy", "beta", "information_ratio"), "strategy", "left")
    other = metrics.performance(equal.withColumn("strategy", F.lit("equal")), "ret", ["strategy"]).select("strategy", *names)
    return rounded(own.withColumn("kind", F.lit("strategy")).unionByName(other.withColumn("kind", F.lit("benchmark")), allowMissingColumns=True), 5)


@R.add()
def i8_significance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval, its p value with Holm's step-down, probabilistic and deflated Sharpe ratio of every strategy in one table."""
    track = written(panel._tracks(spark, sf_dir), "tracks")
    out = inference.holm(inference.sharpe_intervals(track, seed=5)).join(inference.deflated_sharpe(track), "strategy")
    return rounded(out.join(inference.probabilistic_sharpe(track).select("strategy", "psr"), "strategy"), 5)


@R.add()
def tq_i3_comparisons_with_every_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's Sharpe difference to buy and hold, to the equal-weight portfolio and to the index, Holm's step-down within each."""
    days = panel._days(spark, sf_dir)
    track = backtest.equal_tracks(days).select("strategy", "date", "net_return")
    index = src.index_bars(spark, sf_dir).select(F.lit("index").alias("strategy"), "date", labels.forward_return(1, decisions.Window.orderBy("date")).alias("net_return")).where("net_return is not null")
    equal = days.where("strategy = 'BuyHold'").select(F.lit("equal").alias("strategy"), "date", (F.col("fwd") / F.col("n")).alias("net_return"))  # holds all names
    every = written(track.unionByName(index).unionByName(equal), "tracks")
    out = None
    for name in ("BuyHold", "equal", "index"):
        rows = every.where((F.col("strategy") == name) | ~F.col("strategy").isin("BuyHold", "equal", "index"))
        part = inference.compare_to(rows, name, seed=5).withColumn("benchmark", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


# --- feeds, files and exports ----------------------------------------------------------------------


@R.add("headlines", """WITH t AS (SELECT doc_id, symbol, published_utc, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM headlines)
SELECT symbol, title, published_utc AS published, 'u' || doc_id AS link FROM (SELECT *, row_number() OVER (PARTITION BY symbol, lower(title) ORDER BY doc_id) AS i FROM t WHERE title <> '') WHERE i = 1""")  # fmt: skip
def n5_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each symbol, made of its headlines, and its items read from it."""
    rows = src.headlines(spark, sf_dir).withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    safe = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), safe, F.lit("</title><link>u"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>"), F.date_format("published_utc", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    feeds = rows.groupBy("symbol").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x.item), ""), F.lit("</channel></rss>")).alias("raw"))
    return news.feed_items(feeds, "raw", ["symbol"])


@R.add("headlines", "SELECT symbol, CAST(CAST(published_utc AS DATE) AS VARCHAR) AS date, title, source, 'u' || doc_id AS url FROM headlines WHERE symbol = 's1' AND CAST(published_utc AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1998-12-31'")
def s4_s5_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines written as JSON lines and read with a symbol and an inclusive range of days."""
    rows = src.headlines(spark, sf_dir).select("symbol", F.to_date("published_utc").cast("string").alias("date"), "title", "source", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("published_utc").cast("string").alias("published_utc"))
    at = f"{shared_dir(spark)}/headlines-{uuid.uuid4().hex}"
    rows.write.json(at)
    return corpus.read_corpus(spark, at, "s1", "1996-06-01", "1998-12-31").drop("published_utc")


@R.add("predictions", "SELECT 'model_seed' || k AS run, symbol, date, round(prob_up + k / 10.0, 6) AS prob_up FROM predictions, range(2) r(k)")
def s10_prediction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' predictions written as CSV files named after the run, and read back with that name."""
    at = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = src.predictions(spark, sf_dir)
    for k in range(2):
        rows.select("symbol", "date", F.round(F.col("prob_up") + k / 10, 6).alias("prob_up")).write.option("header", True).csv(f"{at}/oos_model_seed{k}.csv")
    return rounded(corpus.read_runs(spark, f"{at}/oos_*.csv", "symbol string, date date, prob_up double"))


@R.add("statements", "SELECT symbol, 'annual' AS section, fiscal, label, round(value, 2) + 0.0 AS value FROM (SELECT symbol, fiscal, unnest(['revenue', 'net_profit', 'equity']) AS label, unnest([revenue, net_profit, equity]) AS value FROM statements)")
def s11_statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as a nested JSON text for each symbol, in a file under its name, read back to long rows."""
    at = f"{shared_dir(spark)}/statements-{uuid.uuid4().hex}"
    years = src.statements(spark, sf_dir).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("fiscal", F.create_map(*(x for c in ("revenue", "net_profit", "equity") for x in (F.lit(c), F.col(c))))))).alias("m"))
    years.select(F.concat("symbol", F.lit(".json")).alias("file"), F.to_json(F.create_map(F.lit("annual"), "m")).alias("value")).write.partitionBy("file").text(at)
    return rounded(corpus.read_statements(spark, f"{at}/*"), 2)


@R.add("bars", "WITH " + panel._TRACKS + ", " + panel._perf_sql("tracks", "net_return", "strategy") + " SELECT strategy, n, round(total_return, 6) AS net_total_return, round(sharpe, 6) AS net_sharpe, (SELECT count(*) FROM tracks t WHERE t.strategy = perf.strategy) AS n_curve FROM perf")
def s14_exported_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance and equity curves exported as JSON and CSV, and what the files hold."""
    track = written(panel._tracks(spark, sf_dir), "tracks")
    perf = backtest.summary_table(track).select("strategy", "n", F.col("total_return").alias("net_total_return"), F.col("sharpe").alias("net_sharpe"))
    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    corpus.export({"performance": perf}, at)
    corpus.export({"curve": metrics.curve(track, "net_return", ["strategy"]).select("strategy", "date", "equity", "drawdown")}, at, "csv")
    back = spark.read.schema(perf.schema).json(f"{at}/performance")
    curve = spark.read.option("header", True).schema("strategy string, date date, equity double, drawdown double").csv(f"{at}/curve").groupBy("strategy").agg(F.count("equity").alias("n_curve"))
    return rounded(back.join(curve, "strategy"))


# --- alignment and demotion ------------------------------------------------------------------------


@R.add("bars index_bars", "WITH i AS (SELECT date, lead(open, 2) OVER (ORDER BY date) / lead(open, 1) OVER (ORDER BY date) - 1 AS r FROM index_bars) SELECT DISTINCT b.date, round(coalesce(i.r, 0), 6) + 0.0 AS ret, i.r IS NOT NULL AS has_bench FROM bars b LEFT JOIN i ON i.date = b.date AND day(i.date) % 5 <> 0")
def n11_aligned_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index without every fifth day of a month, on all sessions."""
    index = src.index_bars(spark, sf_dir).select("date", labels.forward_return(1, decisions.Window.orderBy("date")).alias("ret")).where("day(date) % 5 <> 0")
    return rounded(baselines.align_benchmark(src.bars(spark, sf_dir), index))


@R.add(decisions._VIEWS, "WITH " + decisions._SIZED + " SELECT symbol, date, round(s0, 6) + 0.0 AS size_before, round(size, 6) + 0.0 AS size, CASE WHEN score > 0.05 AND size > 0 THEN 'BUY' WHEN score > 0.05 THEN 'HOLD' ELSE 'FLAT' END AS action, CASE WHEN trigger IS NOT NULL THEN 'stopped by ' || trigger || (CASE WHEN size < s0 THEN '; ' ELSE '' END) ELSE '' END || (CASE WHEN size < s0 THEN 'scaled to the gross cap' ELSE '' END) AS risk_notes FROM cs")
def k8_demoted_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of breakers and of the cap, and what would be BUY without a size."""
    rows = decisions._scored(decisions._panel(spark, sf_dir))
    rows = rows.withColumn("size", sizing.base_size()).withColumn("size_before", F.col("size"))
    notes = F.when(F.col("trigger").isNotNull(), F.array(F.concat(F.lit("stopped by "), "trigger"))).otherwise(F.array().cast("array<string>"))
    out = sizing.demoted(sizing.capped(rows, ["date"]).withColumns({"risk_notes": notes, "action": F.when(F.col("score") > 0.05, "BUY").otherwise("FLAT")}))
    return rounded(out.select("symbol", "date", "size_before", "size", "action", F.array_join("risk_notes", "; ").alias("risk_notes")))
