"""Further queries: sweeps, sub-periods, benchmarks, bar adjustment, matched scorers and rebalancing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.tables import shared_dir, written
from panelloom.operators import backtest, baselines, explain, features, labels, ledger, news, opinions, scoring, sentiment, sizing, stored
from panelloom.plans import panel, text
from panelloom.plans.registry import Registry, rounded
from panelloom.sources import adapters as src
from panelloom.sources import corpus, ledger_log

R = Registry()


@R.add("bars", "SELECT symbol, date, round(open * (CASE WHEN year(date) % 2 = 1 THEN 1 / 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS open, round(high * (CASE WHEN year(date) % 2 = 1 THEN 1 / 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS high, round(low * (CASE WHEN year(date) % 2 = 1 THEN 1 / 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS low, round(close * (CASE WHEN year(date) % 2 = 1 THEN 1 / 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS close, volume FROM bars")
def s3_bar_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = src.bars(spark, sf_dir).withColumn("adjusted", F.col("close") * F.when(F.year("date") % 2 == 1, 1 / 3.0).otherwise(1.0))
    return rounded(corpus.adjusted(raw))


@R.add("bars index_bars", "SELECT 'equal' AS name, date, round(avg(f), 8) + 0.0 AS ret FROM (SELECT date, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS f FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY date UNION ALL SELECT 'index', date, round(lead(open, 2) OVER (ORDER BY date) / lead(open, 1) OVER (ORDER BY date) - 1, 8) + 0.0 FROM index_bars")
def b4_b5_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = src.bars(spark, sf_dir).select("date", labels.forward_return(1).alias("fwd_ret"))
    index = src.index_bars(spark, sf_dir).withColumn("symbol", F.lit("index")).select(F.lit("index").alias("name"), "date", labels.forward_return(1).alias("ret"))
    return rounded(baselines.equal_weight(fwd).select(F.lit("equal").alias("name"), "date", "ret").unionByName(index), 8)


@R.add("scored bars", "WITH " + text._VIEWS + " SELECT count(*) AS n, count(views.sentiment) AS with_view, round(avg(CASE WHEN views.sentiment IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM bars LEFT JOIN views USING (symbol, date)")
def n12_coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(news.coverage_share(src.bars(spark, sf_dir).select("symbol", "date"), text._views(spark, sf_dir)))


@R.add("scored", """WITH b AS (SELECT doc_id, (g - b) / (g + b + u) AS other FROM (SELECT doc_id, 1.0 + length(title) - length(replace(title, 'i', '')) AS g, 1.0 + length(title) - length(replace(title, 'u', '')) AS b, 1.0 + length(title) - length(replace(title, 'n', '')) AS u FROM headlines))
SELECT count(*) AS n, round(corr(score, other), 6) + 0.0 AS correlation, round(avg(CASE WHEN (score > 0) = (other > 0) THEN 1.0 ELSE 0.0 END), 6) AS same_sign FROM scored JOIN b USING (doc_id)""")  # fmt: skip
def e15_matched_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = src.scored(spark, sf_dir, "iun").select("doc_id", F.col("p_good").alias("g"), F.col("p_bad").alias("b"))
    rows = src.scored(spark, sf_dir).join(other.select("doc_id", (F.col("g") - F.col("b")).alias("other")), "doc_id")
    return rounded(rows.agg(F.count("*").alias("n"), F.corr("score", "other").alias("correlation"), F.avg(((F.col("score") > 0) == (F.col("other") > 0)).cast("double")).alias("same_sign")))


@R.add("scored bars", "WITH " + text._EVENTS + """,
own AS (SELECT *, CASE WHEN count(sentiment) OVER v >= 10 THEN avg(sentiment) OVER v END AS o FROM ev WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
mk AS (SELECT date, sum(s) OVER b / nullif(sum(n) OVER b, 0) AS m FROM (SELECT date, sum(sentiment) AS s, count(*) AS n FROM ev GROUP BY date) WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tt AS (SELECT own.date, sentiment, fwd_ret, sentiment - coalesce(o, m, 0) AS tr FROM own JOIN mk USING (date)),
vs AS (SELECT fwd_ret, sentiment AS raw, sentiment - avg(sentiment) OVER d AS cs, tr, tr - avg(tr) OVER d AS bo FROM tt WINDOW d AS (PARTITION BY date)),
va AS (SELECT 'raw' AS variant, raw AS s, fwd_ret FROM vs UNION ALL SELECT 'cross_section', cs, fwd_ret FROM vs UNION ALL SELECT 'trailing', tr, fwd_ret FROM vs UNION ALL SELECT 'both', bo, fwd_ret FROM vs),
a AS (SELECT variant, count(*) AS n, regr_slope(fwd_ret, s) AS slope, regr_sxx(fwd_ret, s) AS xx, regr_syy(fwd_ret, s) AS yy, regr_sxy(fwd_ret, s) AS xy, avg(fwd_ret) AS m FROM va GROUP BY variant)
SELECT variant, n, round(slope, 5) + 0.0 AS slope, round(m, 5) + 0.0 AS mean_ret, round(sqrt((yy - xy * xy / xx) / (n - 2) / xx), 5) AS stderr, round(xy * xy / xx / yy, 5) AS r2, round(slope / sqrt((yy - xy * xy / xx) / (n - 2) / xx), 5) + 0.0 AS t FROM a""")  # fmt: skip
def e17_debias_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant in one grouped regression."""
    events = text._events(spark, sf_dir).drop("study")
    out = None
    for name, f in (("raw", lambda x: x), ("cross_section", sentiment.debias_cross_section), ("trailing", sentiment.debias_trailing), ("both", sentiment.debias_both)):
        rows = f(events).select(F.lit(name).alias("variant"), "sentiment", "fwd_ret")
        out = rows if out is None else out.unionByName(rows)
    return rounded(sentiment.event_regression(out, ["variant"]), 5)


_THRESHOLDS = (0.50, 0.52, 0.55)


@R.add("predictions", "WITH " + f"""x2 AS (SELECT * FROM predictions WHERE fwd_ret IS NOT NULL),
signals AS (SELECT printf('P@%.2f', t) AS strategy, date, symbol, CASE WHEN round(prob_up, 12) > t THEN 1.0 ELSE 0.0 END AS score, fwd_ret FROM x2, (VALUES {", ".join(f"({t}::DOUBLE)" for t in _THRESHOLDS)}) v(t))""" + panel._TRACKS[len(panel._SIGNALS) :] + ", " + panel._perf_sql("tracks", "net_return", "strategy", ", sum(turnover) AS tu") + " SELECT strategy, n, round(total_return, 5) AS total_return, round(sharpe, 5) AS sharpe, round(tu / (n / 252.0), 5) AS turnover_per_year FROM perf")  # fmt: skip
def th_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.predictions(spark, sf_dir).where("fwd_ret is not null").select(F.lit("P").alias("strategy"), "date", "symbol", F.round("prob_up", 12).alias("score"), "fwd_ret")
    return rounded(backtest.threshold_sweep(rows, list(_THRESHOLDS), src.parts(spark, sf_dir)).select("strategy", "n", "total_return", "sharpe", "turnover_per_year"), 5)


@R.add("bars", "WITH " + panel._TRACKS + ", tp AS (SELECT tracks.*, name FROM tracks JOIN (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('late', DATE '1997-01-01', DATE '2001-12-31')) v(name, lo, hi) ON date BETWEEN lo AND hi), " + panel._perf_sql("tp", "net_return", "strategy, name") + " SELECT strategy, name, n, round(total_return, 6) AS total_return, round(volatility, 6) AS volatility, round(mdd, 6) AS max_drawdown FROM perf WHERE n >= 5")
def tr_sub_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.sql("select * from values ('early', date '1995-01-01', date '1996-12-31'), ('late', date '1997-01-01', date '2001-12-31') as v(name, lo, hi)")
    return rounded(backtest.by_period(panel._tracks(spark, sf_dir), periods).select("strategy", "name", "n", "total_return", "volatility", "max_drawdown"))


@R.add("bars", """WITH q AS (SELECT symbol, max_by(close, date) AS price FROM bars GROUP BY symbol), p AS (SELECT s_suppkey % 4 AS account, 's' || s_suppkey AS symbol, 100.0 + s_suppkey % 7 AS quantity FROM supplier WHERE s_suppkey % 3 <> 0),
t AS (SELECT s_suppkey % 4 AS account, 's' || s_suppkey AS symbol, 0.01 * (s_suppkey % 5) AS weight FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT a AS account, 1e6 + coalesce(v, 0) AS equity FROM (VALUES (0), (1), (2), (3)) x(a) LEFT JOIN (SELECT account, sum(quantity * price) AS v FROM p JOIN q USING (symbol) GROUP BY account) ON account = a),
d AS (SELECT account, symbol, quantity, price, coalesce(weight, 0) * equity - coalesce(quantity, 0) * price AS delta FROM t FULL JOIN p USING (account, symbol) JOIN q USING (symbol) JOIN e USING (account))
SELECT account, symbol, CASE WHEN delta < 0 THEN 'sell' ELSE 'buy' END AS side, round(CASE WHEN delta < 0 THEN least(-delta / price, coalesce(quantity, 0)) ELSE delta / price END, 4) AS quantity FROM d WHERE abs(delta) >= 100""")  # fmt: skip
def v1_rebalance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = src.table(spark, sf_dir, "supplier").select(k, (k % 4).alias("account"), F.concat(F.lit("s"), k).alias("symbol"))
    quotes = src.bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    held = names.where(k % 3 != 0).select("account", "symbol", (100.0 + k % 7).alias("quantity"))
    wanted = names.where(k % 2 == 0).select("account", "symbol", (0.01 * (k % 5)).alias("weight"))
    cash = names.select("account").distinct().withColumn("cash", F.lit(1e6))
    return rounded(ledger.orders(wanted, held, quotes, cash).drop("seq"), 4)


@R.add()
def x7_o13_rationale_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = opinions.technical(src.predictions(spark, sf_dir))
    return opinions.brief(ops).select("symbol", "date", explain.sections(F.replace("brief", F.lit("\n"), F.lit("; "))).alias("sections")).select("symbol", "date", F.size("sections").alias("n"), F.element_at("sections", "technical").alias("technical"))


# --- scorers, logs and stored models ------------------------------------------------------------

_LABELS = ("good", "bad", "unknown")
_WORDS = {"the": (1.0, 0.0, 0.0), "die": (1.0, 0.0, 0.0), "of": (0.0, 1.0, 0.0), "les": (0.0, 1.0, 0.0), "in": (0.0, 0.0, 0.5)}
_COUNTS = {k: " + ".join(f"{v[k]} * len(list_filter(ws, lambda x: x = '{w}'))" for w, v in _WORDS.items() if v[k]) for k in range(3)}


@R.add("scored", f"""WITH e AS (SELECT doc_id, [{", ".join(_COUNTS[k] for k in range(3))}]::DOUBLE[] AS z FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS ws FROM documents)),
l AS (SELECT doc_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM e)
SELECT 'letters-1' AS scorer, doc_id, round(p_good, 6) AS p_good, round(p_bad, 6) AS p_bad, round(p_unknown, 6) AS p_unknown, true AS hit FROM scored
UNION ALL SELECT 'lexicon-1', doc_id, round(e[1] / list_sum(e), 6), round(e[2] / list_sum(e), 6), round(e[3] / list_sum(e), 6), true FROM l""")  # fmt: skip
def m6_s15_two_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by two scorers over one cache; the second pass forwards nothing, so every row is a hit."""
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    out = None
    for scorer in (scoring.LetterShares(_LABELS, "eao"), scoring.Lexicon(_LABELS, _WORDS)):
        scoring.scored(docs, "text", scorer, cache)
        again = scoring.scored(docs, "text", scorer, cache).select(F.lit(scorer.name).alias("scorer"), "doc_id", "p_good", "p_bad", "p_unknown", "hit")
        out = again if out is None else out.unionByName(again)
    return rounded(out)


@R.add("bars", """WITH atr0 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))),
br AS (SELECT symbol, date, CASE WHEN open / pc - 1 <= -0.03 THEN 'gap_down' WHEN high - low > 2.5 * atr THEN 'range' END AS kind FROM (SELECT *, CASE WHEN count(tr) OVER v >= 14 THEN avg(tr) OVER v END AS atr FROM atr0 WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)))
SELECT CAST(year(date) AS VARCHAR) AS batch, symbol, date, kind FROM br WHERE kind IS NOT NULL""")  # fmt: skip
def v12_risk_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breakers' events, logged year by year; the first two years are sent again and count once."""
    events = written(sizing.breaker(src.bars(spark, sf_dir)).withColumnRenamed("trigger", "kind"), "events")
    log = f"{shared_dir(spark)}/risk-{uuid.uuid4().hex}"
    years = sorted(r["y"] for r in events.select(F.year("date").alias("y")).distinct().collect())
    for y in [*years, *years[:2]]:
        ledger_log.append_once(events.where(F.year("date") == y), log, str(y))
    return ledger_log.read_log(spark, log, "symbol string, date date, kind string").select("batch", "symbol", "date", "kind")


@R.add("headlines", "SELECT symbol, title, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, title ORDER BY doc_id % 3 DESC, doc_id DESC) AS i FROM headlines) WHERE i = 1")
def s6_s8_upsert_into_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards of headlines put into a stored table one after the other, the first once more at the end."""
    rows = src.headlines(spark, sf_dir).select("symbol", "title", "source", "doc_id", (F.col("doc_id") % 3).alias("shard"))
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for shard in (0, 1, 2, 0):
        ledger_log.upsert_into(rows.where(F.col("shard") == shard), at, ["symbol", "title"], ["shard", "doc_id"], parts=8)
    return spark.read.parquet(at).select("symbol", "title", "source", "doc_id")


@R.add()
def m5_latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on the days to the end of 1996 and stored, applied to the latest common window by March 1997."""
    bars = src.bars(spark, sf_dir)
    rows = written(bars.select("symbol", "date", features.ret().alias("ret_1d"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range_pct"), labels.forward_return(1).alias("fwd_ret")), "panel")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    stored.fit_and_store(rows.where("date <= date'1996-12-31'"), ["ret_1d", "range_pct"], path, length=10)
    return rounded(stored.score_latest(spark, rows, path, "1997-03-31"), 5)
