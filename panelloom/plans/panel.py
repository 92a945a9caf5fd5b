"""Queries over the bar panel: features, labels, audits, baselines, backtests and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.costs import DELIVERY, rate
from panelloom.operators import backtest, baselines, features, labels, metrics, quality
from panelloom.plans.registry import Registry, rounded
from panelloom.sources import adapters as src

R = Registry()

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def _roll(f: str, column: str, n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({column}) {over} >= {n} THEN {f}({column}) {over} END)"


_RET = """ret AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d,
  close / lag(close, 10) OVER w - 1 AS ret_10d, close / lag(close, 20) OVER w - 1 AS ret_20d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""

_WINDOWED = f"""SELECT symbol, date, round(ret_1d, 6) + 0.0 AS ret_1d, round(ret_5d, 6) + 0.0 AS ret_5d, round(ret_10d, 6) + 0.0 AS ret_10d, round(ret_20d, 6) + 0.0 AS ret_20d,
  round((close - {_roll("avg", "close", 20)}) / nullif(2 * {_roll("stddev_samp", "close", 20)}, 0), 6) + 0.0 AS bb_pos,
  round((volume - {_roll("avg", "volume", 20)}) / nullif({_roll("stddev_samp", "volume", 20)}, 0), 6) + 0.0 AS vol_z20,
  round({_roll("stddev_samp", "ret_1d", 20)} * sqrt(252), 6) + 0.0 AS vol_20,
  round(close / {_roll("avg", "close", 20)} - 1, 6) + 0.0 AS dist_sma20, round(close / {_roll("avg", "close", 50)} - 1, 6) + 0.0 AS dist_sma50,
  round(close / {_roll("avg", "close", 200)} - 1, 6) + 0.0 AS dist_sma200,
  round((close - {_roll("min", "low", 14)}) / nullif({_roll("max", "high", 14)} - {_roll("min", "low", 14)}, 0), 6) + 0.0 AS stoch_k,
  round((high - low) / close, 6) + 0.0 AS range_pct
FROM ret"""


@R.add("bars", "SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def s2_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.bars(spark, sf_dir))


@R.add("bars", "SELECT symbol, date, round(close, 6) AS close FROM bars WHERE symbol = 's1' AND date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def s1_prices_of_one_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.bars(spark, sf_dir).where((F.col("symbol") == "s1") & F.col("date").between("1994-01-01", "1995-12-31")).select("symbol", "date", "close"))


@R.add("bars", "WITH " + _RET + "\n" + _WINDOWED)
def f1_f10_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.window_features(src.bars(spark, sf_dir))
    return rounded(rows.drop("open", "high", "low", "close", "volume"))


def _ewm(x: str, a: float) -> str:
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY date), lambda p, q: (1 - {a!r}) * p + {a!r} * q)"


_RECURSIVE = f"""d AS (SELECT symbol, date, open, close, high, low, close - lag(close) OVER w AS ch, lag(close) OVER w AS pc, row_number() OVER w AS n FROM bars {_W}),
g AS (SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END AS loss,
      greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM d),
e AS (SELECT symbol, date, open, close, high, low, n, list_reduce(CASE WHEN n = 1 THEN [0.0::DOUBLE] ELSE list_filter(list(gain) OVER w, lambda x: x IS NOT NULL) END, lambda p, q: (1 - 1/14.0::DOUBLE) * p + q * (1/14.0::DOUBLE)) AS eg,
      list_reduce(CASE WHEN n = 1 THEN [0.0::DOUBLE] ELSE list_filter(list(loss) OVER w, lambda x: x IS NOT NULL) END, lambda p, q: (1 - 1/14.0::DOUBLE) * p + q * (1/14.0::DOUBLE)) AS el,
      list_reduce(list(tr) OVER w, lambda p, q: (1 - 1/14.0::DOUBLE) * p + q * (1/14.0::DOUBLE)) AS ea,
      list_reduce(list(close) OVER w, lambda p, q: (1 - 2/13.0::DOUBLE) * p + q * (2/13.0::DOUBLE)) - list_reduce(list(close) OVER w, lambda p, q: (1 - 2/27.0::DOUBLE) * p + q * (2/27.0::DOUBLE)) AS macd
      FROM g WHERE n > 0 {_W}),
s AS (SELECT *, list_reduce(list(macd) OVER w, lambda p, q: 0.8::DOUBLE * p + 0.2::DOUBLE * q) AS sig FROM e {_W})"""  # fmt: skip


@R.add("bars", "WITH " + _RECURSIVE + """ SELECT symbol, date, round(coalesce(CASE WHEN n > 14 AND el <> 0 THEN 100 - 100 / (1 + eg / el) END, 50.0) / 100, 6) AS rsi_14,
       round((macd - sig) / close, 6) + 0.0 AS macd_hist, round(CASE WHEN n >= 14 THEN ea / close END, 6) AS atr_14 FROM s""")  # fmt: skip
def f2_f3_f5_recursive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.recursive_features(src.bars(spark, sf_dir)).select("symbol", "date", "rsi_14", "macd_hist", "atr_14"))


@R.add("bars", f"""WITH t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {_W})
SELECT symbol, date, round(CASE WHEN count(tr) OVER v >= 14 THEN avg(tr) OVER v END, 8) AS atr_prior FROM t
WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def f11_causal_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.causal_atr(src.bars(spark, sf_dir)).select("symbol", "date", "atr_prior"), 8)  # a 14th of a number of six places never ties at the eighth


_MACRO = """m0 AS (SELECT date, close AS index_close, close / lag(close, 20) OVER (ORDER BY date) - 1 AS index_mom_20d FROM index_bars),
v0 AS (SELECT date, vix, list(vix) OVER (ORDER BY date ROWS 251 PRECEDING) AS vs FROM vix),
macro AS (SELECT m0.*, vix, CASE WHEN len(vs) >= 60 THEN (len(list_filter(vs, lambda x: x < vix)) + (len(list_filter(vs, lambda x: x = vix)) + 1) / 2) / len(vs) END AS vix_percentile FROM m0 LEFT JOIN v0 USING (date))"""


@R.add("index_bars vix", "WITH " + _MACRO + " SELECT date, round(index_close, 6) AS index_close, round(index_mom_20d, 6) + 0.0 AS index_mom_20d, round(vix, 6) AS vix, round(vix_percentile, 6) AS vix_percentile FROM macro")
def f18_macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.macro_series(src.index_bars(spark, sf_dir), src.vix(spark, sf_dir)))


_LH = f"{_roll('min', 'low', 252)}", f"{_roll('max', 'high', 252)}"
_REGIME = _MACRO + f""",
j AS (SELECT bars.*, macro.index_close, index_mom_20d, vix, vix_percentile FROM bars LEFT JOIN macro USING (date)),
r0 AS (SELECT symbol, date, close, low, high, close / lag(close) OVER w - 1 AS ret_1d, close / lag(close, 60) OVER w - index_close / lag(index_close, 60) OVER w AS rel_strength_60d,
       index_mom_20d, vix, vix_percentile FROM j {_W}),
r1 AS (SELECT *, close / {_roll("avg", "close", 200)} - 1 AS gap, {_LH[0]} AS lo, {_LH[1]} AS hi, round({_roll("stddev_samp", "ret_1d", 20)} * sqrt(252), 10) AS vol_20 FROM r0),
r2 AS (SELECT *, list_filter(list(vol_20) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), lambda x: x IS NOT NULL) AS vs FROM r1),
regime AS (SELECT symbol, date, close, ret_1d, sign(gap) * 1.0 AS trend, CASE WHEN gap IS NOT NULL THEN least(greatest(gap, -0.5), 0.5) END AS trend_strength, rel_strength_60d,
  CASE WHEN hi > lo THEN least(greatest((close - lo) / (hi - lo), 0.0), 1.0) END AS pos_52w, vol_20,
  CASE WHEN vol_20 IS NOT NULL AND len(vs) >= 60 THEN (len(list_filter(vs, lambda x: x < vol_20)) + (len(list_filter(vs, lambda x: x = vol_20)) + 1) / 2) / len(vs) END AS vol_percentile,
  index_mom_20d, vix, vix_percentile FROM r2)"""


@R.add("bars index_bars vix", "WITH " + _REGIME + " SELECT symbol, date, round(trend, 6) + 0.0 AS trend, round(trend_strength, 6) + 0.0 AS trend_strength, round(rel_strength_60d, 6) + 0.0 AS rel_strength_60d, round(pos_52w, 6) + 0.0 AS pos_52w, round(vol_20, 6) + 0.0 AS vol_20, round(vol_percentile, 6) AS vol_percentile FROM regime")
def f12_f17_regime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.regime_table(src.bars(spark, sf_dir), features.macro_series(src.index_bars(spark, sf_dir), src.vix(spark, sf_dir)))
    return rounded(table.select("symbol", "date", "trend", "trend_strength", "rel_strength_60d", "pos_52w", "vol_20", "vol_percentile"))


@R.add("index_bars", """WITH i AS (SELECT date, close / lag(close, 60) OVER (ORDER BY date) - 1 AS r, close / max(close) OVER (ORDER BY date) - 1 AS gap FROM index_bars WHERE date >= DATE '1994-01-01')
SELECT date, CASE WHEN r < -0.10 THEN 'crash' WHEN gap > -0.03 THEN 'bull' ELSE 'choppy' END AS regime FROM i""")  # fmt: skip
def f19_market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.market_regime(src.index_bars(spark, sf_dir), "1994-01-01")


@R.add("bars", f"SELECT symbol, date, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) + 0.0 AS mom_12_1, round(lead(open, 2) OVER w / lead(open, 1) OVER w - 1, 6) + 0.0 AS fwd_1, round(lead(open, 6) OVER w / lead(open, 1) OVER w - 1, 6) + 0.0 AS fwd_5 FROM bars {_W}")
def f20_l1_momentum_and_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.momentum_12_1(src.bars(spark, sf_dir)).select("symbol", "date", "mom_12_1", labels.forward_return(1).alias("fwd_1"), labels.forward_return(5).alias("fwd_5")))


# --- labels, folds, samples ---------------------------------------------------------------------

_FWD = f"fw AS (SELECT *, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd_ret, close / lag(close) OVER w - 1 AS ret_1d FROM bars {_W})"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars(spark, sf_dir).withColumns({"fwd_ret": labels.forward_return(1), "ret_1d": features.ret(), "range_pct": (F.col("high") - F.col("low")) / F.col("close")})


@R.add("bars", "WITH " + _FWD + """, v AS (SELECT *, count(*) OVER f AS n, sum(CASE WHEN ret_1d IS NOT NULL AND fwd_ret IS NOT NULL THEN 1 ELSE 0 END) OVER f AS ok, flatten(list([ret_1d::FLOAT, ((high - low) / close)::FLOAT]) OVER f) AS xs
  FROM fw WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 29 PRECEDING))
SELECT symbol, date, 60 AS n_values, round(list_sum(list_transform(range(1, 61), lambda k: k * xs[k]::DOUBLE)), 5) + 0.0 AS weighed, round(xs[1]::DOUBLE, 6) + 0.0 AS first_value, round(xs[60]::DOUBLE, 6) + 0.0 AS last_value, CAST(fwd_ret > 0 AS INT) AS y FROM v WHERE n = 30 AND ok = 30""")  # fmt: skip
def l2_l3_l5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = labels.flatten(labels.sequences(_labelled(spark, sf_dir), ["ret_1d", "range_pct"], "fwd_ret"))
    # Every value counts in `weighed`, by its place.
    weighed = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, k: v.cast("double") * k), F.lit(0.0), lambda s, v: s + v)
    return rounded(flat.select("symbol", "date", F.size("x").alias("n_values"), F.round(weighed, 5).alias("weighed"), F.get("x", F.lit(0)).cast("double").alias("first_value"), F.element_at("x", -1).cast("double").alias("last_value"), "y"))


@R.add("bars", "WITH " + _FWD + " SELECT symbol, date, CAST(fwd_ret > median(fwd_ret) OVER (PARTITION BY date) AS INT) AS y FROM fw WHERE fwd_ret IS NOT NULL")
def l4_cross_sectional_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.cross_sectional(_labelled(spark, sf_dir).where("fwd_ret is not null")).select("symbol", "date", "y")


_FOLDS = """b AS (SELECT min(date) AS lo, max(date) AS hi FROM bars),
c AS (WITH RECURSIVE s(cursor) AS (SELECT CAST(lo + 1096 AS DATE) FROM b UNION ALL SELECT CAST(cursor + INTERVAL 6 MONTH AS DATE) FROM s, b WHERE CAST(cursor + INTERVAL 6 MONTH AS DATE) < hi) SELECT cursor FROM s, b WHERE cursor < hi),
f AS (SELECT cursor - 1096 AS train_lo, cursor - 10 AS train_hi, cursor AS test_lo, CAST(cursor + INTERVAL 6 MONTH AS DATE) AS test_hi FROM c),
folds AS (SELECT f.*, (SELECT count(*) FROM bars WHERE date >= train_lo AND date < train_hi) AS n_train, (SELECT count(*) FROM bars WHERE date >= test_lo AND date < test_hi) AS n_test FROM f)"""


@R.add("bars", "WITH " + _FOLDS + " SELECT CAST(row_number() OVER (ORDER BY test_lo) - 1 AS INT) AS fold, CAST(train_lo AS DATE) AS train_lo, CAST(train_hi AS DATE) AS train_hi, test_lo, test_hi, n_train, n_test FROM folds WHERE n_train > 200 AND n_test > 20")
def l6_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.folds(src.bars(spark, sf_dir).select("date")).select("fold", "train_lo", "train_hi", "test_lo", "test_hi", "n_train", "n_test")


@R.add("bars", "WITH " + _FWD + """, y AS (SELECT *, year(date) AS fold FROM fw WHERE ret_1d IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY date, symbol) AS i, count(*) OVER (PARTITION BY fold) AS n FROM y),
t AS (SELECT *, i > n - greatest(1, floor(0.15 * n)) AS is_tail FROM r),
s AS (SELECT fold, avg(ret_1d) AS m, stddev_pop(ret_1d) AS sd FROM t WHERE NOT is_tail GROUP BY fold)
SELECT symbol, date, fold, is_tail, round(least(greatest((ret_1d - m) / (CASE WHEN sd < 1e-8 THEN 1 ELSE sd END), -8.0), 8.0), 6) + 0.0 AS ret_1d FROM t JOIN s USING (fold)""")  # fmt: skip
def l7_l8_standardised_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).where("ret_1d is not null").withColumn("fold", F.year("date").cast("long"))
    rows = labels.validation_tail(rows.select("symbol", "date", "fold", "ret_1d"), ["fold"])
    return rounded(labels.standardise(rows, ["ret_1d"], ~F.col("is_tail"), ["fold"]))


@R.add("bars", "WITH s AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)) SELECT symbol, date FROM bars WHERE date IN (SELECT date FROM s WHERE (i - 1) % 5 = 0)")
def l9_every_fifth_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.every_hth_session(src.bars(spark, sf_dir).select("symbol", "date"), 5)


@R.add("headlines", "SELECT doc_id, symbol FROM headlines ORDER BY (lower(title) LIKE '%in%') DESC, md5('7|' || doc_id || '|' || symbol) LIMIT 200")
def l10_l11_prioritised_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sample_rows(src.headlines(spark, sf_dir), 200, ["doc_id", "symbol"], 7, F.lower("title").contains("in")).select("doc_id", "symbol")


@R.add("bars", "WITH " + _FWD + " SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date, round(avg(CASE WHEN fwd_ret > 0 THEN 1.0 WHEN fwd_ret IS NOT NULL THEN 0.0 END), 6) AS up_rate FROM fw")
def l12_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.summary(_labelled(spark, sf_dir)))


# --- data quality -------------------------------------------------------------------------------

_AUDIT = f"""p AS (SELECT symbol, date, close, volume, close / lag(close) OVER w - 1 AS r, lag(close) OVER w AS pc FROM bars {_W}),
ib AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS br FROM index_bars),
z AS (SELECT p.*, coalesce(abs(br), 0) >= 0.05 AS explained,
  CASE WHEN count(r) OVER v >= 20 THEN stddev_samp(r) OVER v END AS sd FROM p LEFT JOIN ib USING (date) WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
st AS (SELECT symbol, date, CASE WHEN abs(close - pc) <= 1e-8 + 1e-5 * abs(pc) THEN 0 ELSE 1 END AS brk FROM p),
run AS (SELECT symbol, date, sum(brk) OVER (PARTITION BY symbol ORDER BY date) AS id FROM st),
num AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM index_bars),
gap AS (SELECT symbol, i, lead(i) OVER (PARTITION BY symbol ORDER BY i) AS nx FROM bars JOIN num USING (date)),
findings AS (
  SELECT symbol, date, 'corporate_action' AS kind FROM z WHERE abs(r) > 0.15 AND NOT explained
  UNION ALL SELECT symbol, date, 'zero_volume' FROM p WHERE volume <= 0
  UNION ALL SELECT symbol, date, 'missing_day' FROM (SELECT symbol, unnest(range(i + 1, nx)) AS i FROM gap WHERE nx > i + 1) JOIN num USING (i)
  UNION ALL SELECT symbol, max(date), 'stale_run' FROM run GROUP BY symbol, id HAVING count(*) >= 5
  UNION ALL SELECT symbol, date, 'outlier_spike' FROM z WHERE sd > 1e-6 AND abs(r) / sd > 6 AND NOT explained AND abs(r) <= 0.15)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit(src.bars(spark, sf_dir), src.index_bars(spark, sf_dir))


@R.add("bars index_bars", "WITH " + _AUDIT + " SELECT symbol, date, kind FROM findings")
def q1_q6_audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@R.add("bars index_bars", "WITH " + _AUDIT + " SELECT kind, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM findings GROUP BY kind")
def q7_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_findings(spark, sf_dir))


@R.add("bars", "SELECT symbol, max(date) AS last_date, date_diff('day', max(date), DATE '1998-12-05') AS age, date_diff('day', max(date), DATE '1998-12-05') <= 4 AS fresh FROM bars GROUP BY symbol")
def q8_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.freshness(src.bars(spark, sf_dir), "1998-12-05")


@R.add("bars", "SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols, count(*) = count(DISTINCT date) * count(DISTINCT symbol) AS complete FROM bars")
def q10_grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grid(src.bars(spark, sf_dir))


# --- baselines and backtests --------------------------------------------------------------------

_SIGNALS = f"""x0 AS (SELECT symbol, date, open, close, low, high, close / lag(close) OVER w - 1 AS ret_1d, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd_ret FROM bars {_W}),
x1 AS (SELECT *, (close - {_roll("min", "low", 14)}) / nullif({_roll("max", "high", 14)} - {_roll("min", "low", 14)}, 0) AS stoch_k FROM x0),
x2 AS (SELECT *, last_value(CASE WHEN stoch_k < 0.3 THEN 1.0 WHEN stoch_k > 0.7 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS held FROM x1 WHERE fwd_ret IS NOT NULL),
signals AS (
  SELECT 'BuyHold' AS strategy, date, symbol, 1.0::DOUBLE AS score, fwd_ret FROM x2
  UNION ALL SELECT 'MeanReversion', date, symbol, CASE WHEN ret_1d < 0 THEN 1.0 ELSE 0.0 END, fwd_ret FROM x2
  UNION ALL SELECT 'StochLatch', date, symbol, CASE WHEN stoch_k IS NULL THEN 0.0 ELSE coalesce(held, 0.0) END, fwd_ret FROM x2)"""

_TRACKS = _SIGNALS + f""",
n AS (SELECT *, sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, date) AS k FROM signals),
wt AS (SELECT strategy, date, symbol, CASE WHEN score > 0.5 THEN least(1.0 / k, 0.2) ELSE 0.0 END AS weight, fwd_ret FROM n),
grid AS (SELECT * FROM (SELECT DISTINCT strategy, date FROM wt) JOIN (SELECT DISTINCT strategy, symbol FROM wt) USING (strategy)),
full_grid AS (SELECT g.strategy, g.date, g.symbol, coalesce(weight, 0) AS weight, coalesce(fwd_ret, 0) AS fwd_ret FROM grid g LEFT JOIN wt USING (strategy, date, symbol)),
de AS (SELECT *, weight - coalesce(lag(weight) OVER (PARTITION BY strategy, symbol ORDER BY date), 0) AS delta FROM full_grid),
dy AS (SELECT strategy, date, sum(weight * fwd_ret) AS r, sum(weight) AS exposure, sum(greatest(delta, 0)) AS buy, sum(greatest(-delta, 0)) AS sell FROM de GROUP BY strategy, date),
tracks AS (SELECT strategy, date, r + greatest(1 - exposure, 0) * (pow(1.06, 1 / 252.0) - 1) AS gross_return, buy * {rate("buy", DELIVERY)!r} + sell * {rate("sell", DELIVERY)!r} AS cost,
  r + greatest(1 - exposure, 0) * (pow(1.06, 1 / 252.0) - 1) - buy * {rate("buy", DELIVERY)!r} - sell * {rate("sell", DELIVERY)!r} AS net_return, exposure, buy + sell AS turnover, r, buy, sell FROM dy)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, fwd_ret and the score of each rule whose SQL needs no recursion: buy and hold, mean reversion, and the latch on %K."""
    bars = src.bars(spark, sf_dir).withColumns({"_ret": features.ret(), "fwd_ret": labels.forward_return(1)})
    rows = features.latched(bars.select("symbol", "date", "high", "low", "close", "_ret", "fwd_ret")).where("fwd_ret is not null")
    return rows.select("symbol", "date", "fwd_ret", F.lit(1.0).alias("BuyHold"), F.when(F.col("_ret") < 0, 1.0).otherwise(0.0).alias("MeanReversion"), F.coalesce("latch", F.lit(0.0)).alias("StochLatch"))


_RULES = ("BuyHold", "MeanReversion", "StochLatch")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.signals(_rules(spark, sf_dir), {k: F.col(k) for k in _RULES})


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.equal_days(_rules(spark, sf_dir), {k: F.col(k) > 0.5 for k in _RULES}, src.sessions(spark, sf_dir), placed=True)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.equal_tracks(_days(spark, sf_dir))


def _perf_sql(rows: str, value: str, keys: str, extra: str = "") -> str:
    """Performance columns of a view, as SQL."""
    return f"""pe AS (SELECT *, exp(sum(ln(1 + {value})) OVER (PARTITION BY {keys} ORDER BY date)) AS equity FROM {rows}),
pd AS (SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS dd FROM pe),
pa AS (SELECT {keys}, count(*) AS n, max_by(equity, date) AS e, avg({value}) AS m, stddev_samp({value}) AS sd, stddev_samp(CASE WHEN {value} < pow(1.06, 1/252.0) - 1 THEN {value} END) AS ds, min(dd) AS mdd,
  avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(CASE WHEN {value} > 0 THEN {value} ELSE 0 END) AS won, sum(CASE WHEN {value} < 0 THEN -{value} ELSE 0 END) AS lost,
  kurtosis_pop({value}) AS kurt, max({value}) AS best_day, min({value}) AS worst_day,
  avg({value} * {value} * {value}) - 3 * avg({value}) * avg({value} * {value}) + 2 * pow(avg({value}), 3) AS m3, var_pop({value}) AS vp{extra} FROM pd GROUP BY {keys}),
perf AS (SELECT *, e - 1 AS total_return, pow(e, 252.0 / n) - 1 AS cagr, sd * sqrt(252) AS volatility, (m - (pow(1.06, 1/252.0) - 1)) / sd * sqrt(252) AS sharpe,
  (m - (pow(1.06, 1/252.0) - 1)) / ds * sqrt(252) AS sortino, won / lost AS profit_factor FROM pa)"""


@R.add("bars", "WITH " + _SIGNALS + " SELECT strategy, date, symbol, score FROM signals")
def b1_b2_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("strategy", "date", "symbol", "score")


@R.add("bars", "WITH " + _TRACKS + " SELECT strategy, date, round(gross_return, 8) + 0.0 AS gross_return, round(cost, 8) + 0.0 AS cost, round(net_return, 8) + 0.0 AS net_return, round(exposure, 8) + 0.0 AS exposure, round(turnover, 8) + 0.0 AS turnover FROM tracks")
def tw_tp_tb_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tracks(spark, sf_dir), 8)


@R.add("bars", "WITH " + _TRACKS + ", " + _perf_sql("tracks", "net_return", "strategy", ", sum(turnover) AS tu, avg(exposure) AS avg_exposure, avg(cost) AS ac, avg(gross_return) AS gm, stddev_samp(gross_return) AS gs") + """
SELECT strategy, n, round(total_return, 6) AS total_return, round(cagr, 6) AS cagr, round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(mdd, 6) AS max_drawdown,
  round(CASE WHEN mdd >= -1e-9 THEN 0 ELSE cagr / abs(mdd) END, 6) AS calmar, round(hit_rate, 6) AS hit_rate, round(profit_factor, 6) AS profit_factor, round(m3 / pow(vp, 1.5), 4) AS skew, round(kurt, 4) AS kurtosis,
  round(best_day, 6) AS best_day, round(worst_day, 6) AS worst_day, round(tu / (n / 252.0), 6) AS turnover_per_year, round(avg_exposure, 6) AS avg_exposure,
  round((gm - (pow(1.06, 1/252.0) - 1)) / gs * sqrt(252), 6) AS gross_sharpe, round(ac * 252, 6) AS cost_drag FROM perf""")  # fmt: skip
def b1_baseline_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(backtest.summary_table(_tracks(spark, sf_dir)).withColumns({"skew": F.round("skew", 4), "kurtosis": F.round("kurtosis", 4)}))
    return out.select("strategy", "n", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "profit_factor", "skew", "kurtosis", "best_day", "worst_day", "turnover_per_year", "avg_exposure", "gross_sharpe", "cost_drag")
