"""Block bootstrap by block moments, deflated Sharpe ratios, step-down tests and power."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, e, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.distributions import normal_cdf, normal_ppf
from panelloom.functions.tables import written


def uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from the md5 of its parts: the same on any cluster and in any engine."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("double") / float(16**12)


def draws(spark, n_boot: int, n_blocks: int, seed: int) -> DataFrame:
    """rep, blk and u of every block of every draw."""
    return spark.range(n_boot).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("blk")).withColumn("u", uniform(F.lit(seed), "rep", "blk"))


def block_moments(rows: DataFrame, values: list[str], block: int) -> DataFrame:
    """For each series and start the sums of each value, centred, and of their products over the circular
    block that starts there: whole blocks and the shorter last one.

    The series (strategy, i from 0, n) is extended by its own first rows; one bounded window does the rest.
    """
    w = Window.partitionBy("strategy").orderBy("i")
    centred = rows.select("strategy", "i", "n", *((F.col(v) - F.avg(v).over(Window.partitionBy("strategy"))).alias(v) for v in values), *(F.avg(v).over(Window.partitionBy("strategy")).alias(f"mean_{v}") for v in values))
    ring = centred.unionByName(centred.where(F.col("i") < block).withColumn("i", F.col("i") + F.col("n")))
    last = (F.col("n") - 1) % block + 1
    sums = {}
    for a in values:
        sums[f"s_{a}"], sums[f"q_{a}"] = F.col(a), F.col(a) * F.col(a)
    ahead = w.rowsBetween(0, block - 1)
    out = ring.withColumns({k: F.sum(v).over(ahead) for k, v in sums.items()})
    # The shorter block: the same sums over its own length, from running sums.
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    # Written, as the join reads it twice: a plan of both sides in one lost the ring's rows behind the end on one side.
    run = written(out.withColumns({f"r_{k}": F.coalesce(F.sum(v).over(upto), F.lit(0.0)) for k, v in sums.items()}).withColumn("last", last), "moments")
    ends = run.select("strategy", F.col("i").alias("e"), *(F.col(f"r_{k}").alias(f"e_{k}") for k in sums))
    starts = run.where(F.col("i") < F.col("n"))
    joined = starts.join(ends, (starts["strategy"] == ends["strategy"]) & (starts["i"] + starts["last"] == ends["e"])).drop(ends["strategy"])
    return joined.select("strategy", "i", "n", *(f"mean_{v}" for v in values), *sums, *((F.col(f"e_{k}") - F.col(f"r_{k}")).alias(f"l_{k}") for k in sums))


def numbered(track: DataFrame, values: list[str]) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("date")
    rows = track.where(" and ".join(f"{v} is not null" for v in values))
    return rows.select("strategy", (F.row_number().over(w) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("strategy")).alias("n"), *values)


def bootstrap(track: DataFrame, values: list[str], n_boot: int, block: int, seed: int, risk_free: float = 0.06, periods: int = 252) -> DataFrame:
    """strategy, rep and the annual Sharpe ratio sharpe_<value> of every draw of circular blocks.

    A draw joins about n / block rows of block sums instead of n rows of returns. The same draws serve all
    values of a row, so differences of two of them are paired.
    """
    rf = (1 + risk_free) ** (1 / periods) - 1
    rows = numbered(track, values)
    moments = block_moments(rows, values, block)
    sizes = moments.groupBy("strategy").agg(F.max("n").alias("n")).where(F.col("n") >= 2 * block)
    picks = sizes.select("strategy", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("blk")).crossJoin(F.broadcast(track.sparkSession.range(n_boot).select(F.col("id").alias("rep"))))  # n_boot numbers
    picks = picks.withColumns({"i": F.floor(uniform(F.lit(seed), "rep", "blk") * F.col("n")).cast("int"), "is_last": F.col("blk") == F.ceil(F.col("n") / block) - 1}).drop("n")
    drawn = picks.join(moments, ["strategy", "i"])
    total = lambda k: F.sum(F.when(F.col("is_last"), F.col(f"l_{k}")).otherwise(F.col(k)))
    out = drawn.groupBy("strategy", "rep").agg(F.max("n").alias("n"), *(total(f"{m}_{v}").alias(f"{m}_{v}") for v in values for m in ("s", "q")), *(F.max(f"mean_{v}").alias(f"mean_{v}") for v in values))
    for v in values:
        mean = F.col(f"s_{v}") / F.col("n")
        var = (F.col(f"q_{v}") - F.col("n") * mean * mean) / (F.col("n") - 1)
        out = out.withColumn(f"sharpe_{v}", F.when(var > 1e-24, F.try_divide(mean + F.col(f"mean_{v}") - rf, F.sqrt(var)) * sqrt(periods)).otherwise(0.0))
    return out.select("strategy", "rep", *(f"sharpe_{v}" for v in values))


def _interval(boots: DataFrame, value: str) -> DataFrame:
    out = boots.groupBy("strategy").agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_p"), F.avg((F.col(value) <= 0).cast("double")).alias("_lo"), F.avg((F.col(value) >= 0).cast("double")).alias("_hi"))
    return out.select("strategy", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), F.least(2 * F.least("_lo", "_hi"), F.lit(1.0)).alias("p_value"))


def sharpe_intervals(track: DataFrame, value: str = "net_return", n_boot: int = 5000, block: int = 20, seed: int = 0, periods: float = 252) -> DataFrame:
    return _interval(bootstrap(track, [value], n_boot, block, seed, periods=periods), f"sharpe_{value}")


def compare_to(track: DataFrame, benchmark: str, n_boot: int = 5000, block: int = 20, seed: int = 0) -> DataFrame:
    """Paired Sharpe difference of every other strategy to the benchmark on their common days, with Holm's
    step-down over all of them."""
    base = track.where(F.col("strategy") == benchmark).select("date", F.col("net_return").alias("other"))
    both = track.where(F.col("strategy") != benchmark).select("strategy", "date", "net_return").join(base, "date")
    boots = bootstrap(both, ["net_return", "other"], n_boot, block, seed).withColumn("difference", F.col("sharpe_net_return") - F.col("sharpe_other"))
    return holm(_interval(boots, "difference").withColumn("p_value", F.coalesce("p_value", F.lit(1.0))))


def holm(rows: DataFrame, p: str = "p_value", name: str = "strategy", alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """p_adjusted and significant; a null p takes no part. A row for each test, so the windows are small."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(p), name)
    every = Window.partitionBy(*keys)
    m, rank = F.count(p).over(every), F.row_number().over(w)
    rows = rows.withColumn("_a", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - rank + 1) * F.col(p))))
    rows = rows.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_a")
    return rows.withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


def _daily(track: DataFrame, value: str, risk_free: float, periods: int) -> DataFrame:
    rf = (1 + risk_free) ** (1 / periods) - 1
    s = track.where(F.col(value).isNotNull()).groupBy("strategy").agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.skewness(value).alias("_skew"), (F.kurtosis(value) + 3).alias("_kurt"))
    return s.withColumn("sr", F.when(F.col("_s") > 1e-12, F.try_divide(F.col("_m") - rf, F.col("_s"))))


def _psr(s: DataFrame, benchmark: Column) -> Column:
    spread = F.sqrt(F.greatest(1 - F.col("_skew") * F.col("sr") + (F.col("_kurt") - 1) / 4 * F.col("sr") * F.col("sr"), F.lit(1e-12)))
    return F.when(F.col("n") >= 3, (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / spread)


def probabilistic_sharpe(track: DataFrame, value: str = "net_return", benchmark: float = 0.0, risk_free: float = 0.06, periods: int = 252) -> DataFrame:
    """Probability that the true Sharpe ratio is over an annual benchmark."""
    s = _daily(track, value, risk_free, periods)
    return s.select("strategy", "n", (F.col("sr") * sqrt(periods)).alias("sharpe"), _psr(s, F.lit(benchmark / sqrt(periods))).alias("_z")).withColumn("psr", normal_cdf("_z")).drop("_z")


def deflated_sharpe(track: DataFrame, value: str = "net_return", risk_free: float = 0.06, periods: int = 252) -> DataFrame:
    """expected_max of as many trials as there are strategies, and the probability of beating it."""
    s = _daily(track, value, risk_free, periods)
    trials = s.agg(F.count("sr").alias("_k"), F.stddev_samp("sr").alias("_sd"))  # one row
    trials = trials.withColumns({"_z1": normal_ppf(1 - 1 / F.col("_k")), "_z2": normal_ppf(1 - 1 / (F.col("_k") * e))})
    g = 0.5772156649015329
    trials = trials.withColumn("_max", F.when(F.col("_sd") >= 1e-12, F.col("_sd") * ((1 - g) * F.col("_z1") + g * F.col("_z2"))))
    s = s.crossJoin(F.broadcast(trials))
    return s.select("strategy", "n", (F.col("sr") * sqrt(periods)).alias("sharpe"), (F.col("_max") * sqrt(periods)).alias("expected_max"), _psr(s, F.col("_max")).alias("_z")).withColumn("dsr", normal_cdf("_z")).drop("_z")


def lower_bounds(returns: np.ndarray, targets: list[float], n_boot: int, block: int, seed: tuple[int, ...], periods: int = 252) -> np.ndarray:
    """For each target the 2.5 % bound of the bootstrapped Sharpe ratio of one synthetic history.

    The history is a circular-block draw of the residuals, as long as the series, with the mean that gives
    the target; its bootstrap draws circular blocks of the history itself. A target only shifts the mean, so
    all targets share the draws. Not a number where the series is shorter than two blocks.
    """
    n = len(returns)
    if n < 2 * block:
        return np.full(len(targets), np.nan)
    rng = np.random.default_rng(seed)
    m, last = ceil(n / block), (n - 1) % block + 1
    sd = returns.std(ddof=1)
    at = (rng.integers(0, n, m)[:, None] + np.arange(block)).ravel()[:n] % n
    history = (returns - returns.mean())[at]
    around = np.concatenate([history, history[:block]])
    run = [np.concatenate([[0.0], np.cumsum(x)]) for x in (around, around * around)]
    starts = rng.integers(0, n, (n_boot, m))
    total, square = ((r[starts[:, :-1] + block] - r[starts[:, :-1]]).sum(axis=1) + r[starts[:, -1] + last] - r[starts[:, -1]] for r in run)
    mean = total / n
    var = (square - n * mean * mean) / (n - 1)
    own = np.sqrt(np.where(var > 1e-24, var, np.inf))
    return np.array([np.percentile((mean + t * sd / sqrt(periods)) / own, 2.5) for t in targets])


def power_curve(track: DataFrame, targets: list[float], n_sims: int = 200, n_boot: int = 500, block: int = 20, seed: int = 0) -> DataFrame:
    """strategy, target and power: the share of synthetic histories with that Sharpe ratio whose bootstrap
    interval lies above 0. A task works on some of the n_sims histories of a strategy (see lower_bounds)."""
    rows = numbered(track, ["net_return"])
    series = rows.groupBy("strategy").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "net_return"))), lambda x: x["net_return"]).alias("r"))  # a number for each session
    sims = track.sparkSession.range(0, n_sims, 1, min(n_sims, 64)).withColumnRenamed("id", "sim").crossJoin(F.broadcast(series.withColumn("key", F.xxhash64("strategy"))))
    goals = [float(t) for t in targets]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [lower_bounds(np.asarray(r, float), goals, n_boot, block, (seed, k % 2**64, sim)) for sim, r, k in zip(*(batch.column(c).to_pylist() for c in ("sim", "r", "key")), strict=True)]
            above = np.concatenate([np.zeros(0), *low]) > 0
            yield pa.RecordBatch.from_arrays([batch.column("strategy").take(pa.array(np.repeat(np.arange(batch.num_rows), len(goals)))), pa.array(np.tile(goals, batch.num_rows), pa.float64()), pa.array(above.astype(float))], ["strategy", "target", "above"])

    found = sims.mapInArrow(work, "strategy string, target double, above double")
    return found.groupBy("strategy", "target").agg(F.avg("above").alias("power"))


def least_detectable(curve: DataFrame, power: float = 0.8) -> DataFrame:
    """Target at which the curve first reaches the power, linear between its points; infinite if never."""
    w = Window.partitionBy("strategy").orderBy("target")
    rows = curve.withColumns({"_t": F.lag("target").over(w), "_p": F.lag("power").over(w)})
    at = F.when(F.col("_p").isNull() | (F.col("_p") >= power), F.col("target")).otherwise(F.col("_t") + (power - F.col("_p")) * F.try_divide(F.col("target") - F.col("_t"), F.col("power") - F.col("_p")))
    found = rows.where(F.col("power") >= power).groupBy("strategy").agg(F.min_by(at, "target").alias("least"))
    return curve.select("strategy").distinct().join(found, "strategy", "left").select("strategy", F.coalesce("least", F.lit(float("inf"))).alias("least_detectable"))


def analytic_error(years: Column) -> Column:
    return 1 / F.sqrt(years)


def blocks_of(n: int, block: int) -> int:
    return ceil(n / block)
