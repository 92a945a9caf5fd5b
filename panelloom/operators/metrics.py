"""Performance, risk attribution and classification metrics as grouped aggregates."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.distributions import normal_cdf, t_p_value


def _moments(x: Column) -> tuple[Column, Column]:
    return F.avg(x), F.stddev_samp(x)


def curve(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds equity (null returns count as 0) and drawdown from the highest equity so far, the first day's
    equity being the first peak."""
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(F.col(value), F.lit(0.0))
    lost = F.max((r <= -1).cast("int")).over(upto) == 1
    rows = rows.withColumn("equity", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(0.0))).over(upto))))
    return rows.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(upto)) - 1)


def performance(rows: DataFrame, value: str, keys: list[str], risk_free: float = 0.06, periods: int = 252, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each key, with further aggregates in `more`: return, risk, ratios, shape and extremes of the non-null returns."""
    rf = (1 + risk_free) ** (1 / periods) - 1
    extra = [c for c in ("exposure", "turnover") if c in rows.columns]
    rows = curve(rows.where(F.col(value).isNotNull()), value, keys)
    r = F.col(value)
    down = F.when(r < rf, r - rf)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max_by("equity", "date").alias("_end"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(down).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_won"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_lost"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("kurtosis"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
        *([F.avg("exposure").alias("avg_exposure")] if "exposure" in extra else []),
        *([F.sum("turnover").alias("_turnover")] if "turnover" in extra else []),
        *more,
    )
    years = F.col("n") / periods
    flat = F.col("_sd").isNull() | (F.col("_sd") < 1e-12)
    out = out.withColumns(
        {
            "total_return": F.col("_end") - 1,
            "cagr": F.when(F.col("_end") <= 0, -1.0).otherwise(F.pow("_end", 1 / years) - 1),
            "volatility": F.coalesce(F.col("_sd"), F.lit(0.0)) * sqrt(periods),
            "sharpe": F.when(flat, 0.0).otherwise((F.col("_mean") - rf) / F.when(~flat, F.col("_sd")) * sqrt(periods)),
            "sortino": F.when(F.col("_down").isNull() | (F.col("_down") < 1e-12), 0.0).otherwise((F.col("_mean") - rf) / F.when(F.col("_down") > 0, F.col("_down")) * sqrt(periods)),
            "profit_factor": F.when(F.col("_lost") > 0, F.try_divide("_won", "_lost")).otherwise(F.lit(float("inf"))),
            **({"turnover_per_year": F.col("_turnover") / years} if "turnover" in extra else {}),
        }
    )
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") >= -1e-9, 0.0).otherwise(F.try_divide("cagr", F.abs("max_drawdown"))))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def attribution(track: DataFrame, benchmarks: DataFrame, periods: int = 252, risk_free: float = 0.06, least: int = 30) -> DataFrame:
    """Beta, Treynor and information ratios, up and down capture of each strategy against each benchmark
    (name, date, ret), over the days that both have."""
    rf = (1 + risk_free) ** (1 / periods) - 1
    both = track.select("strategy", "date", F.col("net_return").alias("r")).join(benchmarks.select("name", "date", F.col("ret").alias("b")), "date").where("r is not null and b is not null")
    active = F.col("r") - F.col("b")
    out = both.groupBy("strategy", "name").agg(
        F.count("*").alias("n"), F.covar_samp("r", "b").alias("_c"), F.var_samp("b").alias("_v"), F.avg("r").alias("_r"), F.avg(active).alias("_a"), F.stddev_samp(active).alias("_te"),
        F.avg(F.when(F.col("b") > 0, F.col("r"))).alias("_ru"), F.avg(F.when(F.col("b") > 0, F.col("b"))).alias("_bu"), F.avg(F.when(F.col("b") < 0, F.col("r"))).alias("_rd"), F.avg(F.when(F.col("b") < 0, F.col("b"))).alias("_bd"),
    ).where(F.col("n") >= least)
    beta = F.when(F.col("_v") >= 1e-16, F.try_divide("_c", "_v"))
    out = out.withColumn("beta", beta)
    quiet = F.col("_te") < 1e-12
    return out.select(
        "strategy", "name", "n", "beta",
        F.when(F.abs("beta") >= 1e-8, F.try_divide((F.col("_r") - rf) * periods, F.col("beta"))).alias("treynor"),
        F.when(quiet & (F.abs("_a") < 1e-12), 0.0).when(~quiet, F.try_divide("_a", "_te") * sqrt(periods)).alias("information_ratio"),
        F.try_divide("_ru", "_bu").alias("up_capture"), F.try_divide("_rd", "_bd").alias("down_capture"),
    )


def running_counts(rows: DataFrame, value: str, keys: list[str], parts: int = 64, n: Column | None = None) -> DataFrame:
    """keys, value, _n (rows with the value), _upto (rows with at most it) and _all (the key's rows); n: an aggregate that
    counts rows, where a row stands for several.

    One key may hold most rows, so its distinct values are cut at approximate quantiles: a window counts
    within each of the `parts` ranges, and another adds what the lower ranges hold. Equal values are one
    row and so never part. The counts don't depend on where the cuts fall.
    """
    counts = rows.groupBy(*keys, value).agg((F.count("*") if n is None else n).alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    lower = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))  # at most `parts` rows for each key
    ordered, every = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys)
    lower = lower.select(*keys, "_part", (F.sum("_s").over(ordered) - F.col("_s")).alias("_below"), F.sum("_s").over(every).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    return placed.withColumn("_inside", inside).join(lower, [*keys, "_part"]).select(*keys, value, "_n", (F.col("_inside") + F.col("_below")).alias("_upto"), "_all")


def average_ranks(rows: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Ranks from 1, ties averaged, from the counts of the distinct values."""
    ranks = running_counts(rows, value, keys).select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return rows.join(ranks, [*keys, value])


def classification(rows: DataFrame, keys: list[str], prob: str = "prob_up", label: str = "y") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, MCC and AUC of each key."""
    rows = average_ranks(rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull()), prob, "_rank", keys)
    said, true = F.col(prob) > 0.5, F.col(label) == 1
    count = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"), count(~said & ~true).alias("tn"), F.sum(F.when(true, F.col("_rank")).otherwise(0.0)).alias("_ranks"))
    p, m = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    root = F.sqrt((F.col("tp") + F.col("fp")).cast("double") * p * m * (F.col("tn") + F.col("fn")))
    return out.withColumns(
        {
            "accuracy": (F.col("tp") + F.col("tn")) / F.col("n"),
            "precision": zero(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": zero(F.col("tp"), p),
            "f1": zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
            "mcc": zero(F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn"), root),
            "auc": F.when((p == 0) | (m == 0), 0.5).otherwise(F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p.cast("double") * m)),
        }
    ).drop("_ranks")


def architecture_summary(runs: DataFrame) -> DataFrame:
    """Mean and deviation of the accuracy over an architecture's runs (run: <architecture>_seed<k>), z against
    one half with the n of the first run, and the two-sided normal p value."""
    rows = runs.withColumns({"architecture": F.regexp_extract("run", r"^(.*)_seed\d+$", 1), "_seed": F.regexp_extract("run", r"_seed(\d+)$", 1).cast("int")})
    out = rows.groupBy("architecture").agg(F.count("*").alias("n_runs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy"), F.min_by("n", "_seed").alias("_n"))
    out = out.withColumn("z", (F.col("mean_accuracy") - 0.5) / F.sqrt(0.25 / F.col("_n"))).drop("_n")
    return out.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z"))))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa (1 if chance agreement is 1)."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    margins_a, margins_b = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("na")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    chance = margins_a.join(margins_b, "v", "left").agg(F.sum(F.col("na").cast("double") * F.coalesce("nb", F.lit(0))).alias("s"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("s") / F.col("n") / F.col("n")
    return both.select("n", po.alias("agreement"), F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def _at(matrix: Column, k: int, i: int | Column, j: int | Column) -> Column:
    """The element of a k x k matrix that is an array, row after row."""
    at = (F.lit(i) if isinstance(i, int) else i) * k + (F.lit(j) if isinstance(j, int) else j)
    return F.get(matrix, at)


def cholesky(matrix: Column, k: int) -> Column:
    """The lower factor of a symmetric k x k matrix in an array, row after row; null elements where it isn't
    positive definite to twelve places of a diagonal element."""

    def element(done: Column, at: Column) -> Column:
        i, j = F.floor(at / k).cast("int"), F.pmod(at, F.lit(k)).cast("int")
        known = F.aggregate(F.when(j > 0, F.sequence(F.lit(0), j - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, m: s + _at(done, k, i, m) * _at(done, k, j, m))
        left = _at(matrix, k, i, j) - known
        diagonal = F.when(left > 1e-12 * _at(matrix, k, i, i), F.sqrt(left))
        return F.when(j > i, F.lit(0.0)).when(i == j, diagonal).otherwise(F.try_divide(left, _at(done, k, j, j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k * k - 1)), F.array().cast("array<double>"), lambda done, at: F.concat(done, F.array(element(done, at))))


def solved(lower: Column, k: int, right: Column) -> Column:
    """x of A x = right, from A's lower Cholesky factor: forwards, then backwards."""
    steps = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    down = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.array().cast("array<double>"),
        lambda z, i: F.concat(z, F.array(F.try_divide(F.get(right, i) - F.aggregate(steps(F.lit(0), i - 1), F.lit(0.0), lambda s, j: s + _at(lower, k, i, j) * F.get(z, j)), _at(lower, k, i, i)))),
    )
    # x is made from its end, so x_j stands at k - 1 - j from the front of what is made, which is put in front.
    return F.aggregate(
        F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)),
        F.array().cast("array<double>"),
        lambda x, i: F.concat(F.array(F.try_divide(F.get(down, i) - F.aggregate(steps(i + 1, F.lit(k - 1)), F.lit(0.0), lambda s, j: s + _at(lower, k, j, i) * F.get(x, j - i - 1)), _at(lower, k, i, i))), x),
    )


def factor_regression(rows: DataFrame, y: str, factors: list[str], keys: list[str], periods: int = 252) -> DataFrame:
    """OLS of y on an intercept and any number of factors for each key, sorted by falling alpha: n, alpha (a year's),
    alpha_t, alpha_p, and beta, t and p of each factor (<factor>_beta, <factor>_t, <factor>_p), r2.

    The normal equations are aggregates around the means; a Cholesky factor in array columns solves them. p values
    are two-sided of the t distribution with n - k - 1 degrees of freedom. A key with no more days that
    have all values than coefficients is an error; collinear factors give nulls.
    """
    k = len(factors)
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in (y, *factors)))
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("_my"), F.covar_pop(y, y).alias("_yy"), F.array(*(F.avg(f) for f in factors)).alias("_m"),
        F.array(*(F.covar_pop(y, f) for f in factors)).alias("_xy"), F.array(*(F.covar_pop(f, g) for f in factors for g in factors)).alias("_xx"),
    )
    enough = F.col("n") >= k + 2
    s = s.withColumn("n", F.when(enough, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("too few days for a factor regression: "), F.col("n").cast("string"))).cast("long")))
    s = s.withColumn("_l", cholesky(F.col("_xx"), k))
    s = s.withColumn("_b", solved(F.col("_l"), k, F.col("_xy")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda t, x: t + x)
    unit = lambda i: F.array(*(F.lit(1.0 if j == i else 0.0) for j in range(k)))
    s = s.withColumns({"_a": F.col("_my") - dot("_b", "_m"), "_left": F.greatest(F.col("_yy") - dot("_b", "_xy"), F.lit(0.0)), "_lm": solved(F.col("_l"), k, F.col("_m"))} | {f"_i{i}": F.get(solved(F.col("_l"), k, unit(i)), F.lit(i)) for i in range(k)})
    freedom = F.col("n") - k - 1
    per = F.col("_left") * F.col("n") / freedom / F.col("n")  # residual variance over n
    t_of = lambda x, variance: F.try_divide(x, F.sqrt(variance))
    out = s.withColumns({"alpha": F.pow(1 + F.col("_a"), periods) - 1, "r2": 1 - F.try_divide("_left", "_yy"), "alpha_t": t_of(F.col("_a"), per * (1 + dot("_m", "_lm")))} | {f"{f}_beta": F.get("_b", F.lit(i)) for i, f in enumerate(factors)} | {f"{f}_t": t_of(F.get("_b", F.lit(i)), per * F.col(f"_i{i}")) for i, f in enumerate(factors)})
    out = out.withColumns({f"{c}_p": t_p_value(F.col(f"{c}_t"), freedom) for c in ("alpha", *factors)})
    return out.select(*keys, "n", "alpha", "alpha_t", "alpha_p", *(f"{f}_{x}" for f in factors for x in ("beta", "t", "p")), "r2").orderBy(F.desc("alpha"), *keys)
