"""Scored headlines: daily views, debiasing, event studies and agreement between scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import by, roll, symbol_rows
from panelloom.operators.metrics import average_ranks, running_counts


def daily(rows: DataFrame, least: int = 1) -> DataFrame:
    """sentiment, n_headlines, dispersion (0 for one headline) and unknown_share of each symbol and date."""
    out = rows.groupBy("symbol", "date").agg(F.avg("score").alias("sentiment"), F.count("score").alias("n_headlines"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("dispersion"), F.avg("p_unknown").alias("unknown_share"))
    return out.where(F.col("n_headlines") >= least)


def with_earnings(rows: DataFrame, pattern: str, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """earnings: whether any of the key's titles is about results."""
    return rows.groupBy(*keys).agg(F.bool_or(is_earnings(F.col("title"), pattern)).alias("earnings"))


def debias_cross_section(views: DataFrame) -> DataFrame:
    return views.withColumn("sentiment", F.col("sentiment") - F.avg("sentiment").over(Window.partitionBy("date")))


def debias_trailing(views: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """Minus the mean of the symbol's prior n views; with fewer than `least` of them, minus the mean of all
    symbols' views of strictly earlier dates, or nothing on the first date.

    The market's running mean is made of one sum a date, so no window goes over all rows.
    """
    days = views.groupBy("date").agg(F.sum("sentiment").alias("_s"), F.count("sentiment").alias("_n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each date
    market = days.select("date", F.try_divide(F.sum("_s").over(before), F.sum("_n").over(before)).alias("_market"))
    rows = views.withColumn("_own", roll(F.avg, "sentiment", n, symbol_rows(), least=least, lag=1)).join(market, "date")
    return rows.withColumn("sentiment", F.col("sentiment") - F.coalesce("_own", "_market", F.lit(0.0))).drop("_own", "_market")


def debias_both(views: DataFrame) -> DataFrame:
    return debias_cross_section(debias_trailing(views))


def is_earnings(title: Column, pattern: str) -> Column:
    return F.coalesce(title.rlike(f"(?i){pattern}"), F.lit(False))


def event_regression(rows: DataFrame, keys: list[str], signal: str = "sentiment", ret: str = "fwd_ret") -> DataFrame:
    """OLS of the return on the signal for each key: n, slope, stderr, t, R squared and mean return."""
    rows = rows.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(ret, signal).alias("slope"), F.regr_sxx(ret, signal).alias("_xx"), F.regr_syy(ret, signal).alias("_yy"), F.regr_sxy(ret, signal).alias("_xy"), F.avg(ret).alias("mean_ret"))
    left = F.col("_yy") - F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx"))
    s = s.withColumns({"stderr": F.when(F.col("n") > 2, F.sqrt(F.try_divide(left / (F.col("n") - 2), F.col("_xx")))), "r2": F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy"))})
    return s.withColumn("t", F.try_divide("slope", "stderr")).drop("_xx", "_yy", "_xy")


def terciles(rows: DataFrame, keys: list[str], signal: str = "sentiment", ties: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """bucket neg, neu or pos by the signal's place among the key's rows, ties by the given columns.

    The place comes from counts of the distinct signal values and a number among equal ones.
    """
    rows = rows.where(F.col(signal).isNotNull())
    counts = running_counts(rows, signal, keys).select(*keys, signal, (F.col("_upto") - F.col("_n")).alias("_upto"), F.col("_all").alias("_n"))
    same = Window.partitionBy(*keys, signal).orderBy(*ties)
    out = rows.join(counts, [*keys, signal]).withColumn("_r", F.col("_upto") + F.row_number().over(same) - 1)
    bucket = F.when(3 * F.col("_r") < F.col("_n") - 1, "neg").when(3 * F.col("_r") < 2 * (F.col("_n") - 1), "neu").otherwise("pos")
    return out.withColumn("bucket", bucket).drop("_upto", "_n", "_r")


def bucket_table(rows: DataFrame, keys: list[str], ret: str = "fwd_ret") -> DataFrame:
    return rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), (F.avg(ret) * 1e4).alias("mean_bps"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"))


def welch(rows: DataFrame, keys: list[str], value: str, is_a: Column, is_b: Column) -> DataFrame:
    """Difference of two groups' means with Welch's t and degrees of freedom."""
    a, b = F.when(is_a, F.col(value)), F.when(is_b, F.col(value))
    s = rows.groupBy(*keys).agg(*(f(x).alias(f"_{n}{g}") for g, x in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    ea, eb = F.try_divide("_va", "_na"), F.try_divide("_vb", "_nb")
    df = F.try_divide((ea + eb) * (ea + eb), ea * ea / F.when(F.col("_na") > 1, F.col("_na") - 1) + eb * eb / F.when(F.col("_nb") > 1, F.col("_nb") - 1))
    return s.select(*keys, F.col("_na").alias("n_a"), F.col("_nb").alias("n_b"), (F.col("_ma") - F.col("_mb")).alias("difference"), F.try_divide(F.col("_ma") - F.col("_mb"), F.sqrt(ea + eb)).alias("t"), df.alias("df"))


def predictability(rows: DataFrame, keys: list[str], signal: str = "sentiment", ret: str = "fwd_ret", least: int = 30) -> DataFrame:
    """n, Spearman's rank correlation and the sign hit rate where the signal isn't 0; only n under `least`."""
    rows = rows.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    ranked = average_ranks(average_ranks(rows, signal, "_rs", keys), ret, "_rr", keys)
    hit = F.avg(F.when(F.col(signal) != 0, (F.signum(signal) == F.signum(ret)).cast("double")))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rs", "_rr").alias("ic"), hit.alias("hit_rate"))
    known = F.col("n") >= least
    return out.select(*keys, "n", F.when(known, F.col("ic")).alias("ic"), F.when(known, F.col("hit_rate")).alias("hit_rate"))


def subsets(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each subset that a row belongs to."""
    return rows.withColumn("subset", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())))


def label_statistics(rows: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Mean probability and argmax share (the first of equal ones) of each label, and good over bad."""
    best = F.array(*labels)
    at = F.array_position(best, F.array_max(best))
    means = [F.avg(c).alias(f"mean_{c}") for c in labels]
    shares = [F.avg((at == i + 1).cast("double")).alias(f"share_{c}") for i, c in enumerate(labels)]
    return rows.groupBy(*keys).agg(*means, *shares).withColumn("good_bad", F.try_divide(f"share_{labels[0]}", f"share_{labels[1]}"))


def histogram(rows: DataFrame, column: str = "sentiment") -> DataFrame:
    """Counts of five buckets, empty ones too; each holds its upper edge, the first its lower one as well."""
    names = ["very_negative", "negative", "neutral", "positive", "very_positive"]
    x = F.col(column)
    bucket = F.when((x < -1) | (x > 1), None).when(x <= -0.3, names[0]).when(x <= -0.05, names[1]).when(x <= 0.05, names[2]).when(x <= 0.3, names[3]).when(x <= 1, names[4])
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ensemble(rows: DataFrame, item: list[str], label: str = "label", provider: str = "provider", p: str = "p") -> DataFrame:
    """Mean distribution of each item over providers without a null, with their pairwise agreement.

    agreement: mean over pairs of 1 - half the absolute differences; 1 with one provider. The sum of the
    absolute differences of all pairs comes from the sorted values of a label, so no pairs are built.
    confidence: 0.3 + 0.7 agreement. A provider with a null has failed for the item and doesn't count; an item for
    which all have failed is an error, not a distribution of little confidence.
    """
    each = rows.groupBy(*item, provider).agg(F.count_if(F.col(p).isNull()).alias("_bad"))
    left = F.count_if(F.col("_bad") == 0).over(Window.partitionBy(*item))
    none = F.raise_error(F.concat(F.lit("every provider failed for "), F.to_json(F.struct(*item)))).cast("boolean")
    ok = each.withColumn("_left", left).where(F.when(F.col("_left") == 0, none).otherwise(F.col("_bad") == 0)).drop("_bad", "_left")
    rows = rows.join(ok, [*item, provider], "left_semi")
    sorted_p = F.sort_array(F.collect_list(p))  # as many values as providers
    per = rows.groupBy(*item, label).agg(F.avg(p).alias("p"), F.count("*").alias("_k"), sorted_p.alias("_ps"))
    gaps = F.aggregate(F.transform("_ps", lambda x, i: x * (2 * i - F.col("_k") + 1)), F.lit(0.0), lambda a, x: a + x)
    per = per.withColumn("_gap", gaps)
    total = per.groupBy(*item).agg(F.sum("_gap").alias("_g"), F.max("_k").alias("n_providers"))
    pairs = F.col("n_providers") * (F.col("n_providers") - 1) / 2
    agreement = F.when(F.col("n_providers") < 2, 1.0).otherwise(1 - F.try_divide(F.col("_g") / 2, pairs))
    total = total.withColumn("agreement", agreement).withColumn("confidence", 0.3 + 0.7 * F.least(F.greatest("agreement", F.lit(0.0)), F.lit(1.0)))
    return per.select(*item, label, "p").join(total.drop("_g"), item)
