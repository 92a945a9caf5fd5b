"""Data-quality audit of a bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import roll, symbol_rows


def _returns(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """r, explained (the market moved 5 % or more that day; unknown counts as not) and the prior deviation."""
    market = benchmark.select("date", (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("_b"))
    rows = bars.withColumn("r", F.try_divide("close", F.lag("close").over(symbol_rows())) - 1).join(market, "date", "left")
    return rows.withColumns({"explained": F.coalesce(F.abs("_b"), F.lit(0.0)) >= 0.05, "sd": roll(F.stddev_samp, "r", 60, symbol_rows(), least=20, lag=1)})


def corporate_actions(rows: DataFrame) -> DataFrame:
    return rows.where((F.abs("r") > 0.15) & ~F.col("explained")).select("symbol", "date", F.lit("corporate_action").alias("kind"))


def zero_volume(bars: DataFrame) -> DataFrame:
    return bars.where("volume <= 0").select("symbol", "date", F.lit("zero_volume").alias("kind"))


def missing_days(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions inside a symbol's own span without a row: the gap between two rows, as session numbers.

    Only gaps are expanded, so nothing is built that isn't a finding or a row of the panel.
    """
    numbered = sessions.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    rows = bars.select("symbol", "date").join(numbered, "date").withColumn("_next", F.lead("_i").over(symbol_rows()))
    gaps = rows.where("_next > _i + 1").select("symbol", F.explode(F.sequence(F.col("_i") + 1, F.col("_next") - 1)).alias("_i"))
    return gaps.join(numbered, "_i").select("symbol", "date", F.lit("missing_day").alias("kind"))


def stale_runs(bars: DataFrame, least: int = 5) -> DataFrame:
    """Runs of equal closes, reported at their last day."""
    before = F.lag("close").over(symbol_rows())
    same = F.abs(F.col("close") - before) <= 1e-8 + 1e-5 * F.abs(before)
    rows = bars.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(symbol_rows()))
    runs = rows.groupBy("symbol", "_run").agg(F.max("date").alias("date"), F.count("*").alias("_n"))
    return runs.where(F.col("_n") >= least).select("symbol", "date", F.lit("stale_run").alias("kind"))


def spikes(rows: DataFrame, z: float = 6.0) -> DataFrame:
    return rows.where((F.col("sd") > 1e-6) & (F.try_divide(F.abs("r"), F.col("sd")) > z) & ~F.col("explained") & (F.abs("r") <= 0.15)).select("symbol", "date", F.lit("outlier_spike").alias("kind"))


def audit(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """symbol, date and kind of every finding."""
    rows = _returns(bars, benchmark)
    out = corporate_actions(rows)
    for more in (zero_volume(bars), missing_days(bars, benchmark), stale_runs(bars), spikes(rows)):
        out = out.unionByName(more)
    return out


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


def freshness(bars: DataFrame, today: str, most_days: int = 4) -> DataFrame:
    age = F.datediff(F.lit(today).cast("date"), F.max("date")).cast("long")
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"), age.alias("age"), (age <= most_days).alias("fresh"))


def grid(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"))
    return out.withColumn("complete", F.col("n_rows") == F.col("n_dates") * F.col("n_symbols"))
