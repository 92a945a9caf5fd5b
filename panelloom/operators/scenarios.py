"""Stress scenarios: shocked tails of a panel, compared with an unshocked control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def base_window(bars: DataFrame, n: int = 480) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def shocked(bars: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Bars of every scenario (scenario, shocks array<double>), a table of a few rows: the base window, then
    business days on which the close compounds the shocks; volume is the mean of the last 20 days."""
    recent = Window.partitionBy("symbol").orderBy(F.desc("date"))
    last = bars.withColumn("_r", F.row_number().over(recent)).where("_r <= 20").groupBy("symbol").agg(F.max("date").alias("_last"), F.max_by("close", "date").alias("_close"), F.avg("volume").alias("volume"))
    steps = scenarios.select("scenario", "shocks", F.posexplode("shocks").alias("step", "shock"))
    tail = last.crossJoin(F.broadcast(steps))
    w = Window.partitionBy("scenario", "symbol").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    # The k-th business day after a date: whole weeks of five days, then the days left.
    shift = F.weekday("_last")
    start = F.when(shift >= 5, F.date_sub("_last", shift - 4)).otherwise(F.col("_last"))
    place = F.least(shift, F.lit(4)) + F.col("step") + 1
    day = F.date_add(start, (F.col("step") + 1 + 2 * F.floor(place / 5)).cast("int"))
    close = F.col("_close") * F.exp(F.sum(F.log1p("shock")).over(w))
    tail = tail.select("scenario", "symbol", day.alias("date"), close.alias("close"), "volume")
    tail = tail.select("scenario", "symbol", "date", F.col("close").alias("open"), (F.col("close") * 1.002).alias("high"), (F.col("close") * 0.998).alias("low"), "close", "volume")
    base = bars.crossJoin(F.broadcast(scenarios.select("scenario"))).select("scenario", "symbol", "date", "open", "high", "low", "close", "volume")
    return base.unionByName(tail)


def verdicts(decisions: DataFrame, control: str) -> DataFrame:
    """Flat share, mean size and mean confidence of each scenario, and their changes against the control."""
    s = decisions.groupBy("scenario").agg(F.avg((F.col("size") <= 0).cast("double")).alias("flat_share"), F.avg("size").alias("mean_size"), F.avg("confidence").alias("mean_confidence"))
    every = Window.partitionBy(F.lit(True))  # a row for each scenario
    change = lambda c: F.col(c) - F.max(F.when(F.col("scenario") == control, F.col(c))).over(every)
    names = {"flat_share": "flat_change", "mean_size": "size_change", "mean_confidence": "confidence_change"}
    known = F.max(F.col("scenario") == control).over(every)  # without the control there is nothing to compare with
    return s.withColumns({new: change(c) for c, new in names.items()} | {"_known": known}).where("_known").select("scenario", *names, *names.values())
