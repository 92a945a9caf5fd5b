"""Annual statements as point-in-time panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelloom.functions.windows import as_of_backward, clip


def symbol_rows() -> WindowSpec:
    """A symbol's rows in order; made when it is needed, as a window needs a session."""
    return Window.partitionBy("symbol").orderBy("available_from")


def period_end(label: Column) -> tuple[Column, Column]:
    """(month end, months) of labels like 'Mar 2019' or 'Mar 2016 9m'; nulls for anything else."""
    shape = r"^\s*([A-Z][a-z]{2}) (\d{4})(?: (\d+)m)?\s*$"
    end = F.last_day(F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), F.regexp_extract(label, shape, 1), F.regexp_extract(label, shape, 2)), F.lit("d MMM yyyy"))))
    months = F.when(end.isNotNull(), F.coalesce(F.regexp_extract(label, shape, 3).try_cast("int"), F.lit(12)))
    return end, months


def available(statements: DataFrame, lag_days: int = 61) -> DataFrame:
    """Adds period_end, months and available_from; labels that aren't periods go."""
    end, months = period_end(F.col("fiscal"))
    rows = statements.withColumns({"period_end": end, "months": months}).where("period_end is not null")
    return rows.withColumn("available_from", F.date_add("period_end", lag_days))


def from_long(rows: DataFrame) -> DataFrame:
    """symbol, fiscal, revenue (Sales, else Revenue), net_profit and equity (only with both parts) from long
    rows (symbol, fiscal, label, value)."""
    of = lambda *names: F.max(F.when(F.lower("label").isin(*(n.lower() for n in names)), F.col("value")))
    wide = rows.groupBy("symbol", "fiscal").agg(of("Sales").alias("_s"), of("Revenue").alias("_r"), of("Net Profit").alias("net_profit"), of("Equity Capital").alias("_c"), of("Reserves").alias("_v"))
    return wide.select("symbol", "fiscal", F.coalesce("_s", "_r").alias("revenue"), "net_profit", (F.col("_c") + F.col("_v")).alias("equity"))


def _growth(column: str) -> Column:
    """Growth on a positive base, between two periods of twelve months."""
    before = F.lag(column).over(symbol_rows())
    whole = (F.col("months") == 12) & (F.lag("months").over(symbol_rows()) == 12) & (before > 1e-9)
    return clip(F.when(whole, F.try_divide(F.col(column) - before, F.abs(before))), -1, 2)


def features(statements: DataFrame) -> DataFrame:
    """revenue_growth, profit_growth, roe and roe_change of each available statement."""
    rows = available(statements)
    average = (F.col("equity") + F.coalesce(F.lag("equity").over(symbol_rows()), F.col("equity"))) / 2
    roe = clip(F.when(average > 0, F.try_divide(F.col("net_profit") * 12 / F.col("months"), average)), -0.5, 0.6)
    rows = rows.withColumns({"revenue_growth": _growth("revenue"), "profit_growth": _growth("net_profit"), "roe": roe})
    whole = (F.col("months") == 12) & (F.lag("months").over(symbol_rows()) == 12)
    return rows.withColumn("roe_change", F.when(whole, F.col("roe") - F.lag("roe").over(symbol_rows())))


METRICS = ("revenue_growth", "profit_growth", "roe", "roe_change")


def point_in_time(days: DataFrame, statements: DataFrame) -> DataFrame:
    """Each day's latest available statement of its symbol, and its features' cross-sectional z scores."""
    rows = as_of_backward(days, features(statements).select("symbol", "available_from", "fiscal", *METRICS), ["symbol"], "date", "available_from")
    return z_scores(rows)


def z_scores(rows: DataFrame, limit: float = 3.0) -> DataFrame:
    """z_<metric> per date; null where the deviation is at most 1e-9."""
    day = Window.partitionBy("date")
    std = {m: F.stddev_samp(m).over(day) for m in METRICS}
    return rows.withColumns({f"z_{m}": clip(F.when(std[m] > 1e-9, F.try_divide(F.col(m) - F.avg(m).over(day), std[m])), -limit, limit) for m in METRICS})
