"""Baseline signals as rows of a strategy column, controls, benchmarks and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import symbol_rows


def rules() -> dict[str, Column]:
    """Signal of each rule; a comparison with a null is 0. Needs macd_hist, stoch_k, rsi_14 and ret_1d."""
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "BuyHold": F.lit(1.0),
        "MACD": on(F.col("macd_hist") > 0),
        "KDJ_RSI": on((F.col("stoch_k") < 0.25) & (F.col("rsi_14") < 0.45)),
        "MeanReversion": on(F.col("ret_1d") < 0),
        "RSI": rsi_latch(),
    }


def rsi_latch(low: float = 0.3, high: float = 0.7) -> Column:
    """1 from below low until above high: the last crossing decides; 0 before any and where rsi is null."""
    crossing = F.when(F.col("rsi_14") < low, 1.0).when(F.col("rsi_14") > high, 0.0)
    held = F.last(crossing, ignorenulls=True).over(symbol_rows().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("rsi_14").isNotNull(), F.coalesce(held, F.lit(0.0))).otherwise(0.0)


def signals(rows: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """strategy, date, symbol, score, fwd_ret: one row for each rule, in one pass over the rows."""
    wide = rows.withColumns({f"_s_{k}": v for k, v in chosen.items()})
    pairs = F.array(*(F.struct(F.lit(k).alias("strategy"), F.col(f"_s_{k}").alias("score")) for k in chosen))
    return wide.select("date", "symbol", "fwd_ret", F.explode(pairs).alias("s")).select("s.strategy", "date", "symbol", "s.score", "fwd_ret")


def random_control(rows: DataFrame, reference: str, seed: int = 0, name: str = "Random") -> DataFrame:
    """Each day as many names as the reference strategy selects, the first in the order of a seeded hash."""
    own = rows.where(F.col("strategy") == reference)
    day = Window.partitionBy("date")
    order = Window.partitionBy("date").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string"), "symbol")), "symbol")
    return own.withColumns({"_k": F.sum((F.col("score") > 0).cast("int")).over(day), "_r": F.row_number().over(order)}).select(F.lit(name).alias("strategy"), "date", "symbol", F.when(F.col("_r") <= F.col("_k"), 1.0).otherwise(0.0).alias("score"), "fwd_ret")


def equal_weight(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.avg("fwd_ret").alias("ret"))


def align_benchmark(dates: DataFrame, benchmark: DataFrame) -> DataFrame:
    """date, ret and has_bench for each of the given dates, once: a date that the benchmark lacks has 0.0, and has_bench
    tells it from a return of 0, so that measures of joint days can leave it out."""
    own = benchmark.where("ret is not null").groupBy("date").agg(F.max("ret").alias("ret"))
    rows = dates.select("date").distinct().join(own, "date", "left")
    return rows.select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.col("ret").isNotNull().alias("has_bench"))


def winners_minus_losers(rows: DataFrame, by_column: str = "mom_12_1", k: int = 3) -> DataFrame:
    """Each day with 2k valid rows: mean return of the k best minus that of the k worst."""
    valid = rows.where(F.col(by_column).isNotNull() & F.col("fwd_ret").isNotNull())
    best, worst = (Window.partitionBy("date").orderBy(o, "symbol") for o in (F.desc(by_column), F.asc(by_column)))
    ranked = valid.withColumns({"_b": F.row_number().over(best), "_w": F.row_number().over(worst), "_n": F.count("*").over(Window.partitionBy("date"))})
    return ranked.where(F.col("_n") >= 2 * k).groupBy("date").agg((F.avg(F.when(F.col("_b") <= k, F.col("fwd_ret"))) - F.avg(F.when(F.col("_w") <= k, F.col("fwd_ret")))).alias("wml"))
