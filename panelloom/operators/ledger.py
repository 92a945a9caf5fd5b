"""Accounts: orders from targets, fills, average-cost positions and equity, keyed by account."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.costs import DELIVERY, cost
from panelloom.functions.folds import average_cost


def orders(targets: DataFrame, positions: DataFrame, quotes: DataFrame, cash: DataFrame, least: float = 100.0) -> DataFrame:
    """account, symbol, side, quantity and seq, sells first, of targets (account, symbol, weight), positions
    (account, symbol, quantity), quotes (symbol, price) and cash (account, cash)."""
    held = positions.join(quotes, "symbol").groupBy("account").agg(F.sum(F.col("quantity") * F.col("price")).alias("_v"))
    equity = cash.join(held, "account", "left").select("account", (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("equity"))
    every = targets.join(positions, ["account", "symbol"], "full_outer").join(quotes, "symbol").join(equity, "account")
    delta = F.coalesce("weight", F.lit(0.0)) * F.col("equity") - F.coalesce("quantity", F.lit(0.0)) * F.col("price")
    rows = every.withColumn("delta", delta).where(F.abs("delta") >= least)
    quantity = F.when(F.col("delta") < 0, F.least(-F.col("delta") / F.col("price"), F.coalesce("quantity", F.lit(0.0)))).otherwise(F.col("delta") / F.col("price"))
    w = Window.partitionBy("account").orderBy("delta", "symbol")
    return rows.select("account", "symbol", F.when(F.col("delta") < 0, "sell").otherwise("buy").alias("side"), quantity.alias("quantity"), F.row_number().over(w).alias("seq")).where("quantity > 0")


def priced(fills: DataFrame, slip_bps: float = 5.0, costs: dict[str, float] = DELIVERY) -> DataFrame:
    """Adds fill_price and cost; fills without a price or a positive quantity are not filled."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    rows = fills.where("price is not null and quantity > 0").withColumn("fill_price", F.col("price") * (1 + sign * slip_bps / 1e4))
    turnover = F.col("quantity") * F.col("fill_price")
    free = costs | {"slippage": 0.0}
    return rows.withColumn("cost", F.when(F.col("side") == "buy", cost(turnover, "buy", free)).otherwise(cost(turnover, "sell", free)))


_STATE = T.StructType([T.StructField("quantity_after", T.DoubleType()), T.StructField("average_cost", T.DoubleType()), T.StructField("realised", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def positions(fills: DataFrame) -> DataFrame:
    """Every fill with the position after it. A fold over the fills of one account and symbol in order."""
    schema = T.StructType(list(fills.schema.fields) + list(_STATE.fields))

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("trade_id")
        q = avg = 0.0
        out = []
        for side, n, price, fee in zip(*(group.column(c).to_pylist() for c in ("side", "quantity", "fill_price", "cost")), strict=True):
            q, avg, realised, rejected = average_cost(q, avg, side, n, price, fee)
            out.append((q, avg, realised, rejected))
        for i, f in enumerate(_STATE.fields):
            group = group.append_column(f.name, pa.array([r[i] for r in out], pa.bool_() if i == 3 else pa.float64()))
        return group

    return fills.groupBy("account", "symbol").applyInArrow(fold, schema)


def cash_flow(fills: DataFrame, initial: float = 1e6) -> DataFrame:
    """Cash of each account after each day, rejected fills aside: sums of a day, then a running sum."""
    value = F.col("quantity") * F.col("fill_price")
    flow = F.when(F.col("side") == "buy", -value - F.col("cost")).otherwise(value - F.col("cost"))
    days = fills.where(~F.col("rejected")).groupBy("account", "d").agg(F.sum(flow).alias("flow"), F.count("*").alias("n_fills"))
    w = Window.partitionBy("account").orderBy("d")
    return days.withColumn("cash", initial + F.sum("flow").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def marked_equity(fills: DataFrame, quotes: DataFrame, initial: float = 1e6) -> DataFrame:
    """account, date, cash, holdings and equity after each day with a fill or a quote of a held name.

    fills: as positions() leaves them. quotes: symbol, date, close. A name keeps its last quote until the
    next one. The value of a name changes on its own days only, so running sums of a day's changes give
    the account's holdings, and no grid of days and names is built.
    """
    held = fills.groupBy("account", "symbol", F.col("d").alias("date")).agg(F.max_by("quantity_after", "trade_id").alias("quantity"))
    # Quotes go to the accounts that ever hold the name.
    days = quotes.join(held.select("account", "symbol").distinct(), "symbol").select("account", "symbol", "date", "close")
    rows = held.join(days, ["account", "symbol", "date"], "full_outer")
    w = Window.partitionBy("account", "symbol").orderBy("date")
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    value = rows.withColumn("value", last("quantity") * last("close"))
    changes = value.withColumn("change", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
    moves = changes.groupBy("account", "date").agg(F.sum("change").alias("change"))
    flows = cash_flow(fills, initial).select("account", F.col("d").alias("date"), "flow")
    upto = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.join(flows, ["account", "date"], "left")
    out = out.withColumns({"cash": initial + F.coalesce(F.sum("flow").over(upto), F.lit(0.0)), "holdings": F.sum("change").over(upto)})
    return out.select("account", "date", "cash", "holdings", (F.col("cash") + F.col("holdings")).alias("equity"))


def snapshot(history: DataFrame, today: DataFrame) -> DataFrame:
    """History (account, date, equity) with today's rows in place of those of the same day, and returns."""
    rows = history.withColumn("_n", F.lit(0)).unionByName(today.withColumn("_n", F.lit(1)))
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("account", "date").orderBy(F.desc("_n")))).where("_r = 1").drop("_r", "_n")
    w = Window.partitionBy("account").orderBy("date")
    return latest.withColumn("daily_return", F.try_divide("equity", F.lag("equity").over(w)) - 1)


def overview(history: DataFrame, initial: float, periods: int = 252, least: int = 60) -> DataFrame:
    """Equity, total return, worst drawdown from the initial cash on, and the Sharpe ratio of 60 returns or more."""
    upto = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = history.withColumn("_dd", F.col("equity") / F.greatest(F.lit(initial), F.max("equity").over(upto)) - 1)
    rf = 1.06 ** (1 / periods) - 1
    out = rows.groupBy("account").agg(F.max_by("equity", "date").alias("equity"), F.min("_dd").alias("max_drawdown"), F.count("daily_return").alias("n_returns"), F.avg("daily_return").alias("_m"), F.stddev_samp("daily_return").alias("_s"))
    return out.select("account", "equity", (F.col("equity") / initial - 1).alias("total_return"), "max_drawdown", "n_returns", F.when((F.col("n_returns") >= least) & (F.col("_s") > 1e-12), F.try_divide(F.col("_m") - rf, F.col("_s")) * periods**0.5).alias("sharpe"))


def valued(open_positions: DataFrame, quotes: DataFrame) -> DataFrame:
    rows = open_positions.join(quotes, "symbol", "left")
    return rows.withColumns({"market_value": F.col("quantity") * F.col("price"), "unrealised_return": F.try_divide("price", "average_cost") - 1})


def latest(rows: DataFrame, as_of: str, columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Each symbol's last row on or before a day."""
    return rows.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("symbol").agg(F.max("date").alias("date"), *(F.max_by(c, "date").alias(c) for c in columns))


def top_of_latest_day(rows: DataFrame, by: str, k: int = 5) -> DataFrame:
    last = rows.agg(F.max("date").alias("date"))  # one row
    return rows.join(F.broadcast(last), "date").orderBy(F.desc(by), "symbol").limit(k)


def consistent(fills: DataFrame) -> DataFrame:
    """Rows (account, symbol) whose signed fills don't add up to the last position: none if all is well."""
    signed = F.when(F.col("rejected"), 0.0).when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    out = fills.groupBy("account", "symbol").agg(F.sum(signed).alias("moved"), F.max_by("quantity_after", "trade_id").alias("held"))
    return out.where(F.abs(F.col("moved") - F.col("held")) > 1e-6)
