"""Risk sizing, circuit breakers, and the sequential decision pass of each account."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.folds import CAP, Account
from panelloom.functions.tables import written
from panelloom.functions.windows import by, symbol_rows
from panelloom.operators.features import causal_atr


BASE, TARGET_VOL = 0.20, 0.20


def breaker(bars: DataFrame, gap: float = -0.03, ranges: float = 2.5) -> DataFrame:
    """symbol, date and trigger: a gap down first, else a range over so many prior average true ranges."""
    return with_trigger(bars, gap, ranges).select("symbol", "date", "trigger").where("trigger is not null")


def with_trigger(bars: DataFrame, gap: float = -0.03, ranges: float = 2.5) -> DataFrame:
    """bars with the breaker's trigger, null where there is none."""
    rows = causal_atr(bars).withColumn("_gap", F.try_divide("open", F.lag("close").over(symbol_rows())) - 1)
    trigger = F.when(F.col("_gap") <= gap, "gap_down").when(F.col("high") - F.col("low") > ranges * F.col("atr_prior"), "range")
    return rows.withColumn("trigger", trigger).drop("_gap", "atr_prior")


def base_size(round_trip_bps: float = 0.0, margin_bps: float = 0.0) -> Column:
    """Size of a name before the drawdown rule; 0 for no score, little confidence, a breaker or thin edge."""
    scale = F.when(F.col("vol_20") > 1e-6, F.least(F.greatest(TARGET_VOL / F.col("vol_20"), F.lit(0.25)), F.lit(1.5))).otherwise(1.0)
    edge = F.col("score") * F.col("confidence") * F.col("vol_20") / F.sqrt(F.lit(252.0)) * 1e4
    thin = F.lit(False) if round_trip_bps + margin_bps <= 0 else F.coalesce(edge < round_trip_bps + margin_bps, F.lit(False))
    stop = F.col("trigger").isNotNull() | (F.col("score") <= 0) | (F.col("confidence") < 0.10) | thin
    return F.when(F.coalesce(stop, F.lit(True)), 0.0).otherwise(F.least(BASE * scale, F.lit(CAP)))


def capped(rows: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """Scales each day's sizes by 1 / their sum where that is over 1."""
    total = F.sum(size).over(Window.partitionBy(*keys))
    return rows.withColumn(size, F.when(total > 1, F.try_divide(F.col(size), total)).otherwise(F.col(size)))


_DOUBLES = ("weight", "equity", "peak", "drawdown_before")
_DAYS = T.StructType([T.StructField("account", T.StringType()), T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in _DOUBLES)])
STATE = "account string, equity double, peak double, held array<struct<symbol:string,weight:double>>"


def _days_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each account and day, of batches sorted by both."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("account", "date")]
        ends = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        for lo, hi in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            key = batch.column("account")[lo].as_py(), batch.column("date")[lo].as_py()
            if key != now and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            now = key
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _once(day: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, sizes and returns of a day; of rows that stand twice the last size and the last known return count."""
    names, sizes, returns = (day.column(c).combine_chunks() for c in ("symbol", "size", "fwd_ret"))
    if sizes.null_count:
        raise ValueError("a size is null")
    sizes, returns = sizes.to_numpy(), returns.to_numpy(zero_copy_only=False).astype(float)
    code = names.dictionary_encode().indices.to_numpy()
    if (code[1:] == code[:-1]).any():
        size = dict(zip(names.to_pylist(), sizes.tolist(), strict=True))
        known = {s: r for s, r in zip(names.to_pylist(), returns.tolist(), strict=True) if r == r}
        names, sizes, returns = pa.array(size, names.type), np.array(list(size.values())), np.array([known.get(s, np.nan) for s in size])
    return names, sizes, returns


def decide_block(rows: DataFrame, state: DataFrame, risk_free: float = 0.06) -> DataFrame:
    """One stretch of the calendar: rows (account, band, date, symbol, size, fwd_ret), from what each account was
    before it (STATE; an account without a state starts with equity 1 and nothing held).

    Spark sorts an account's rows by day, with its state in front of them; they stream through a task, which holds the names of
    one day and the book of the day before.
    """
    rf, null = (1 + risk_free) ** (1 / 252) - 1, F.lit(None)
    before = state.select("account", null.cast("double").alias("band"), null.cast("date").alias("date"), "equity", "peak", F.explode_outer("held").alias("h")).select("account", "band", "date", "h.symbol", F.col("h.weight").alias("size"), null.cast("double").alias("fwd_ret"), "equity", "peak")
    both = rows.select("account", "band", "date", "symbol", "size", "fwd_ret", null.cast("double").alias("equity"), null.cast("double").alias("peak")).unionByName(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, account, made, n = None, Account(rf), [], 0
        for day in _days_of(batches):
            own, date = day.column("account")[0].as_py(), day.column("date")[0].as_py()
            if own != name:
                name, account = own, Account(rf)
            if date is None:
                held = day.filter(day.column("symbol").is_valid())
                account = Account(rf, day.column("equity")[0].as_py(), day.column("peak")[0].as_py(), held.column("symbol").combine_chunks(), held.column("size").to_numpy())
                continue
            names, sizes, returns = _once(day)
            drawdown = account.day(names, sizes, returns, pc.max(day.column("band")).as_py())
            same = lambda v, kind, k=len(names): pa.array([v], kind).take(pa.array(np.zeros(k, np.int32)))
            made.append(pa.RecordBatch.from_arrays([same(own, pa.string()), same(date, pa.date32()), names, pa.array(account.weights), *(same(x, pa.float64()) for x in (account.equity, account.peak, drawdown))], _DAYS.names))
            n += len(names)
            if n >= 10_000:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, n = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return both.repartition("account").sortWithinPartitions("account", "date", "symbol", "size", "fwd_ret").mapInArrow(run, _DAYS)


def state_after(made: DataFrame, before: DataFrame) -> DataFrame:
    """STATE behind the last day of each account; accounts without a day keep theirs."""
    last = F.broadcast(made.groupBy("account").agg(F.max("date").alias("date")))  # a row for each account
    end = made.join(last, ["account", "date"]).groupBy("account").agg(F.first("equity").alias("equity"), F.first("peak").alias("peak"), F.sort_array(F.collect_list(F.struct("symbol", "weight"))).alias("held"))
    return end.unionByName(before.join(end.select("account"), "account", "left_anti"))


def stretches(months: list[tuple[dt.date, int]], most: int) -> list[tuple[dt.date, dt.date]]:
    """The first and last month of runs of months, each of at most `most` rows or one month. months: each with its rows."""
    out, n = [], 0
    for month, rows in sorted(months):
        if out and n + rows <= most:
            out[-1], n = (out[-1][0], month), n + rows
        else:
            out.append((month, month))
            n = rows
    return out


def decide(rows: DataFrame, band: float | None = None, risk_free: float = 0.06, state: DataFrame | None = None, most: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """The days (account, date, symbol, weight, equity, peak, drawdown_before) and the state after them, of rows
    (account, date, symbol, size, fwd_ret, and band where none is given for all).

    The only step whose days depend on each other. Accounts, strategies and settings run in parallel; stretches of the calendar
    (whole months, at most `most` rows of an account unless a month has more) run one after the other, and the state after one is
    written and handed to the next. So a task sorts a stretch of an account and holds a day of it, a lost one repeats a
    stretch, and a later call goes on from the state that this one returns.
    Two rows of an account, day and symbol are an error of the caller's: the later one in order of size counts.
    """
    spark = rows.sparkSession
    rows = written((rows if band is None else rows.withColumn("band", F.lit(float(band)))).withColumn("month", F.trunc("date", "month")), "sized", ("month",))
    now = spark.createDataFrame([], STATE) if state is None else state
    counts = rows.groupBy("month", "account").agg(F.count("*").alias("n")).groupBy("month").agg(F.max("n").alias("n"))
    out = spark.createDataFrame([], _DAYS)
    for lo, hi in stretches([(r["month"], r["n"]) for r in counts.collect()], most):  # one row a month
        made = written(decide_block(rows.where(F.col("month").between(lo, hi)), now, risk_free), "days")
        now = written(state_after(made, now), "state")
        out = out.unionByName(made)
    return out, now


def demoted(rows: DataFrame) -> DataFrame:
    """Notes of the cap, and BUY without a size becomes HOLD."""
    noted = F.when(F.col("size") < F.col("size_before"), F.array_union("risk_notes", F.array(F.lit("scaled to the gross cap")))).otherwise(F.col("risk_notes"))
    return rows.withColumns({"risk_notes": noted, "action": F.when((F.col("action") == "BUY") & (F.col("size") <= 0), "HOLD").otherwise(F.col("action"))})
