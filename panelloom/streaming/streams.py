"""Stream forms of the panel operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelloom.functions.folds import drawdown_factor, fold_days
from panelloom.operators.news import actionable_date


def bars(ticks: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Open, high, low, close and volume of each symbol and window of ticks (ts, symbol, price, quantity, seq)."""
    at = F.struct("ts", "seq")
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = ticks.withWatermark("ts", late).groupBy(window.alias("w"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", "open", "high", "low", "close", "volume")


def distinct_headlines(rows: DataFrame, late: str = "2 days") -> DataFrame:
    return rows.withWatermark("published_utc", late).dropDuplicatesWithinWatermark(["symbol", "title", "published_utc"])


def to_sessions(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stream-static join with a calendar (day, date): the session that each calendar day's news goes to."""
    return rows.withColumn("day", actionable_date("published_utc")).join(calendar, "day")


def bursts(rows: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of headlines of a symbol, parted by gaps."""
    out = rows.withWatermark("published_utc", late).groupBy(F.session_window("published_utc", gap).alias("w"), "symbol").agg(F.count("*").alias("n_headlines"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_headlines")


ACCOUNT = "account string, date string, equity double, peak double, brake double"


class Account(StatefulProcessor):
    """Equity, peak and drawdown brake of an account from its daily returns, in order of their dates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "equity double, peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        equity, peak = self.state.get() if self.state.exists() else (1.0, 1.0)
        days, out = pd.concat(list(rows)), []
        for _, day in days.sort_values("date").iterrows():
            brake = drawdown_factor(equity / peak - 1)
            equity *= 1 + float(day["ret"]) * brake
            peak = max(peak, equity)
            out.append((key[0], str(day["date"]), equity, peak, brake))
        self.state.update((equity, peak))
        yield pd.DataFrame(out, columns=["account", "date", "equity", "peak", "brake"])

    def close(self) -> None:
        pass


def accounts(returns: DataFrame) -> DataFrame:
    """returns: account, date and ret. State is one pair of numbers for each account."""
    return returns.groupBy("account").transformWithStateInPandas(Account(), ACCOUNT, "Append", "None")


DECISION = "account string, date date, symbol string, weight double, equity double, peak double, drawdown_before double"


class Decisions(StatefulProcessor):
    """The sequential decision pass of an account on a stream: the state is what sizing.decide hands from year to year."""

    def __init__(self, risk_free: float) -> None:
        self.rf = (1 + risk_free) ** (1 / 252) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decisions", "equity double, peak double, symbols array<string>, weights array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        equity, peak, symbols, weights = self.state.get() if self.state.exists() else (1.0, 1.0, [], [])
        frame = pd.concat(list(rows)).sort_values(["date", "symbol"])
        days = [{"date": d, "symbols": x["symbol"].tolist(), "sizes": x["size"].tolist(), "returns": x["fwd_ret"].tolist()} for d, x in frame.groupby("date")]
        got = fold_days(days, float(frame["band"].max()), self.rf, equity, peak, dict(zip(symbols, weights, strict=True)))
        end = got[-1]
        self.state.update((end["equity"], end["peak"], list(end["weights"]), [float(w) for w in end["weights"].values()]))
        yield pd.DataFrame([(key[0], d["date"], s, w, d["equity"], d["peak"], d["drawdown_before"]) for d in got for s, w in d["weights"].items()], columns=["account", "date", "symbol", "weight", "equity", "peak", "drawdown_before"])

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, risk_free: float = 0.06) -> DataFrame:
    """rows: account, band, date, symbol, size and fwd_ret; all rows of an account's day come in one batch, days in order."""
    return rows.groupBy("account").transformWithStateInPandas(Decisions(risk_free), DECISION, "Append", "None")


ALERT = "symbol string, date string, trigger string"


class Breaker(StatefulProcessor):
    """Gap and range alerts: the state holds the last close and the last 14 true ranges."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "close double, ranges array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        close, ranges = self.state.get() if self.state.exists() else (None, [])
        ranges, out = list(ranges), []
        for _, bar in pd.concat(list(rows)).sort_values("date").iterrows():
            spread = bar["high"] - bar["low"]
            if close is not None and bar["open"] / close - 1 <= -0.03:
                out.append((key[0], str(bar["date"]), "gap_down"))
            elif len(ranges) == 14 and spread > 2.5 * sum(ranges) / 14:
                out.append((key[0], str(bar["date"]), "range"))
            true = spread if close is None else max(spread, abs(bar["high"] - close), abs(bar["low"] - close))
            ranges, close = [*ranges, float(true)][-14:], float(bar["close"])
        self.state.update((close, ranges))
        yield pd.DataFrame(out, columns=["symbol", "date", "trigger"])

    def close(self) -> None:
        pass


def alerts(bar_stream: DataFrame) -> DataFrame:
    return bar_stream.groupBy("symbol").transformWithStateInPandas(Breaker(), ALERT, "Append", "None")


def staleness(ticks: DataFrame, late: str = "1 day", after: str = "4 days") -> DataFrame:
    """A symbol's silent spells as session windows: an alarm is a session that has ended."""
    out = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", after).alias("w"), "symbol").agg(F.max("ts").alias("last_tick"))
    return out.select("symbol", "last_tick", F.col("w.end").alias("stale_since"))


def idempotent_sink(path: str, keys: list[str]):
    """foreachBatch writer: the rows of a batch replace what any earlier batch wrote for their keys, so a repeated
    batch and a corrected row change nothing else. Keys are folders of the table, such as account and date; of
    equal keys in one batch one row stays, and an empty batch writes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)

    return write
