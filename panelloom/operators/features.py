"""Causal technical features: every value uses the row's own past only."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import clip, ewm, pct_rank, roll, rolling, symbol_rows


def ret(k: int = 1, column: str = "close", w=None) -> Column:
    return F.try_divide(F.col(column), F.lag(column, k).over(w or symbol_rows())) - 1


def true_range(w=None) -> Column:
    """greatest skips the null of a series' first row."""
    before = F.lag("close").over(w or symbol_rows())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


_EXTREMES = {"lo": ("min", "low", 14, 14), "hi": ("max", "high", 14, 14)}


def _stoch_k() -> Column:
    return F.try_divide(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo"))


def stochastic_k(bars: DataFrame, placed: bool = False) -> DataFrame:
    """bars with the stochastic %K of window_features alone; placed: as in rolling."""
    return rolling(bars, _EXTREMES, ["symbol"], placed=placed).withColumn("stoch_k", _stoch_k()).drop(*_EXTREMES)


def latched(bars: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Adds latch, baselines.rsi_latch on the stochastic %K over the rows with a forward return, in the pass that makes %K;
    a window over the same symbols made bars."""

    def k(made: dict[str, np.ndarray]) -> np.ndarray:
        span = made["_hi"] - made["_lo"]
        return (made["close"] - made["_lo"]) / np.where(span == 0, np.nan, span)

    def crossing(made: dict[str, np.ndarray]) -> np.ndarray:
        return np.where(np.isnan(made["fwd_ret"]), np.nan, np.where(made["_k"] < low, 1.0, np.where(made["_k"] > high, 0.0, np.nan)))

    frames = {"_lo": _EXTREMES["lo"], "_hi": _EXTREMES["hi"], "_close": ("lag", "close", 0, 1), "_fwd": ("lag", "fwd_ret", 0, 1), "_k": k, "_crossing": crossing, "_held": ("last", "_crossing", 0, 0)}
    return rolling(bars, frames | {"latch": lambda made: np.where(np.isnan(made["_k"]), 0.0, np.nan_to_num(made["_held"], nan=0.0))}, ["symbol"], placed=True)


def window_features(bars: DataFrame) -> DataFrame:
    """Returns, Bollinger position, volume z, volatility, distances to means, stochastic %K and range."""
    rows = bars.withColumns({f"ret_{k}d": ret(k) for k in (1, 5, 10, 20)})
    means = {f"mean_{n}": ("mean", "close", n, n) for n in (20, 50, 200)}
    rows = rolling(rows, means | {"std": ("deviation", "close", 20, 20), "mean_v": ("mean", "volume", 20, 20), "std_v": ("deviation", "volume", 20, 20), "std_r": ("deviation", "ret_1d", 20, 20)} | _EXTREMES, ["symbol"], placed=True)
    return rows.withColumns(
        {
            "bb_pos": F.try_divide(F.col("close") - F.col("mean_20"), 2 * F.col("std")),
            "vol_z20": F.try_divide(F.col("volume") - F.col("mean_v"), F.col("std_v")),
            "vol_20": F.col("std_r") * sqrt(252),
            **{f"dist_sma{n}": F.col("close") / F.col(f"mean_{n}") - 1 for n in (20, 50, 200)},
            "stoch_k": _stoch_k(),
            "range_pct": (F.col("high") - F.col("low")) / F.col("close"),
        }
    ).drop(*means, "std", "mean_v", "std_v", "std_r", "lo", "hi")


def recursive_features(bars: DataFrame) -> DataFrame:
    """RSI(14) as a share, MACD histogram and ATR(14), both relative to the close."""
    change = F.col("close") - F.lag("close").over(symbol_rows())
    rows = bars.withColumns({"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), "_tr": true_range(), "_n": F.row_number().over(symbol_rows())})
    rows = ewm(rows, {"_g": ("_gain", 1 / 14), "_l": ("_loss", 1 / 14), "_a": ("_tr", 1 / 14), "_fast": ("close", 2 / 13), "_slow": ("close", 2 / 27), "_nine": ("close", 0.2)}, ["symbol"])
    # The mean (0.2) of a mean (alpha) is a mixture of the two means themselves, so the signal needs no second pass.
    share = lambda alpha: 0.2 * (1 - alpha) / (0.8 - (1 - alpha))
    signal = share(2 / 27) * (F.col("_slow") - F.col("_nine")) - share(2 / 13) * (F.col("_fast") - F.col("_nine"))
    rows = rows.withColumns({"_macd": F.col("_fast") - F.col("_slow"), "_signal": signal})
    rsi = F.when(F.col("_n") > 14, 100 - 100 / (1 + F.try_divide(F.col("_g"), F.when(F.col("_l") != 0, F.col("_l")))))
    rows = rows.withColumns({"rsi_14": F.coalesce(rsi, F.lit(50.0)) / 100, "macd_hist": (F.col("_macd") - F.col("_signal")) / F.col("close"), "atr_14": F.when(F.col("_n") >= 14, F.col("_a") / F.col("close"))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def all_features(bars: DataFrame) -> DataFrame:
    """recursive_features(window_features(bars)) in one pass over the rows where a window over the same symbols made them, so nothing
    is shuffled or written. Closes are not null."""
    div = lambda a, b: a / np.where(b == 0, np.nan, b)
    share = lambda alpha: 0.2 * (1 - alpha) / (0.8 - (1 - alpha))
    signal = lambda m: share(2 / 27) * (m["_slow"] - m["_nine"]) - share(2 / 13) * (m["_fast"] - m["_nine"])
    change = lambda m: m["close"] - m["_close_1"]
    frames = {f"_close_{k}": ("lag", "close", k, 1) for k in (1, 5, 10, 13, 14, 20)} | {f"_{c}": ("lag", c, 0, 1) for c in ("high", "low", "volume")}
    frames |= {f"ret_{k}d": lambda m, k=k: _change(m, "close", f"_close_{k}") for k in (1, 5, 10, 20)}
    frames |= {f"_mean_{n}": ("mean", "close", n, n) for n in (20, 50, 200)} | {f"_{c}": f for c, f in _EXTREMES.items()}
    frames |= {"_std": ("deviation", "close", 20, 20), "_mean_v": ("mean", "volume", 20, 20), "_std_v": ("deviation", "volume", 20, 20), "_std_r": ("deviation", "ret_1d", 20, 20)}
    frames |= {
        "bb_pos": lambda m: div(m["close"] - m["_mean_20"], 2 * m["_std"]),
        "vol_z20": lambda m: div(m["volume"] - m["_mean_v"], m["_std_v"]),
        "vol_20": lambda m: m["_std_r"] * sqrt(252),
        **{f"dist_sma{n}": lambda m, n=n: div(m["close"], m[f"_mean_{n}"]) - 1 for n in (20, 50, 200)},
        "stoch_k": lambda m: div(m["close"] - m["_lo"], m["_hi"] - m["_lo"]),
        "range_pct": lambda m: div(m["high"] - m["low"], m["close"]),
        "_gain": lambda m: np.maximum(change(m), 0.0),
        "_loss": lambda m: np.maximum(-change(m), 0.0),
        "_range": lambda m: np.fmax(np.fmax(m["high"] - m["low"], np.abs(m["high"] - m["_close_1"])), np.abs(m["low"] - m["_close_1"])),
        **{c: ("ewm", x, alpha, 0) for c, x, alpha in (("_g", "_gain", 1 / 14), ("_l", "_loss", 1 / 14), ("_a", "_range", 1 / 14), ("_fast", "close", 2 / 13), ("_slow", "close", 2 / 27), ("_nine", "close", 0.2))},
        "rsi_14": lambda m: np.where(np.isnan(m["_close_14"]) | ~(np.abs(m["_l"]) > 0), 50.0, 100 - 100 / (1 + div(m["_g"], m["_l"]))) / 100,
        "macd_hist": lambda m: div(m["_fast"] - m["_slow"] - signal(m), m["close"]),
        "atr_14": lambda m: np.where(np.isnan(m["_close_13"]), np.nan, div(m["_a"], m["close"])),
    }
    return rolling(bars, frames, ["symbol"], placed=True)


def macro_series(index: DataFrame, vix: DataFrame) -> DataFrame:
    """Index close and 20-row momentum, volatility index and its percentile: a row for each session."""
    w = Window.orderBy("date")
    table = index.select("date", F.col("close").alias("index_close")).withColumn("index_mom_20d", F.col("index_close") / F.lag("index_close", 20).over(w) - 1)
    level = vix.withColumn("vix_percentile", pct_rank("vix", 252, w, 60))
    return table.join(level, "date", "left")


def with_macro(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Bars with the macro series, filled forward over the symbol's rows."""
    fill = symbol_rows().rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.join(F.broadcast(macro), "date", "left")  # macro is a row for each session
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(fill) for c in macro.columns if c != "date"})


def _change(made: dict[str, np.ndarray], column: str, before: str) -> np.ndarray:
    """Return over a value before, nan where that is none or 0."""
    return made[column] / np.where(made[before] == 0, np.nan, made[before]) - 1


def regime_of(rows: DataFrame) -> DataFrame:
    """with_macro's rows with trend, strength, 52-week position and volatility ranks; returns are made where the frames are."""
    frames = {
        "_close_1": ("lag", "close", 1, 1),
        "_close_60": ("lag", "close", 60, 1),
        "_index_60": ("lag", "index_close", 60, 1),
        "ret_1d": lambda made: _change(made, "close", "_close_1"),
        "rel_strength_60d": lambda made: _change(made, "close", "_close_60") - _change(made, "index_close", "_index_60"),
        "mean": ("mean", "close", 200, 200),
        "lo": ("min", "low", 252, 252),
        "hi": ("max", "high", 252, 252),
        "_std": ("deviation", "ret_1d", 20, 20),
        # The volatility is rounded, so that equal windows tie in the ranks whatever the order of their sums.
        "vol_20": lambda made: np.round(made["_std"] * sqrt(252), 10),
        "vol_percentile": ("rank", "vol_20", 252, 60),
    }
    names = rows.columns
    rows = rolling(rows, frames, ["symbol"], placed=True)
    gap = F.try_divide("close", "mean") - 1
    pos = clip(F.try_divide(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")), 0, 1)
    return rows.select(*names, "ret_1d", F.signum(gap).alias("trend"), clip(gap, -0.5, 0.5).alias("trend_strength"), "rel_strength_60d", pos.alias("pos_52w"), "vol_20", "vol_percentile")


def regime_table(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Bars with the macro series filled forward, trend, strength, 52-week position and volatility ranks."""
    return regime_of(with_macro(bars, macro))


def market_regime(index: DataFrame, start: str) -> DataFrame:
    """crash, bull or choppy for each session from start on; returns and peaks start there too."""
    w = Window.orderBy("date")
    rows = index.where(F.col("date") >= F.lit(start).cast("date")).select("date", "close")
    rows = rows.withColumns({"ret_60": F.col("close") / F.lag("close", 60).over(w) - 1, "gap": F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    return rows.select("date", F.when(F.col("ret_60") < -0.10, "crash").when(F.col("gap") > -0.03, "bull").otherwise("choppy").alias("regime"))


def causal_atr(bars: DataFrame) -> DataFrame:
    """Mean true range of the 14 rows before."""
    return bars.withColumn("_tr", true_range()).withColumn("atr_prior", roll(F.avg, "_tr", 14, symbol_rows(), lag=1)).drop("_tr")


def momentum_12_1(bars: DataFrame) -> DataFrame:
    return bars.withColumn("mom_12_1", F.lag("close", 21).over(symbol_rows()) / F.lag("close", 252).over(symbol_rows()) - 1)
