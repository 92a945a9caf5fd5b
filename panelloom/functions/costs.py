"""Trading costs as columns of parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brokerage and its cap, transaction tax on buys and sells, exchange and regulator fees,
#: tax on fees, stamp duty on buys, depository fee on sells, slippage. Shares of the turnover.
DELIVERY = {"brokerage": 0.0, "cap": 0.0, "tax_buy": 0.001, "tax_sell": 0.001, "exchange": 0.0000297, "regulator": 0.000001, "gst": 0.18, "stamp": 0.00015, "depository": 0.0, "slippage": 0.0005}
INTRADAY = DELIVERY | {"tax_buy": 0.0, "tax_sell": 0.00025, "stamp": 0.00003}


def cost(turnover: Column, side: str, p: dict[str, float]) -> Column:
    """Cost of a turnover; 0 where it isn't positive."""
    fee = F.least(turnover * p["brokerage"], F.lit(p["cap"])) if p["brokerage"] else F.lit(0.0)
    levies = turnover * (p["exchange"] + p["regulator"])
    total = fee + turnover * p[f"tax_{side}"] + levies + p["gst"] * (fee + levies) + turnover * p["slippage"]
    total = total + (turnover * p["stamp"] if side == "buy" else F.lit(p["depository"]))
    return F.when(turnover > 0, total).otherwise(0.0)


def rate(side: str, p: dict[str, float]) -> float:
    """Cost as a share of the turnover, where no cap or fixed fee applies."""
    levies = p["exchange"] + p["regulator"]
    return p["brokerage"] + p[f"tax_{side}"] + levies + p["gst"] * (p["brokerage"] + levies) + (p["stamp"] if side == "buy" else 0) + p["slippage"]


def with_round_trip(bps: float, p: dict[str, float]) -> dict[str, float]:
    """The schedule whose slippage makes a round trip cost so many basis points; never below 0."""
    now = (rate("buy", p) + rate("sell", p)) * 1e4
    return p | {"slippage": max(0.0, p["slippage"] + (bps - now) / 2 / 1e4)}
