"""Sequential rules of one account, in plain Python: what tasks run inside a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CAP = 0.20


def drawdown_factor(drawdown: float) -> float:
    if drawdown <= -0.30:
        return 0.0
    return min(max((drawdown + 0.30) / 0.15, 0.0), 1.0) if drawdown < -0.15 else 1.0


def fold_days(days: list[dict], band: float, rf: float, equity: float = 1.0, peak: float = 1.0, held: dict[str, float] | None = None) -> list[dict]:
    """The pass over one account's days in order: brake by the drawdown so far, cap, band, cap, realise.

    Small entries and exits are made; only small changes of a held name are not. equity, peak and held are what
    an earlier pass ended with, so a series may be cut after any day.
    """
    held = dict(held or {})
    out = []
    for day in days:
        drawdown = equity / peak - 1
        factor = drawdown_factor(drawdown)
        sizes = {s: max(0.0, min(CAP, w * factor)) for s, w in zip(day["symbols"], day["sizes"], strict=True)}
        for again in (False, True):
            if again:
                sizes = {s: held[s] if band > 0 and held.get(s, 0) > 0 and w > 0 and abs(w - held[s]) < band else w for s, w in sizes.items()}
            total = sum(sizes.values())
            if total > 1:
                sizes = {s: w / total for s, w in sizes.items()}
        earned = {s: r for s, r in zip(day["symbols"], day["returns"], strict=True) if r is not None and r == r and sizes[s] > 0}
        counted = sum(sizes[s] for s in earned)
        equity *= 1 + sum(sizes[s] * r for s, r in earned.items()) + max(0.0, 1 - counted) * rf
        peak = max(peak, equity)
        held = sizes
        out.append({"date": day["date"], "drawdown_before": drawdown, "equity": equity, "peak": peak, "weights": sizes})
    return out


class Account:
    """fold_days a day at a time, in arrays: what it keeps is the equity, its peak and the book of one day."""

    def __init__(self, rf: float, equity: float = 1.0, peak: float = 1.0, names: pa.Array | None = None, weights: np.ndarray | None = None) -> None:
        self.rf, self.equity, self.peak, self.names, self.weights = rf, equity, peak, names, weights

    def day(self, names: pa.Array, sizes: np.ndarray, returns: np.ndarray, band: float) -> float:
        """Adds a day of different names; a return that isn't known is nan. Gives the drawdown before it. Sums are Python's, as in fold_days."""
        drawdown = self.equity / self.peak - 1
        w = sizes * drawdown_factor(drawdown)
        w = np.where(w < CAP, w, CAP)
        w = _at_most_one(np.where(w > 0, w, 0.0))
        if band > 0 and self.names is not None and len(self.names):
            at = pc.index_in(names, value_set=self.names)
            old = np.where(at.is_valid().to_numpy(zero_copy_only=False), self.weights[pc.fill_null(at, 0).to_numpy()], 0.0)
            w = np.where((old > 0) & (w > 0) & (np.abs(w - old) < band), old, w)
        w = _at_most_one(w)
        earned = ~np.isnan(returns) & (w > 0)
        self.equity *= 1 + sum((w[earned] * returns[earned]).tolist()) + max(0.0, 1 - sum(w[earned].tolist())) * self.rf
        self.peak = max(self.peak, self.equity)
        self.names, self.weights = names, w
        return drawdown


def _at_most_one(w: np.ndarray) -> np.ndarray:
    total = sum(w.tolist())
    return w / total if total > 1 else w


def average_cost(q: float, avg: float, side: str, n: float, price: float, fee: float) -> tuple[float, float, float, bool]:
    """One fill: (quantity, average cost, realised profit, rejected). Selling more than held is rejected."""
    if side == "buy":
        return q + n, (q * avg + n * price) / (q + n), 0.0, False
    if n > q + 1e-9:
        return q, avg, 0.0, True
    left = q - n
    return (0.0, 0.0, n * (price - avg) - fee, False) if left <= 1e-9 else (left, avg, n * (price - avg) - fee, False)
