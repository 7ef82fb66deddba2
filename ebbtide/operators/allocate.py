"""Portfolio weights of return panels: one Spark group a panel, small numpy algebra inside.

A panel (some dozen assets, some thousand weeks) is one optimisation problem, so a group is bounded
by the problem and panels run in parallel. Weeks on which an asset of the panel is missing are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def capped(v: np.ndarray, cap: float) -> np.ndarray:
    """Non-negative shares of one, none above the cap (at least 1/n); excess goes to the rest by share."""
    n = len(v)
    cap, w = max(cap, 1 / n), np.maximum(v, 0)
    w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
    full = np.zeros(n, bool)
    while (w > cap + 1e-12).any():
        full |= w > cap + 1e-12
        left = 1 - cap * full.sum()
        rest = np.where(full, 0, w)
        rest = rest if rest.sum() > 0 else (~full).astype(float)
        w = np.where(full, cap, rest * left / max(rest.sum(), 1e-300))
    return w / w.sum()


def nearest(v: np.ndarray, cap: float) -> np.ndarray:
    """Euclidean projection onto {0 <= w <= cap, sum w = 1}, by bisection on the shift."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(v - hi, 0, cap)


def cdar_and_slope(w: np.ndarray, cum: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Conditional drawdown at risk of uncompounded returns and a subgradient; row 0 of cum is the start capital."""
    path = cum @ w
    top = np.maximum.accumulate(path)
    peak = np.maximum.accumulate(np.where(path >= top, np.arange(len(path)), 0))
    dd = (top - path)[1:]
    k = (1 - alpha) * len(dd)
    worst = np.argsort(-dd)[: int(np.ceil(k))]
    q = np.ones(len(worst))
    q[-1] -= len(worst) - k
    q /= k
    return float(q @ dd[worst]), q @ (cum[peak[worst + 1]] - cum[worst + 1])


def descend(start, slope, cap: float, steps: int):
    """Best point of a projected subgradient walk with steps that shrink; slope(w) gives (value, subgradient)."""
    w, best, at = start, np.inf, start
    for k in range(steps):
        value, g = slope(w)
        if value < best:
            best, at = value, w
        norm = np.linalg.norm(g)
        if norm < 1e-15:
            break
        w = nearest((w if k % 50 else at) - g / norm * 0.5 / (1 + k) ** 0.75, cap)
    return at


def min_cdar(r: np.ndarray, alpha: float = 0.95, cap: float = 0.35, steps: int = 3000) -> np.ndarray:
    cum = np.vstack([np.zeros(r.shape[1]), r.cumsum(0)])
    n, cap = r.shape[1], max(cap, 1 / r.shape[1])
    return descend(np.full(n, 1 / n), lambda w: cdar_and_slope(w, cum, alpha), cap, steps)


def max_return(r: np.ndarray, budget: float, alpha: float = 0.95, cap: float = 0.35, steps: int = 3000) -> np.ndarray | None:
    """Highest mean return with CDaR within the budget; None where no weights keep it."""
    cum, mu = np.vstack([np.zeros(r.shape[1]), r.cumsum(0)]), r.mean(0)
    cap = max(cap, 1 / r.shape[1])
    safe = min_cdar(r, alpha, cap, steps)
    if cdar_and_slope(safe, cum, alpha)[0] > budget + 1e-9:
        return None
    best = safe

    def slope(w):
        nonlocal best
        risk, g = cdar_and_slope(w, cum, alpha)
        lo, hi = 0.0, 1.0  # as far from the safe weights towards w as the budget allows; risk is convex
        if risk > budget:
            for _ in range(20):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if cdar_and_slope(safe + mid * (w - safe), cum, alpha)[0] <= budget else (lo, mid)
        else:
            lo = 1.0
        found = safe + lo * (w - safe)
        if mu @ found > mu @ best:
            best = found
        return (-(mu @ found), g) if risk > budget else (-(mu @ found), -mu)

    descend(safe, slope, cap, steps // 2)
    return best


def shrunk_covariance(r: np.ndarray) -> tuple[np.ndarray, float]:
    """Ledoit and Wolf's shrinkage of the covariance (divisor T) towards a multiple of the identity."""
    x = r - r.mean(0)
    t, n = x.shape
    s = x.T @ x / t
    mean = np.trace(s) / n
    spread = ((s - mean * np.eye(n)) ** 2).sum()
    noise = max(0.0, ((x**2).T @ (x**2)).sum() / t - (s**2).sum()) / t
    k = 0.0 if spread == 0 else min(1.0, noise / spread)
    return (1 - k) * s + k * mean * np.eye(n), k


def min_variance(r: np.ndarray, cap: float = 0.35) -> np.ndarray:
    w = np.linalg.pinv(shrunk_covariance(r)[0]).sum(1)
    return capped(w / w.sum(), cap)


def leaf_order(dist: np.ndarray) -> list[int]:
    """Leaves of single linkage: the two nearest clusters join until one is left."""
    groups = {i: [i] for i in range(len(dist))}
    new = len(dist)
    while len(groups) > 1:
        keys = sorted(groups)
        _, a, b = min((dist[np.ix_(groups[i], groups[j])].min(), i, j) for i in keys for j in keys if i < j)
        groups[new] = groups.pop(a) + groups.pop(b)
        new += 1
    return groups.popitem()[1]


def risk_parity(r: np.ndarray, cap: float | None = None) -> np.ndarray:
    """Hierarchical risk parity: halves of the leaf order share weight by inverse cluster variance."""
    cov, corr = np.atleast_2d(np.cov(r.T)), np.nan_to_num(np.atleast_2d(np.corrcoef(r.T)))
    w = np.ones(len(cov))

    def variance(items):
        part = cov[np.ix_(items, items)]
        iv = 1 / np.diag(part)
        return float(iv @ part @ iv) / iv.sum() ** 2

    todo = [leaf_order(np.sqrt(np.clip((1 - corr) / 2, 0, 1)))]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = variance(left), variance(right)
        w[left] *= 1 - a / (a + b)
        w[right] *= a / (a + b)
        todo += [left, right]
    w = np.minimum(w, cap) if cap else w
    return w / w.sum()


METHODS = {"min_cdar": min_cdar, "hrp": risk_parity, "min_variance": min_variance}


def _panel(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot_table(index="week", columns="symbol", values="r").dropna()


def weights(returns: DataFrame, method: str) -> DataFrame:
    """(panel, symbol, w) of returns (panel, symbol, week, r) by one of METHODS; panels under 8 full weeks give none."""
    solve = METHODS[method]

    def run(pdf):
        p = _panel(pdf)
        if len(p) < 8:
            return pd.DataFrame({"panel": [], "symbol": [], "w": []})
        return pd.DataFrame({"panel": pdf.panel.iloc[0], "symbol": p.columns, "w": solve(p.to_numpy())})

    return returns.groupBy("panel").applyInPandas(run, "panel string, symbol string, w double")


def frontier(returns: DataFrame, points: int = 12, alpha: float = 0.95, cap: float = 0.35) -> DataFrame:
    """(panel, point, budget, symbol, w): highest return under budgets from the least CDaR to that of the highest return."""

    def run(pdf):
        p, out = _panel(pdf), []
        if len(p) >= 8:
            r = p.to_numpy()
            cum = np.vstack([np.zeros(r.shape[1]), r.cumsum(0)])
            lo = cdar_and_slope(min_cdar(r, alpha, cap), cum, alpha)[0]
            hi = cdar_and_slope(max_return(r, 10.0, alpha, cap), cum, alpha)[0]
            for i, b in enumerate(np.linspace(lo, max(hi, 1.05 * lo), points)):
                w = max_return(r, b, alpha, cap)
                out += [] if w is None else [(pdf.panel.iloc[0], i, b, s, x) for s, x in zip(p.columns, w)]
        return pd.DataFrame(out, columns=["panel", "point", "budget", "symbol", "w"])

    return returns.groupBy("panel").applyInPandas(run, "panel string, point int, budget double, symbol string, w double")
