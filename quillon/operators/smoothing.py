"""Decomposition of a daily series into trend, season and rest by LOESS, and exponential smoothing whose constants are fitted.

Both work on one venue's series in a task; many series are many groups.
"""

from __future__ import annotations

import itertools

import numpy as np


def loess(y: np.ndarray, weight: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Local lines through evenly spaced values: at each place of `at` the `width` nearest of them, by tricube weights times their own."""
    n = len(y)
    q = min(width, n)
    left = np.clip(np.ceil(at - (q - 1) / 2 - 1e-9).astype(int), 0, n - q)
    near = left[:, None] + np.arange(q)
    far = np.abs(near - at[:, None])
    reach = np.maximum(far.max(axis=1, keepdims=True) + max(width - n, 0) // 2, 1e-12)
    w = np.where(far <= 0.999 * reach, (1 - np.minimum(far / reach, 1) ** 3) ** 3, 0.0) * weight[near]
    w = np.where(far <= 0.001 * reach, weight[near], w)
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.full_like(w, 1 / q), where=total > 0)
    middle = (w * near).sum(axis=1, keepdims=True)
    spread = (w * (near - middle) ** 2).sum(axis=1, keepdims=True)
    steep = np.sqrt(spread) > 0.001 * max(n - 1, 1)
    w = np.where(steep, w * (1 + np.divide(at[:, None] - middle, spread, out=np.zeros_like(spread), where=steep) * (near - middle)), w)
    return (w * y[near]).sum(axis=1)


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def _mean(x: np.ndarray, k: int) -> np.ndarray:
    total = np.append(0.0, np.cumsum(x))
    return (total[k:] - total[:-k]) / k


def stl(y: np.ndarray, period: int = 7, *, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, robustness weights) by seasonal-trend decomposition with LOESS.

    In each inner turn every weekday's subseries is smoothed and cleared of what a low-pass filter leaves of it; what remains of
    the series gives the trend. After each outer turn values far from both lose their weight (bisquare, six medians).
    """
    n = len(y)
    width, low = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend, season, weight = np.zeros(n), np.zeros(n), np.ones(n)
    days = np.arange(n, dtype=float)
    for k in range(max(outer, 1)):
        for _ in range(inner):
            rest, cycle = y - trend, np.zeros(n + 2 * period)
            for p in range(period):
                part = rest[p::period]
                cycle[p::period] = loess(part, weight[p::period], seasonal, np.arange(-1.0, len(part) + 1))
            passed = _mean(_mean(_mean(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(passed, np.ones(n), low, days)
            trend = loess(y - season, weight, width, days)
        off = np.abs(y - trend - season)
        limit = 6 * np.median(off)
        if k + 1 < outer:
            weight = np.where(off <= 0.001 * limit, 1.0, np.where(off <= 0.999 * limit, (1 - np.minimum(off / max(limit, 1e-300), 1) ** 2) ** 2, 0.0))
    return trend, season, weight


def stl_forecast(y: np.ndarray, horizon: int, period: int = 7) -> np.ndarray:
    """The last trend plus the mean season of each weekday, at least 0."""
    n = len(y)
    if n < 2 * period + 1:
        return np.full(horizon, max(float(np.median(y)) if n else 0.0, 0.0))
    trend, season, _ = stl(y, period)
    by_day = np.array([season[i::period].mean() for i in range(period)])
    return np.maximum(trend[-1] + by_day[(n + np.arange(horizon)) % period], 0.0)


def _errors(y: np.ndarray, constants: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of additive trend and season for each row of constants (alpha, beta, gamma), as they depend on the initial states.

    Errors are linear in the initial states, so the series is run once from states of 0, and zeros are run from each state of
    1: (errors (row, day, run), last states (row, state, run)), run 0 being the series itself.
    """
    rows, states = len(constants), 2 + period
    alpha, beta, gamma = (constants[:, i : i + 1] for i in range(3))
    now = np.zeros((rows, states, states + 1))
    now[:, np.arange(states), np.arange(1, states + 1)] = 1
    out = np.empty((rows, len(y), states + 1))
    first = np.zeros(states + 1)
    first[0] = 1
    for t, value in enumerate(y):
        level, trend, season = now[:, 0], now[:, 1], now[:, 2 + t % period]
        e = value * first - (level + trend + season)
        out[:, t] = e
        now[:, 0], now[:, 1] = level + trend + alpha * e, trend + alpha * beta * e
        now[:, 2 + t % period] = season + gamma * (1 - alpha) * e
    return out, now


def _fitted(y: np.ndarray, constants: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of constants the least sum of squared errors over all initial states, these states, and the last states."""
    e, last = _errors(y, constants, period)
    a, b = e[:, :, 1:], e[:, :, 0]
    gram = np.einsum("rts,rtu->rsu", a, a) + 1e-9 * len(y) * np.eye(a.shape[2])
    start = -np.linalg.solve(gram, np.einsum("rts,rt->rs", a, b)[:, :, None])[:, :, 0]
    left = b + np.einsum("rts,rs->rt", a, start)
    return (left * left).sum(axis=1), start, last[:, :, 0] + np.einsum("rsu,ru->rs", last[:, :, 1:], start)


#: Constants from which the search begins (fixed values).
GRID = np.array(list(itertools.product((0.1, 0.3, 0.6), (0.01, 0.1), (0.05, 0.3))))


def fit_smoothing(y: np.ndarray, period: int = 7, *, turns: int = 8) -> tuple[np.ndarray, float, np.ndarray]:
    """(constants, sum of squared errors, last states): initial states by least squares, constants by a search that halves its steps around the best of GRID."""
    sse, _, last = _fitted(y, GRID, period)
    k = int(sse.argmin())
    best, least, state, step = GRID[k], sse[k], last[k], 0.2
    moves = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    for _ in range(turns):
        tried = np.clip(best + step * moves, 1e-4, 0.9999)
        sse, _, last = _fitted(y, tried, period)
        k = int(sse.argmin())
        if sse[k] < least:
            best, least, state = tried[k], sse[k], last[k]
        else:
            step /= 2
    return best, float(least), state


def smoothing_forecast(y: np.ndarray, horizon: int, period: int = 7) -> np.ndarray:
    """Additive trend and season, fitted; at least 0."""
    n = len(y)
    if n < 2 * period:
        return np.full(horizon, max(float(y.mean()) if n else 0.0, 0.0))
    scale = max(float(np.abs(y).mean()), 1e-12)
    _, _, state = fit_smoothing(y / scale, period)
    steps = np.arange(1, horizon + 1)
    return np.maximum(scale * (state[0] + steps * state[1] + state[2 + (n + steps - 1) % period]), 0.0)
