"""Decomposition, smoothing and boosting against plain versions."""

import numpy as np
import pytest

from quillon.operators import boosting, smoothing
from quillon.plans import signals as plans


def series(n=120, seed=0):
    draw = np.random.default_rng(seed)
    t = np.arange(n)
    return 200 + 0.5 * t + 40 * np.sin(2 * np.pi * t / 7) + draw.normal(0, 5, n)


def plain_loess(y, weight, width, at):
    out = []
    for x in at:
        near = sorted(sorted(range(len(y)), key=lambda j: (abs(j - x), j))[: min(width, len(y))])
        if near != list(range(near[0], near[-1] + 1)):
            near = list(range(near[0], near[0] + len(near)))
        h = max(abs(j - x) for j in near) + max(width - len(y), 0) // 2
        w = np.array([weight[j] * (1 if abs(j - x) <= 0.001 * h else (1 - (abs(j - x) / h) ** 3) ** 3 if abs(j - x) <= 0.999 * h else 0) for j in near])
        a = np.array([[np.sum(w), np.sum(w * near)], [np.sum(w * near), np.sum(w * np.array(near) ** 2)]])
        b = np.array([np.sum(w * y[near]), np.sum(w * near * y[near])])
        line = np.linalg.lstsq(a, b, rcond=None)[0]
        out.append(line[0] + line[1] * x)
    return np.array(out)


@pytest.mark.parametrize(("n", "width"), [(60, 15), (60, 9), (9, 7), (5, 9)])
def test_loess_like_plain(n, width):
    y, w = series(n), np.random.default_rng(1).uniform(0.2, 1, n)
    at = np.arange(-1.0, n + 1)
    assert np.allclose(smoothing.loess(y, w, width, at), plain_loess(y, w, width, at))


def test_stl_parts_and_robustness():
    y = series(210)
    trend, season, _ = smoothing.stl(y)
    assert np.corrcoef(season, 40 * np.sin(2 * np.pi * np.arange(210) / 7))[0, 1] > 0.98 and abs(np.polyfit(np.arange(210), trend, 1)[0] - 0.5) < 0.05
    spoiled = y.copy()
    spoiled[100] += 5000
    bent, _, weight = smoothing.stl(spoiled)
    assert weight[100] == 0 and np.abs(bent - trend).max() < 10
    assert np.allclose(smoothing.stl_forecast(y, 7), 200 + 0.5 * 210 + 40 * np.sin(2 * np.pi * np.arange(210, 217) / 7), atol=20)
    assert smoothing.stl_forecast(y[:5], 2).shape == (2,) and smoothing.stl_forecast(y[:0], 2).tolist() == [0, 0]


def plain_sse(y, constants, start, period=7):
    alpha, beta, gamma = constants
    level, trend, season, sse = start[0], start[1], list(start[2:]), 0.0
    for t, v in enumerate(y):
        s = season[t % period]
        e = v - (level + trend + s)
        sse += e * e
        before = level
        level = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[t % period] = gamma * (v - level) + (1 - gamma) * s
    return sse


def test_smoothing_is_fitted():
    y = series(90, 3)
    constants, sse, _ = smoothing.fit_smoothing(y)
    _, start, _ = smoothing._fitted(y, constants[None], 7)
    assert plain_sse(y, constants, start[0]) == pytest.approx(sse, rel=1e-6)
    usual = np.concatenate([[y[:7].mean(), (y[7:14].mean() - y[:7].mean()) / 7], y[:7] - y[:7].mean()])
    assert all(sse <= plain_sse(y, c, usual) + 1e-6 for c in smoothing.GRID)
    nudged = [plain_sse(y, constants, start[0] + d) for d in np.random.default_rng(0).normal(0, 1, (20, 9))]
    assert sse <= min(nudged) + 1e-6
    assert np.allclose(smoothing.smoothing_forecast(y, 7), 200 + 0.5 * 90 + 40 * np.sin(2 * np.pi * np.arange(90, 97) / 7), atol=25)
    assert smoothing.smoothing_forecast(y[:3], 2).shape == (2,) and smoothing.smoothing_forecast(y[:0], 1).tolist() == [0]


def plain_tree(x, g, leaves, leaf_rows, l2):
    """Every split of every leaf at every value is tried; the best one is made."""
    parts = [np.arange(len(g))]
    score = lambda r: g[r].sum() ** 2 / (len(r) + l2)
    while len(parts) < leaves:
        best = None
        for k, rows in enumerate(parts):
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(a), len(b)) >= leaf_rows:
                        gain = score(a) + score(b) - score(rows)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, k, a, b
        if best is None or best[0] <= 1e-12:
            break
        parts[best[1]] = best[2]
        parts.append(best[3])
    return {frozenset(p.tolist()): g[p].sum() / (len(p) + l2) for p in parts}


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_like_an_exhaustive_search(seed):
    draw = np.random.default_rng(seed)
    x, g = np.stack([draw.normal(size=60), draw.integers(0, 3, 60), draw.normal(size=60)], axis=1), draw.normal(size=60)
    tree, leaf = boosting.grow(boosting._Bins(x), g, leaves=6, leaf_rows=4, l2=1.0)
    got = {frozenset(np.flatnonzero(leaf == k).tolist()): v for k, v in enumerate(tree.values)}
    want = plain_tree(x, g, 6, 4, 1.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert (tree.leaves(x) == leaf).all()


def test_boosting_learns_and_stops():
    draw = np.random.default_rng(5)
    x = draw.uniform(-1, 1, (600, 3))
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] ** 2
    model = boosting.fit(x[:400], y[:400])
    assert np.mean((model.predict(x[400:]) - y[400:]) ** 2) < 0.02 * y.var()
    assert boosting.fit(x[:5], y[:5]).trees == [] and boosting.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0, 0]
    many = draw.normal(size=(2000, 1))
    assert len(boosting.cut_points(many[:, 0])) <= 255


def test_models_by_venue(spark, sf_dir):
    folds = plans._folds(spark, sf_dir).where("fold < 2")
    got = boosting.boosted_by_venue(folds, trees=20).collect()
    assert len(got) == folds.where("role = 'test'").count() and all(r.yhat >= 0 for r in got)
