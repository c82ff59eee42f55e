"""Regressions by group against numpy, and tail probabilities against tables."""

import numpy as np
import pytest

from quillon.operators import regression as r


def test_tails():
    assert [round(r.p_of_t(t, df), 3) for t, df in ((2.228, 10), (12.706, 1), (1.96, 100_000), (0.0, 5))] == [0.05, 0.05, 0.05, 1.0]
    assert [round(r.p_of_f(f, a, b), 3) for f, a, b in ((4.965, 1, 10), (3.326, 5, 10), (161.4, 1, 1))] == [0.05, 0.05, 0.05]
    assert np.isnan(r.p_of_t(1.0, 0))


def data(n=300):
    draw = np.random.default_rng(4)
    x, z = draw.normal(1000, 1, n), draw.normal(size=n)
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    return [(str(k), float(a), float(b), float(3 + 2 * a - b * (k == "a") + e)) for k, a, b, e in zip(g, x, z, draw.normal(0, 0.5, n), strict=True)]


SCHEMA = "g string, x double, z double, y double"


def test_ols_like_numpy(spark):
    rows = data()
    got = {(t.g, t.term): t for t in r.ols(spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("b", 1.0, 1.0, None)], SCHEMA), ["g"], "y", ["x", "z"]).collect()}
    for g in "ab":
        m = np.array([[1, x, z] for k, x, z, _ in rows if k == g])
        y = np.array([v for k, *_, v in rows if k == g])
        b = np.linalg.lstsq(m, y, rcond=None)[0]
        left = ((y - m @ b) ** 2).sum()
        se = np.sqrt(left / (len(y) - 3) * np.diag(np.linalg.inv(m.T @ m)))
        for i, term in enumerate(("intercept", "x", "z")):
            t = got[g, term]
            assert (t.coef, t.se, t.n) == (pytest.approx(b[i], rel=1e-4), pytest.approx(se[i], rel=1e-4), len(y))
        assert got[g, "x"].r2 == pytest.approx(1 - left / ((y - y.mean()) ** 2).sum())
    assert got["a", "z"].p < 1e-6 < got["b", "z"].p


def test_incremental_and_odd_groups(spark):
    rows = data()
    frame = spark.createDataFrame([*rows, ("one", 1.0, 1.0, 1.0), ("flat", 1.0, 2.0, 5.0), ("flat", 2.0, 2.0, 5.0)], SCHEMA)
    got = {t.g: t for t in r.incremental(frame, ["g"], "y", ["x"], ["z"]).collect()}
    assert got["a"].gain > 10 * got["b"].gain and got["a"].p < 1e-6 < got["b"].p
    ols = {(t.g, t.term): t for t in r.ols(frame, ["g"], "y", ["x", "z"]).collect()}
    assert got["a"].f == pytest.approx(ols["a", "z"].t ** 2, rel=1e-6) and got["a"].p == pytest.approx(ols["a", "z"].p, rel=1e-6)
    assert got["one"].r2 is None and got["flat"].p is None
    assert r.ols(frame.where("false"), ["g"], "y", ["x"]).collect() == []
