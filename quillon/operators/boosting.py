"""Gradient boosting with histograms, grown leaf by leaf, one model for each venue's fold.

A venue's fold is one group of some thousand days: its inputs are cut into bins once, gradients are summed by bin, and the
leaf whose split gains most is split next. Models of all venues and folds are fitted side by side, one task each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.calendar import is_bank_holiday, is_school_term
from quillon.functions.conventions import dow_monday
from quillon.operators.features import history_features

#: Trees, leaves of a tree, learning rate, rows of a leaf, penalty of a leaf's square, bins of an input (fixed values).
TREES, LEAVES, RATE, LEAF_ROWS, L2, BINS = 400, 31, 0.05, 10, 1.0, 255

LAGS = ["lag_7", "lag_14", "roll_mean_28", "roll_median_28"]
CALENDAR = ["dow", "month", "is_bank_holiday", "is_school_term"]


def cut_points(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where an input is cut: between all its values, or at quantiles if there are more than bins."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


@dataclass
class Tree:
    """Splits in the order in which they were made: (leaf split, input, cut); the right half gets the next number. values by leaf."""

    splits: list[tuple[int, int, float]] = field(default_factory=list)
    values: np.ndarray | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), dtype=np.int64)
        for k, (of, j, cut) in enumerate(self.splits, 1):
            leaf[(leaf == of) & (x[:, j] > cut)] = k
        return leaf


class _Bins:
    """Inputs as numbers of bins; the bins of all inputs stand one after the other."""

    def __init__(self, x: np.ndarray):
        self.cuts = [cut_points(x[:, j]) for j in range(x.shape[1])]
        sizes = np.array([len(c) + 1 for c in self.cuts])
        self.start = np.append(0, np.cumsum(sizes))
        self.flat = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) + self.start[:-1]
        self.owner = np.repeat(np.arange(x.shape[1]), sizes)
        self.ends = np.zeros(self.start[-1], dtype=bool)
        self.ends[self.start[1:] - 1] = True  # nothing lies right of an input's last bin

    def sums(self, rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = self.flat[rows].ravel(), self.start[-1]
        return np.bincount(at, minlength=size).astype(float), np.bincount(at, weights=np.repeat(g[rows], self.flat.shape[1]), minlength=size)

    def best(self, counts: np.ndarray, total: np.ndarray, leaf_rows: int, l2: float) -> tuple[float, int]:
        """The highest gain of a split, and the bin that is the last of its left half; gain 0 if none is allowed."""
        before = lambda x: np.cumsum(x) - np.append(0, np.cumsum(x))[self.start[:-1]][self.owner]
        n, s = before(counts), before(total)
        first = slice(self.start[0], self.start[1])
        all_n, all_s = counts[first].sum(), total[first].sum()
        ok = ~self.ends & (n >= leaf_rows) & (all_n - n >= leaf_rows)
        if not ok.any():
            return 0.0, -1
        gain = np.where(ok, s * s / (n + l2) + (all_s - s) ** 2 / (all_n - n + l2) - all_s * all_s / (all_n + l2), -np.inf)
        k = int(gain.argmax())
        return float(gain[k]), k


def grow(bins: _Bins, g: np.ndarray, *, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, l2: float = L2) -> tuple[Tree, np.ndarray]:
    """A tree fitted to g, and the leaf of every row. The larger half of a split has the sums of its parent less those of the smaller."""
    tree, leaf = Tree(), np.zeros(len(g), dtype=np.int64)
    rows = {0: np.arange(len(g))}
    sums = {0: bins.sums(rows[0], g)}
    found = {0: bins.best(*sums[0], leaf_rows, l2)}
    while len(rows) < leaves:
        of = max(found, key=lambda k: (found[k][0], -k))
        gain, at = found[of]
        if gain <= 1e-12:
            break
        j = int(bins.owner[at])
        right = bins.flat[rows[of], j] > at
        new, halves = len(rows), (rows[of][~right], rows[of][right])
        small = int(len(halves[1]) < len(halves[0]))
        part = bins.sums(halves[small], g)
        other = tuple(a - b for a, b in zip(sums[of], part, strict=True))
        for k, half in ((of, 0), (new, 1)):
            rows[k], sums[k] = halves[half], part if half == small else other
            found[k] = bins.best(*sums[k], leaf_rows, l2)
        leaf[halves[1]] = new
        tree.splits.append((of, j, float(bins.cuts[j][at - bins.start[j]])))
    tree.values = np.array([g[rows[k]].sum() / (len(rows[k]) + l2) for k in range(len(rows))])
    return tree, leaf


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    rate: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.values[t.leaves(x)]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, l2: float = L2) -> Boosted:
    """Least squares boosting: each tree is fitted to what those before it leave. It stops when no split gains."""
    model = Boosted(float(y.mean()) if len(y) else 0.0, [], rate)
    if not len(y):
        return model
    bins, at = _Bins(x), np.full(len(y), model.base)
    for _ in range(trees):
        tree, leaf = grow(bins, y - at, leaves=leaves, leaf_rows=leaf_rows, l2=l2)
        if not tree.splits:
            break
        at += rate * tree.values[leaf]
        model.trees.append(tree)
    return model


def _lagged(past: list[float]) -> list[float]:
    """The lags of the day after the values given, as history_features has them."""
    near = np.array(past[-28:])
    return [past[-7], past[-14], round(float(near.mean()), 6), round(float(np.median(near)), 6)]


def dealt(folds: DataFrame) -> DataFrame:
    """folds with each venue's fold in one partition: as many partitions as a shuffle has, for the work of a group says nothing of its bytes."""
    return folds.repartition(int(folds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "venue", "fold")


def boosted_by_venue(folds: DataFrame, *, trees: int = TREES, leaves: int = LEAVES) -> DataFrame:
    """(venue, fold, date, y, yhat): a model for each venue's fold over lags, rolling values, weekday, month, holidays and terms.

    Forecasts are recursive: a day's inputs hold the predictions of the days before it, at least 0. A fold with fewer than 28
    days of training repeats its mean.
    """
    rows = history_features(folds.where("role = 'train'"), ["venue", "fold"], "value").unionByName(folds.where("role = 'test'"), allowMissingColumns=True)
    d = F.col("date")
    rows = rows.withColumns({"dow": dow_monday("date"), "month": F.month(d), "is_bank_holiday": is_bank_holiday(d).cast("int"), "is_school_term": is_school_term(d).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        past = train["value"].astype(float).tolist()
        out = pd.DataFrame({"venue": test["venue"], "fold": test["fold"], "date": test["date"], "y": test["value"].astype(float)})
        if len(past) < 28:
            return out.assign(yhat=max(float(np.mean(past)) if past else 0.0, 0.0))
        known = train.dropna(subset=["lag_14", "roll_median_28"])
        model = fit(known[[*LAGS, *CALENDAR]].to_numpy(dtype=float), known["value"].to_numpy(dtype=float), trees=trees, leaves=leaves)
        for day in test[CALENDAR].to_numpy(dtype=float):
            past.append(max(float(model.predict(np.array([[*_lagged(past), *day]]))[0]), 0.0))
        return out.assign(yhat=past[len(past) - len(test) :])

    return dealt(rows).groupBy("venue", "fold").applyInPandas(run, "venue string, fold int, date date, y double, yhat double")
