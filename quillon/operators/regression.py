"""Ordinary least squares for every group at once: one pass sums products, and each group's few numbers are then solved.

What is shuffled is a row of (columns + 2)^2 / 2 sums for each group and task; no group's rows are gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def p_of_t(t: float, df: float) -> float:
    """Two-sided."""
    return beta_share(df / (df + t * t), df / 2, 0.5) if df > 0 else math.nan


def p_of_f(f: float, df1: float, df2: float) -> float:
    return beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if df2 > 0 and f >= 0 else math.nan


def _grams(rows: DataFrame, keys: list[str], target: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Sums of products of 1, columns and target by group, over rows without a null among them. Values are taken from each group's first mean, so that sums lose no digits."""
    names = [*columns, target]
    whole = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).na.drop(subset=names)
    middle = whole.groupBy(*keys).agg(*(F.avg(c).alias(f"_m_{c}") for c in names))
    near = whole.join(middle, keys).select(*keys, *(F.col(f"_m_{c}") for c in names), *((F.col(c) - F.col(f"_m_{c}")).alias(c) for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = near.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(f"_m_{c}").alias(f"_m_{c}") for c in names), *(F.sum(F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in pairs))
    return sums, names


def _fit(row: pd.Series, names: list[str], used: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Slopes, the inverse of their centred products, residual and total squares, and the rank of a fit on some of the columns."""
    at = lambda a, b: row[f"_{a}_{b}"] if f"_{a}_{b}" in row else row[f"_{b}_{a}"]
    gram = np.array([[at(a, b) for b in used] for a in used]).reshape(len(used), len(used))
    cross = np.array([at(a, target) for a in used])
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale) if used else gram
    slope = inverse @ cross
    total = float(at(target, target))
    rank = int(np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10, hermitian=True)) if used else 0
    return slope, inverse, max(total - float(cross @ slope), 0.0), total, rank


def ols(rows: DataFrame, keys: list[str], target: str, columns: list[str]) -> DataFrame:
    """(keys, term, coef, se, t, p, r2, n): a regression with an intercept for every group; terms are the columns and "intercept".

    Rows with a null in target or columns are left out. Columns that depend on others share a slope (the least in length).
    What too few rows can't tell is null.
    """
    sums, names = _grams(rows, keys, target, columns)

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for _, row in pdf.iterrows():
                slope, inverse, left, total, rank = _fit(row, names, columns, target)
                n = int(row["_n"])
                df = n - rank - 1
                noise = left / df if df > 0 else math.nan
                middle = np.array([row[f"_m_{c}"] for c in columns])
                terms = [("intercept", row[f"_m_{target}"] - middle @ slope, math.sqrt(noise * (1 / n + middle @ inverse @ middle)) if df > 0 else math.nan)]
                terms += [(c, b, math.sqrt(max(noise * inverse[i, i], 0.0)) if df > 0 else math.nan) for i, (c, b) in enumerate(zip(columns, slope, strict=True))]
                for name, coef, se in terms:
                    t = coef / se if se and se > 0 else math.nan
                    out.append((*(row[k] for k in keys), name, coef, se, t, p_of_t(t, df) if t == t else math.nan, 1 - left / total if total > 0 else math.nan, n))
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "se", "t", "p", "r2", "n"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds}, term string, coef double, se double, t double, p double, r2 double, n long")


def incremental(rows: DataFrame, keys: list[str], target: str, base: list[str], more: list[str]) -> DataFrame:
    """(keys, n, r2_base, r2, gain, f, p): what `more` columns add to `base` ones in every group, and the F-test of it (null where too few rows are left). Both fits come from the same sums."""
    sums, names = _grams(rows, keys, target, [*base, *more])

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for _, row in pdf.iterrows():
                _, _, left_base, total, rank_base = _fit(row, names, base, target)
                _, _, left, _, rank = _fit(row, names, [*base, *more], target)
                n, added = int(row["_n"]), rank - rank_base
                df = n - rank - 1
                f = (left_base - left) / added / (left / df) if added > 0 and df > 0 and left > 0 else math.nan
                r2 = [1 - x / total if total > 0 else math.nan for x in (left_base, left)]
                out.append((*(row[k] for k in keys), n, r2[0], r2[1], r2[1] - r2[0], f, p_of_f(f, added, df) if f == f else math.nan))
            yield pd.DataFrame(out, columns=[*keys, "n", "r2_base", "r2", "gain", "f", "p"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kinds}, n long, r2_base double, r2 double, gain double, f double, p double")
