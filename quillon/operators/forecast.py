"""The forecast ladder: seasonal naive, robust weekday, exponential smoothing, decomposition, boosted trees; evaluation and reconciliation.

Sequential models run in applyInPandas for a venue's fold: a daily series of a few thousand rows. Everything about them
(folds, scores, selection, bands) is DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.calendar import is_bank_holiday
from quillon.functions.conventions import dow_monday, median, safe_ratio
from quillon.operators.boosting import boosted_by_venue, dealt
from quillon.operators.features import history_features
from quillon.operators.metrics import conformal_quantiles, conformal_quantiles_at, error_metrics, mase_scale
from quillon.operators.smoothing import smoothing_forecast, stl_forecast

FORECAST = "venue string, fold int, date date, y double, yhat double"
#: Rows of a partition of the pooled trees' training.
PIECE = 20_000


def seasonal_naive(folds: DataFrame, season: int = 7) -> DataFrame:
    """The value of the last day of training of the same weekday: the closed form of copying a week again and again."""
    train = folds.where("role = 'train'")
    end = train.groupBy("venue", "fold").agg(F.max("date").alias("_end"))
    test = folds.where("role = 'test'").join(end, ["venue", "fold"])
    back = F.date_sub("date", (season * F.ceil(F.datediff("date", "_end") / season)).cast("int"))
    past = train.select("venue", "fold", F.col("date").alias("_d"), F.col("value").alias("yhat"))
    return test.withColumn("_d", back).join(past, ["venue", "fold", "_d"]).select("venue", "fold", "date", F.col("value").alias("y"), "yhat")


def robust_weekday(folds: DataFrame, holiday: Callable[[Column], Column] = lambda d: F.lit(False)) -> DataFrame:
    """Weekday median times the month's index (clipped to 0.5 to 2) times the holiday factor (of three holidays or more; else 1)."""
    train = folds.where("role = 'train'").withColumns({"_dow": dow_monday("date"), "_m": F.month("date"), "_h": holiday(F.col("date"))})
    key = ["venue", "fold"]
    overall = train.groupBy(*key).agg(median("value").alias("overall"))
    dow = train.groupBy(*key, "_dow").agg(median("value").alias("dow"))
    index = train.groupBy(*key, "_m").agg(median("value").alias("m")).join(overall, key).select(*key, "_m", F.least(F.greatest(F.col("m") / F.greatest("overall", F.lit(1e-9)), F.lit(0.5)), F.lit(2.0)).alias("index"))
    ratio = train.where("_h").join(dow, [*key, "_dow"]).where("dow > 0").groupBy(*key).agg(F.count("*").alias("_n"), median(F.col("value") / F.col("dow")).alias("_f")).where("_n >= 3").select(*key, F.col("_f").alias("factor"))
    test = folds.where("role = 'test'").withColumns({"_dow": dow_monday("date"), "_m": F.month("date"), "_h": holiday(F.col("date"))})
    out = test.join(overall, key).join(dow, [*key, "_dow"], "left").join(index, [*key, "_m"], "left").join(ratio, key, "left")
    yhat = F.coalesce("dow", "overall") * F.coalesce("index", F.lit(1.0)) * F.when(F.col("_h"), F.coalesce("factor", F.lit(1.0))).otherwise(1.0)
    return out.select(*key, "date", F.col("value").alias("y"), yhat.alias("yhat"))


def grouped(folds: DataFrame, model: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """A sequential model on each venue's fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        test = pdf[pdf["role"] == "test"]
        got = model(pdf.loc[pdf["role"] == "train", "value"].to_numpy(dtype=float), len(test))
        return pd.DataFrame({"venue": test["venue"], "fold": test["fold"], "date": test["date"], "y": test["value"], "yhat": got})

    return dealt(folds).groupBy("venue", "fold").applyInPandas(run, FORECAST)


def _recent(values: Column) -> dict[str, Column]:
    """The inputs that history_features has for a day, from the array of up to 28 values before it (latest last)."""
    n, held = F.size(values), F.array_sort(values)
    middle = (F.try_element_at(held, F.ceil(n / 2).cast("int")) + F.try_element_at(held, (F.floor(n / 2) + 1).cast("int"))) / 2
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return {"lag_7": F.try_element_at(values, F.lit(-7)), "lag_14": F.try_element_at(values, F.lit(-14)), "roll_mean_28": F.when(n >= 7, F.round(mean, 6)), "roll_median_28": F.when(n >= 7, F.round(middle, 6))}


def boosted_trees(folds: DataFrame, *, trees: int = 20, depth: int = 4, rate: float = 0.1, horizon: int = 7) -> DataFrame:
    """Gradient-boosted trees (MLlib) over lags, rolling values, weekdays and the venue (one-hot), pooled over venues; one model a fold, cut at the fold's end.

    Forecasts are recursive: each day's inputs hold the predictions of the days before it, at least 0. A venue's fold is one
    row with its last 28 values, so that the days of the horizon are narrow steps without a shuffle. Trees are hundreds of
    small jobs, whose tasks are as many as their partitions: rows are dealt by their number, not by the partitions of a shuffle.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    from pyspark.util import inheritable_thread_target

    lags = ["lag_7", "lag_14", "roll_mean_28", "roll_median_28"]
    weekdays = lambda d: {f"d{i}": (dow_monday(d) == i).cast("double") for i in range(7)}
    train = folds.where("role = 'train'")
    rows = history_features(train, ["venue", "fold"], "value").withColumns(weekdays("date")).na.fill(0.0, lags)
    prepare = Pipeline(stages=[
        StringIndexer(inputCol="venue", outputCol="_venue_no", handleInvalid="keep"), OneHotEncoder(inputCol="_venue_no", outputCol="_venue_hot", dropLast=False), VectorAssembler(inputCols=[*lags, *(f"d{i}" for i in range(7)), "_venue_hot"], outputCol="x"),
    ]).fit(rows)
    ready = prepare.transform(rows).select("fold", "x", "value").repartition(train.count() // PIECE + 1)
    end = train.groupBy("venue", "fold").agg(F.max("date").alias("_end"))
    last = train.join(end, ["venue", "fold"]).where(F.datediff("_end", "date") < 28)
    start = last.groupBy("venue", "fold", "_end").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("_h"))  # 28 values
    start = start.select("venue", "fold", "_end", F.transform("_h", lambda x: x["value"].cast("double")).alias("_past"), F.array().cast("array<double>").alias("_path"))
    test = folds.where("role = 'test'").select("venue", "fold", "date", F.col("value").alias("y"))
    gbt = GBTRegressor(featuresCol="x", labelCol="value", predictionCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=7)
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())  # a handful of folds
    ready.persist()
    with ThreadPoolExecutor(max(1, min(len(numbers), 6))) as pool:  # trees are many small jobs: those of several folds share the cluster
        models = list(pool.map(inheritable_thread_target(folds.sparkSession)(lambda k: gbt.fit(ready.where(F.col("fold") == k))), numbers))
    ready.unpersist()
    out = None
    for fold, model in zip(numbers, models, strict=True):
        state = start.where(F.col("fold") == fold)
        for step in range(1, horizon + 1):
            inputs = state.withColumns(_recent(F.col("_past")) | weekdays(F.date_add("_end", step))).na.fill(0.0, lags)
            got = model.transform(prepare.transform(inputs)).withColumn("_y", F.greatest("_y", F.lit(0.0)))
            state = got.select("venue", "fold", "_end", F.concat(F.slice("_past", -27, 27), F.array("_y")).alias("_past"), F.concat("_path", F.array("_y")).alias("_path"))
        out = state if out is None else out.unionByName(state)
    days = out.select("venue", "fold", "_end", F.posexplode("_path").alias("_k", "yhat"))
    return days.select("venue", "fold", F.date_add("_end", F.col("_k") + 1).alias("date"), "yhat").join(test, ["venue", "fold", "date"]).select("venue", "fold", "date", "y", "yhat")


#: Rungs by name: the number of the rung, and the model. Models whose libraries are not installed are reported unavailable.
LADDER: dict[str, tuple[int, Callable[[DataFrame], DataFrame] | None]] = {
    "seasonal_naive": (0, seasonal_naive), "robust_weekday": (1, lambda f: robust_weekday(f, is_bank_holiday)), "holt_winters": (2, lambda f: grouped(f, smoothing_forecast)), "decomposed": (2, lambda f: grouped(f, stl_forecast)),
    "prophet": (2, None), "boosted_by_venue": (3, boosted_by_venue), "boosted_trees": (3, boosted_trees), "foundation": (4, None),
}


def evaluate(folds: DataFrame, models: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """(venue, model, fold, n, mae, rmse, smape, mase); a venue's models above its capped rung are left out."""
    scale = mase_scale(folds.where("role = 'train'"), ["venue", "fold"])
    out = None
    for name in models:
        rung, model = LADDER[name]
        if model is None:
            continue
        kept = folds.where(~F.col("venue").isin([v for v, cap in (caps or {}).items() if cap < rung]) if caps else F.lit(True))
        one = error_metrics(model(kept).join(scale, ["venue", "fold"]), ["venue", "fold"]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def select_best(scores: DataFrame, baselines: tuple[str, ...] = ("seasonal_naive", "robust_weekday")) -> DataFrame:
    """(venue, model, mean_mase, adopt): the least mean error by model (ties by name); adopt if it beats every baseline that was scored."""
    mean = scores.groupBy("venue", "model").agg(F.round(F.avg("mase"), 6).alias("mean_mase"))
    best = mean.groupBy("venue").agg(F.min(F.struct("mean_mase", "model")).alias("b"), F.min(F.when(F.col("model").isin(*baselines), F.col("mean_mase"))).alias("base"))
    return best.select("venue", "b.model", "b.mean_mase", (F.col("b.mean_mase") < F.col("base")).alias("adopt"))


def reconcile(nodes: DataFrame) -> DataFrame:
    """(venue, date, node, yhat, coherent): minimum-trace reconciliation with diagonal weights, per venue and day.

    nodes: (venue, date, node, parent, yhat, variance); leaves are nodes that are nobody's parent. A hierarchy has some dozens of nodes.
    The ridge is a millionth of the weights' own size (of one, where they are larger): a fixed one would outweigh the weights of
    large amounts of money, and draw all forecasts to 0.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        names, parent = pdf["node"].tolist(), dict(zip(pdf["node"], pdf["parent"], strict=True))
        leaves = [n for n in names if n not in set(pdf["parent"].dropna())]
        at = {n: i for i, n in enumerate(names)}
        s = np.zeros((len(names), len(leaves)))
        for j, leaf in enumerate(leaves):
            n = leaf
            while n is not None and n in at:
                s[at[n], j] = 1
                n = parent.get(n)
        w = 1 / np.maximum(pdf["variance"].to_numpy(dtype=float), 1e-6)
        a = s.T @ (w[:, None] * s)
        ridge = 1e-6 * min(1.0, float(np.trace(a)) / len(leaves))
        bottom = np.linalg.solve(a + ridge * np.eye(len(leaves)), s.T @ (w * pdf["yhat"].to_numpy(dtype=float)))
        return pd.DataFrame({"venue": pdf["venue"], "date": pdf["date"], "node": names, "yhat": pdf["yhat"], "coherent": s @ bottom})

    return nodes.groupBy("venue", "date").applyInPandas(solve, "venue string, date date, node string, yhat double, coherent double")


def weekday_base(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dow, yhat, variance): weekday medians and the population variance of what they leave."""
    d = series.withColumn("dow", dow_monday("date"))
    m = d.groupBy(*keys, "dow").agg(median("value").alias("yhat"))
    v = d.join(m, [*keys, "dow"]).groupBy(*keys).agg(F.var_pop(F.col("value") - F.col("yhat")).alias("variance"))
    return m.join(v, keys)


def node_bands(series: DataFrame, levels: tuple[float, ...] = (0.8, 0.9), test_weeks: int = 8) -> tuple[DataFrame, DataFrame]:
    """Bands of a hierarchy's nodes, (venue, node, level, n, q), and the coherent forecasts they belong to, (venue, node, date, value, yhat, coherent).

    series: (venue, node, parent, date, value). Training ends test_weeks before the venue's last day. A node's score is its
    distance from its own weekday median in training; VENUE has no band of its own here.
    """
    edge = series.groupBy("venue").agg(F.date_sub(F.max("date"), 7 * test_weeks).alias("_edge"))
    rows = series.join(edge, "venue").withColumns({"dow": dow_monday("date"), "_train": F.col("date") < F.col("_edge")}).drop("_edge")
    train, keys = rows.where("_train"), ["venue", "node"]
    middle = train.groupBy(*keys, "dow").agg(median("value").alias("yhat"))
    left = train.join(middle, [*keys, "dow"]).withColumn("score", F.abs(F.col("value") - F.col("yhat")))
    scores = left.where("node <> 'VENUE'").select(*keys, "score")
    quantiles = conformal_quantiles_at(scores, keys, levels)
    variance = left.groupBy(*keys).agg(F.var_pop(F.col("value") - F.col("yhat")).alias("variance"))
    test = rows.where("not _train").join(middle, [*keys, "dow"]).join(variance, keys)
    coherent = reconcile(test.select("venue", "date", "node", "parent", "yhat", "variance"))
    return quantiles, test.select(*keys, "date", "value").join(coherent, [*keys, "date"])


def node_coverage(quantiles: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(venue, kind, level, n, n_no_width, coverage): n_no_width counts days whose band has no width, as of nodes that mostly sell nothing; the share of test days inside the band, pooled over category nodes (L2) and over item nodes without OTHER (L3)."""
    kind = F.when(F.col("node").startswith("CAT::"), "L2").when(F.col("node").startswith("ITEM::") & ~F.col("node").endswith("::OTHER"), "L3")
    rows = forecasts.join(quantiles, ["venue", "node"]).withColumn("kind", kind).where("kind is not null")
    inside = F.col("value").between(F.greatest(F.col("coherent") - F.col("q"), F.lit(0.0)), F.col("coherent") + F.col("q"))
    return rows.groupBy("venue", "kind", "level").agg(F.count("*").alias("n"), F.count_if(F.col("q") <= 0).alias("n_no_width"), F.round(F.avg(inside.cast("int")), 6).alias("coverage"))


def standby_band(series: DataFrame, residuals: DataFrame, closed: DataFrame, *, level: float = 0.9, days: int = 28) -> DataFrame:
    """(venue, date, yhat, level, lo, hi): for closed venues, a band for the days after their last active one, ready for reopening.

    series and residuals (venue, date, score) end with the active span; yhat is the weekday's median, the quantile that of the
    weekday's regime (Monday and Tuesday, or the rest), or of all residuals where the regime has none.
    """
    own = series.join(closed.select("venue"), "venue", "left_semi").withColumn("dow", dow_monday("date"))
    base = own.groupBy("venue", "dow").agg(median("value").alias("yhat"))
    regime = lambda d: F.when(d <= 1, "Mon-Tue").otherwise("rest")
    scored = residuals.join(closed.select("venue"), "venue", "left_semi").withColumn("regime", regime(dow_monday("date")))
    q = conformal_quantiles(scored, ["venue", "regime"], level).select("venue", "regime", "q")
    q_all = conformal_quantiles(scored, ["venue"], level).select("venue", F.col("q").alias("q_all"))
    ahead = own.groupBy("venue").agg(F.max("date").alias("_b")).select("venue", F.explode(F.sequence(F.date_add("_b", 1), F.date_add("_b", days))).alias("date")).withColumn("dow", dow_monday("date"))
    rows = ahead.join(base, ["venue", "dow"]).withColumn("regime", regime(F.col("dow"))).join(q, ["venue", "regime"], "left").join(q_all, "venue")
    y, w = F.greatest("yhat", F.lit(0.0)), F.coalesce("q", "q_all")
    return rows.select("venue", "date", y.alias("yhat"), F.lit(level).alias("level"), F.greatest(y - w, F.lit(0.0)).alias("lo"), (y + w).alias("hi"))


def leave_one_out_transfer(series: DataFrame, days: tuple[int, ...] = (14, 21, 28, 42, 56), season: int = 7) -> DataFrame:
    """(venue, history, n, anchor, mase_transfer, mase_naive, wins) of a venue's days after its first `history` active ones.

    The transfer is the mean of those first days times the donors' weekday shape (each donor's own mean taken out first); the
    naive forecast repeats the last week of them. Both are scaled by the season's differences in the first days; rows without
    such a scale are null. series: (venue, date, value), dense.
    """
    d = series.withColumn("dow", dow_monday("date"))
    shape = d.groupBy("venue", "dow").agg(F.avg("value").alias("m"))
    unit = shape.join(shape.groupBy("venue").agg(F.avg("m").alias("mean")).where("mean > 0"), "venue").select(F.col("venue").alias("donor"), "dow", (F.col("m") / F.col("mean")).alias("s"))
    # donors are all venues but one: what all give, less the venue's own part (seven rows a venue, no pairs)
    whole = unit.groupBy("dow").agg(F.sum("s").alias("_s"), F.count("*").alias("_n"))
    grid = d.select("venue").distinct().crossJoin(F.broadcast(whole))  # seven rows
    rest = grid.join(unit.withColumnRenamed("donor", "venue"), ["venue", "dow"], "left").select("venue", "dow", safe_ratio(F.col("_s") - F.coalesce("s", F.lit(0.0)), F.col("_n") - F.col("s").isNotNull().cast("int")).alias("p"))
    donors = rest.join(rest.groupBy("venue").agg(F.avg("p").alias("k")), "venue").select("venue", "dow", (F.col("p") / F.col("k")).alias("shape"))
    span = d.where("value > 0").groupBy("venue").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    active = d.join(span, "venue").where("date between _a and _b").withColumn("t", F.datediff("date", "_a")).drop("_a", "_b")
    cases = active.select("*", F.explode(F.array(*(F.lit(x) for x in days))).alias("history"))
    cold, test, keys = cases.where("t < history"), cases.where("t >= history"), ["venue", "history"]
    level = cold.groupBy(*keys).agg(F.avg("value").alias("anchor")).join(mase_scale(cold, keys, season), keys)
    week = cold.where(F.col("t") >= F.col("history") - season).select(*keys, "dow", F.col("value").alias("naive"))
    scored = test.join(level, keys).join(donors, ["venue", "dow"], "left").join(week, [*keys, "dow"])
    error = lambda yhat: F.round(F.avg(F.abs(F.col("value") - yhat)) / F.first("scale"), 6)
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.first("anchor"), 1).alias("anchor"), error(F.col("anchor") * F.coalesce("shape", F.lit(1.0))).alias("mase_transfer"), error(F.col("naive")).alias("mase_naive"))
    return out.withColumn("wins", F.col("mase_transfer") < F.col("mase_naive"))
