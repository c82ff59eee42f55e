"""Errors of forecasts and intervals, conformal quantiles and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.conventions import order_statistic, safe_ratio


def mase_scale(train: DataFrame, keys: list[str], season: int = 7, value: str = "value") -> DataFrame:
    """(keys, scale): the mean of |y(t) - y(t - season)|; null if it is 0 or the series too short."""
    back = F.lag(value, season).over(Window.partitionBy(*keys).orderBy("date"))
    return train.withColumn("_d", F.abs(F.col(value) - back)).groupBy(*keys).agg(F.nullif(F.avg("_d"), F.lit(0.0)).alias("scale"))


def error_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """mae, rmse, smape (zero actuals left out) of (y, yhat); mase if a column scale is there. Rounded to 6 places."""
    e = F.abs(F.col("y") - F.col("yhat"))
    smape = F.avg(F.when(F.col("y") != 0, 200 * e / (F.abs("y") + F.abs("yhat"))))
    out = [F.count("*").alias("n"), F.round(F.avg(e), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(smape, 6).alias("smape")]
    if "scale" in scored.columns:
        out.append(F.round(safe_ratio(F.avg(e), F.first("scale")), 6).alias("mase"))
    return scored.groupBy(*keys).agg(*out)


def interval_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """coverage, width, winkler and pinball (mean of both ends) of (y, lo, hi, level)."""
    alpha = 1 - F.col("level")
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    winkler = hi - lo + F.when(y < lo, 2 / alpha * (lo - y)).when(y > hi, 2 / alpha * (y - hi)).otherwise(0.0)
    pinball = lambda q, p: F.greatest(p * (y - q), (p - 1) * (y - q))
    both = (pinball(lo, alpha / 2) + pinball(hi, 1 - alpha / 2)) / 2
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(y.between(lo, hi).cast("int")), 6).alias("coverage"), F.round(F.avg(hi - lo), 6).alias("width"), F.round(F.avg(winkler), 6).alias("winkler"), F.round(F.avg(both), 6).alias("pinball")
    )


def conformal_quantiles_at(scores: DataFrame, keys: list[str], levels: tuple[float, ...], score: str = "score") -> DataFrame:
    """(keys, level, n, q): the k-th least score with k = min(ceil((n + 1) * level), n), ranked once by windows, so that no group is gathered."""
    w = Window.partitionBy(*keys)
    ranked = scores.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("q"), F.row_number().over(w.orderBy(score)).alias("_r"), F.count("*").over(w).alias("n"))
    at = ranked.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
    return at.where(F.col("_r") == F.least(F.ceil((F.col("n") + 1) * F.col("level")), F.col("n"))).select(*keys, "level", "n", "q")


def conformal_quantiles(scores: DataFrame, keys: list[str], level: float, score: str = "score") -> DataFrame:
    """(keys, n, q) at one level."""
    return conformal_quantiles_at(scores, keys, (level,), score).drop("level")


def mondrian_quantiles(scores: DataFrame, keys: list[str], group: str, level: float) -> DataFrame:
    """Conformal quantiles by group; q_all is the one over all groups, for groups that have none."""
    own = conformal_quantiles(scores, [*keys, group], level)
    return own.join(conformal_quantiles(scores, keys, level).select(*keys, F.col("q").alias("q_all")), keys)


def online_bands(residuals: DataFrame, keys: list[str], level: float, *, block_days: int = 7, warm_up: int = 70) -> DataFrame:
    """Bands that only earlier blocks of days know: rows (keys, date, y, yhat) get block, q, lo and hi (at least 0); the first warm_up residuals get none.

    Each block is joined to the blocks before it; a key has days / block_days blocks.
    """
    first = Window.partitionBy(*keys)
    rows = residuals.withColumn("block", F.floor(F.datediff("date", F.min("date").over(first)) / block_days)).withColumn("score", F.abs(F.col("y") - F.col("yhat")))
    # a block's scores so far, kept as one sorted array per block: blocks are few, their arrays as long as the history
    per_block = rows.groupBy(*keys, "block").agg(F.collect_list("score").alias("s"))
    before = F.flatten(F.collect_list("s").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    q = per_block.select(*keys, "block", before.alias("past")).select(*keys, "block", F.when(F.size("past") >= warm_up, order_statistic(F.col("past"), level)).alias("q"))
    out = rows.join(q, [*keys, "block"]).where("q is not null")
    return out.withColumn("level", F.lit(level)).withColumn("lo", F.greatest(F.col("yhat") - F.col("q"), F.lit(0.0))).withColumn("hi", F.col("yhat") + F.col("q"))
