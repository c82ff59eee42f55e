"""Studies: topics of questions, feature ablation, weather regressions."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.metrics import error_metrics


def topics(rows: DataFrame, text_col: str = "text", *, most: int = 12, per_topic: int = 6, seed: int = 7) -> DataFrame:
    """rows with topic: words and pairs of words weighted by TF-IDF (met in two texts at least), normalised, clustered by KMeans; k grows with the rows from 2 to `most`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover

    kept = rows.where(F.col(text_col).isNotNull())
    k = min(most, max(2, kept.count() // per_topic))
    steps = [
        RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), StopWordsRemover(inputCol="_w", outputCol="_s"), NGram(n=2, inputCol="_s", outputCol="_p"), SQLTransformer(statement="SELECT *, concat(_s, _p) AS _t FROM __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_c", minDF=2, vocabSize=1 << 14), IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="topic"),
    ]
    return Pipeline(stages=steps).fit(kept).transform(kept).select(*rows.columns, "topic")


def adopt_features(base: DataFrame, trial: DataFrame, *, gain: float = 0.01, slack: float = 0.03) -> DataFrame:
    """(venue, base_mase, trial_mase, gain, adopt): a feature set is adopted if the error falls by more than `gain` of it and coverage by at most `slack`; inputs: (venue, mase, coverage)."""
    j = base.select("venue", F.col("mase").alias("base_mase"), F.col("coverage").alias("_c")).join(trial.select("venue", F.col("mase").alias("trial_mase"), F.col("coverage").alias("_t")), "venue")
    g = (F.col("base_mase") - F.col("trial_mase")) / F.col("base_mase")
    return j.select("venue", "base_mase", "trial_mase", F.round(g, 6).alias("gain"), ((g > gain) & (F.col("_t") >= F.col("_c") - slack)).alias("adopt"))


def permutation_importance(scored: DataFrame, predict, features: list[str], seed: int = 7) -> DataFrame:
    """(feature, mae, rise): the error after a feature's values are dealt anew among rows.

    predict: DataFrame to DataFrame with yhat; scored: (row_id from 0 without gaps, y, features). Row i gets the value of row
    a * i + b modulo their number, a seeded number without a common divisor: a permutation that keeps no neighbours, by a join
    on one key and without an order of all rows.
    """
    spark = scored.sparkSession
    err = lambda df: error_metrics(predict(df).withColumn("_k", F.lit(0)), ["_k"]).first().mae
    base, n = err(scored), max(scored.count(), 1)
    draw, rows = random.Random(seed), []
    for f in features:  # a handful of features
        step = next((a for a in iter(lambda: draw.randrange(n), None) if math.gcd(a, n) == 1 and (n < 7 or 1 < a < n - 1)), 1)
        moved = scored.select(F.pmod(F.col("row_id") * step + draw.randrange(n), F.lit(n)).alias("row_id"), F.col(f).alias("_v"))
        mae = err(scored.join(moved, "row_id").withColumn(f, F.col("_v")).drop("_v"))
        rows.append((f, mae, mae - base))
    return spark.createDataFrame(rows, "feature string, mae double, rise double")


def incremental_fit(rows: DataFrame, target: str, base: list[str], more: list[str]) -> dict[str, float]:
    """R2 of a linear regression on `base`, with `more`, and the p-values of what was added."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    def fitted(columns: list[str]):
        v = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(rows)
        return LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(v).summary

    small, large = fitted(base), fitted(base + more)
    return {"r2_base": small.r2, "r2": large.r2, "gain": large.r2 - small.r2} | {f"p_{c}": p for c, p in zip(more, large.pValues[len(base) :], strict=False)}


def dry_wet_contrast(days: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(dow, n_dry, n_wet, dry, wet, ratio): mean value of dry and wet days by weekday."""
    wet = F.col("rain") >= threshold
    a, b = F.avg(F.when(~wet, F.col("value"))), F.avg(F.when(wet, F.col("value")))
    return days.groupBy(F.weekday("date").alias("dow")).agg(F.count_if(~wet).alias("n_dry"), F.count_if(wet).alias("n_wet"), F.round(a, 4).alias("dry"), F.round(b, 4).alias("wet"), F.round(b / F.nullif(a, F.lit(0.0)), 6).alias("ratio"))
