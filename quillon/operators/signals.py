"""Signals over daily series: residual streams, deviations, change-points and their causes, stock cover, checklists, briefings."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.conventions import safe_ratio

#: Warm-up and level of the residual stream; detector constants; attribution window and weights by kind of cause.
WARM_UP, LEVEL, MIN_SPAN = 56, 0.90, 90
RUN_M, RUN_N = 4, 7
CUSUM_K, CUSUM_H, HAZARD, RELEARN = 0.5, 5.0, 1 / 60, 28
ATTRIBUTION_DAYS = 7
CAUSE_WEIGHTS = {"closure": 100, "price": 90, "weather": 70, "uni": 65, "school": 60, "event": 55, "promo": 50, "stock-out": 45}
#: Fixed values of the briefing.
SOURCE_WEIGHT = {"change_point": 1.0, "stock": 0.85, "deviation": 0.6, "checklist": 0.4, "sop": 0.35}
SEVERITY_WEIGHT = {"critical": 1.5, "high": 1.5, "medium": 1.0, "low": 0.6, "ok": 0.0}
NOVELTY = {"new": 1.25, "continuing": 0.8, "resolved": 0.5}
SOURCE_RANK = {"change_point": 5, "stock": 4, "deviation": 3, "checklist": 2, "sop": 1}
#: A cluster's head: a sales move absorbs a stock flag; sources without a rank here compete by severity alone.
HEAD_RANK = {"change_point": 3, "deviation": 2, "stock": 1}
SPARSE_TRUST, RECENCY_DAYS = 0.5, 14
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "ok": 0}


def _lookup(c: Column, values: dict[str, float], default: float | None = None) -> Column:
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(c == k, float(v)).otherwise(out)
    return out


def residual_stream(series: DataFrame, *, level: float = LEVEL, warm_up: int = WARM_UP) -> DataFrame:
    """(venue, date, actual, expected, scale, z): each day against the weekday median of all days before it.

    scale is the conformal quantile of all earlier days' distances from today's medians; days whose expectation is not
    positive are left out. Every venue's series is one task's work; a series has a few thousand days. A day changes one
    weekday's median only, so that only this weekday's distances are computed anew.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        v, dow, dates = pdf["value"].to_numpy(dtype=float), pd.to_datetime(pdf["date"]).dt.dayofweek.to_numpy(), pdf["date"].tolist()
        held: list[list[float]] = [[] for _ in range(7)]
        every: list[float] = []
        places = [np.flatnonzero(dow == d) for d in range(7)]
        off, rows = np.zeros(len(v)), []
        middle = lambda x: x[len(x) // 2] if len(x) % 2 else (x[len(x) // 2 - 1] + x[len(x) // 2]) / 2
        for i, (x, d) in enumerate(zip(v.tolist(), dow.tolist(), strict=True)):
            if i >= warm_up:
                expected = middle(held[d] or every)
                if expected > 1e-6:
                    k = min(math.ceil((i + 1) * level), i)
                    scale = max(float(np.partition(off[:i], k - 1)[k - 1]), 1e-6)
                    rows.append((pdf["venue"].iloc[0], dates[i], x, expected, scale, (x - expected) / scale))
            insort(held[d], x)
            insort(every, x)
            own = places[d][: len(held[d])]
            off[own] = np.abs(v[own] - middle(held[d]))
        return pd.DataFrame(rows, columns=["venue", "date", "actual", "expected", "scale", "z"])

    return series.groupBy("venue").applyInPandas(run, "venue string, date date, actual double, expected double, scale double, z double")


def deviations(stream: DataFrame, *, band: float = 1.0, severe: float = 2.0) -> DataFrame:
    """stream with status, direction and severity (null on a normal day) by z in units of the band."""
    a = F.abs("z")
    return stream.withColumns({
        "status": F.when(a <= band, "normal").otherwise("deviation"), "direction": F.when(F.col("z") > 0, "up").otherwise("down"),
        "severity": F.when(a > severe, "high").when(a > band, "medium"),
    })


def scan(stream: DataFrame, window: int = 14) -> DataFrame:
    """The last rows of each venue's stream."""
    return stream.withColumn("_r", F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("date")))).where(F.col("_r") <= window).drop("_r")


def cusum(stream: DataFrame, *, k: float = CUSUM_K, h: float = CUSUM_H) -> DataFrame:
    """(venue, alarm, onset, direction, stat): two-sided CUSUM with reset; onset is the first row since the statistic last stood at 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        dates, rows = pdf["date"].tolist(), []
        up = down = 0.0
        from_up = from_down = 0
        for i, z in enumerate(pdf["z"].tolist()):
            if up == 0:
                from_up = i
            if down == 0:
                from_down = i
            up, down = max(0.0, up + z - k), max(0.0, down - z - k)
            if up > h or down > h:
                rows.append((pdf["venue"].iloc[0], dates[i], dates[from_up if up > h else from_down], "up" if up > h else "down", up if up > h else down))
                up = down = 0.0
        return pd.DataFrame(rows, columns=["venue", "alarm", "onset", "direction", "stat"])

    return stream.groupBy("venue").applyInPandas(run, "venue string, alarm date, onset date, direction string, stat double")


def persistence(stream: DataFrame, *, m: int = RUN_M, n: int = RUN_N, at: float = 1.0) -> DataFrame:
    """(venue, alarm, onset, direction, count): every row with m or more of the last n rows beyond the threshold on one side.

    The row itself need not be one of them; the first n - 1 rows have no full window and give no alarm. onset is the first
    such row of the window, count their number. Where both sides qualify, up is reported.
    """
    by = Window.partitionBy("venue").orderBy("date")
    w = by.rowsBetween(-(n - 1), 0)
    up, down = F.col("z") > at, F.col("z") < -at
    seen = stream.select(
        "venue", F.col("date").alias("alarm"), F.row_number().over(by).alias("_i"), F.count_if(up).over(w).alias("_up"), F.count_if(down).over(w).alias("_down"),
        F.min(F.when(up, F.col("date"))).over(w).alias("_u"), F.min(F.when(down, F.col("date"))).over(w).alias("_d"),
    ).where((F.col("_i") >= n) & (F.greatest("_up", "_down") >= m))
    first = F.col("_up") >= m
    return seen.select("venue", "alarm", F.when(first, F.col("_u")).otherwise(F.col("_d")).alias("onset"), F.when(first, "up").otherwise("down").alias("direction"), F.when(first, F.col("_up")).otherwise(F.col("_down")).alias("count"))


def run_lengths(stream: DataFrame, *, hazard: float = HAZARD) -> DataFrame:
    """(venue, date, run, p_change, p_reset): the likeliest run length and the chances that the run began within the last week and today, by Bayesian online change-point detection (normal-inverse-gamma prior).

    All run lengths are kept: the state of a venue has a cell for each of its rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mu, kappa, alpha, beta, p = np.zeros(1), np.ones(1), np.ones(1), np.ones(1), np.ones(1)
        rows = []
        gammas = np.array([math.lgamma((k + 3) / 2) - math.lgamma((k + 2) / 2) for k in range(len(pdf))])  # alpha is 1 + run / 2
        for date, x in zip(pdf["date"].tolist(), pdf["z"].tolist(), strict=True):
            df, s2 = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            like = np.exp(gammas[: len(p)] - 0.5 * np.log(np.pi * df * s2) - (df + 1) / 2 * np.log1p((x - mu) ** 2 / (df * s2)))
            grown = p * like * (1 - hazard)
            p = np.concatenate([[(p * like * hazard).sum()], grown])
            p /= p.sum()
            mu, kappa, alpha, beta = (np.concatenate([[a], b]) for a, b in ((0.0, (kappa * mu + x) / (kappa + 1)), (1.0, kappa + 1), (1.0, alpha + 0.5), (1.0, beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1)))))
            rows.append((pdf["venue"].iloc[0], date, int(p.argmax()), float(p[:8].sum()), float(p[0])))
        return pd.DataFrame(rows, columns=["venue", "date", "run", "p_change", "p_reset"])

    return stream.groupBy("venue").applyInPandas(run, "venue string, date date, run int, p_change double, p_reset double")


def change_points(stream: DataFrame, spans: DataFrame, *, event_only: tuple[str, ...] = (), reset: bool = True) -> DataFrame:
    """A row for each onset: (venue, onset, alarm, delay, detector, direction, magnitude, percent, count, stat, p_reset, severity, is_closure).

    Alarms are merged by onset alone. The first alarm (CUSUM before persistence) gives the direction and p_reset, the
    earliest one the date; detector is "both" where both saw it; count and stat are those of the first alarm of their
    detector. magnitude is the mean z from onset to alarm: a difference of two running sums, so that no range is joined.
    Venues with less than MIN_SPAN - WARM_UP days give nothing, except event-only ones, which persistence alone watches. In a
    closed venue the first fall from a week before its last active day on is the closure; later falls are left out.
    p_reset takes the run lengths of every day, whose cost grows with the square of a venue's days; without reset it is null.
    """
    enough = stream.groupBy("venue").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_SPAN - WARM_UP) | F.col("venue").isin(*event_only)).select("venue")
    stream = stream.join(enough, "venue")
    none = F.lit(None)
    seen = cusum(stream.where(~F.col("venue").isin(*event_only))).select("*", none.cast("long").alias("count"), F.lit(0).alias("by"))
    seen = seen.unionByName(persistence(stream).select("*", none.cast("double").alias("stat"), F.lit(1).alias("by")))
    first = F.struct("by", "alarm")
    merged = seen.groupBy("venue", "onset").agg(
        F.min_by("direction", first).alias("direction"), F.min_by("alarm", first).alias("_seen"), F.min("alarm").alias("alarm"),
        F.when(F.countDistinct("by") > 1, "both").otherwise(F.when(F.min("by") == 0, "cusum").otherwise("persistence")).alias("detector"),
        F.min_by("count", F.when(F.col("by") == 1, F.col("alarm"))).alias("count"), F.min_by("stat", F.when(F.col("by") == 0, F.col("alarm"))).alias("stat"),
    )
    by = Window.partitionBy("venue").orderBy("date")
    sums = stream.select("venue", "date", "z", "expected", "scale", F.row_number().over(by).alias("i"), F.sum("z").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    start = sums.select("venue", F.col("date").alias("onset"), (F.col("c") - F.col("z")).alias("c0"), F.col("i").alias("i0"), "expected", "scale")
    end = sums.select("venue", F.col("date").alias("alarm"), F.col("c").alias("c1"), F.col("i").alias("i1"))
    out = merged.join(start, ["venue", "onset"]).join(end, ["venue", "alarm"])
    if reset:
        out = out.join(run_lengths(stream).select("venue", F.col("date").alias("_seen"), F.round("p_reset", 3).alias("p_reset")), ["venue", "_seen"])
    else:
        out = out.withColumn("p_reset", F.lit(None).cast("double"))
    out = out.withColumn("magnitude", (F.col("c1") - F.col("c0")) / (F.col("i1") - F.col("i0") + 1))
    closing = out.join(spans.where("is_closed").select("venue", "last_active"), "venue").where((F.col("direction") == "down") & (F.col("onset") >= F.date_sub("last_active", RUN_N))).groupBy("venue").agg(F.min("onset").alias("_closure"))
    kept = out.join(closing, "venue", "left").where(F.col("_closure").isNull() | (F.col("direction") != "down") | (F.col("onset") <= F.col("_closure")))
    a, n = F.abs("magnitude"), F.coalesce("count", F.lit(0))
    severity = F.when((a > 1.5) | (n >= 6), "high").when((a > 0.8) | (n >= RUN_M), "medium").otherwise("low")
    percent = F.when(F.col("expected") > 1e-6, F.round(F.col("magnitude") * F.col("scale") / F.col("expected") * 100, 1))
    return kept.select(
        "venue", "onset", "alarm", F.datediff("alarm", "onset").alias("delay"), "detector", "direction", F.round("magnitude", 3).alias("magnitude"), percent.alias("percent"),
        "count", F.round("stat", 2).alias("stat"), "p_reset", severity.alias("severity"), F.coalesce(F.col("_closure") == F.col("onset"), F.lit(False)).alias("is_closure"),
    )


def attribute(points: DataFrame, causes: DataFrame, days: int = ATTRIBUTION_DAYS) -> DataFrame:
    """points with causes: (kind, label, weight) of calendar facts (venue or null, date, kind, label) within `days` of the onset, the weightiest first.

    The range join runs as an equi-join: every cause is copied to the 2 * days + 1 onsets that it can explain.
    """
    near = causes.select(F.col("venue").alias("_v"), F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("onset"), "kind", "label", _lookup(F.col("kind"), CAUSE_WEIGHTS, 0.0).alias("weight"))
    hit = points.select("venue", "onset", "direction").join(near, "onset").where(F.col("_v").isNull() | (F.col("_v") == F.col("venue")))
    best = hit.groupBy("venue", "onset", "direction").agg(F.array_sort(F.collect_set(F.struct((-F.col("weight")).alias("w"), "kind", "label"))).alias("c"))
    listed = F.transform("c", lambda x: F.concat_ws(":", x["kind"], x["label"]))
    return points.join(best.select("venue", "onset", "direction", listed.alias("causes")), ["venue", "onset", "direction"], "left").withColumn("causes", F.coalesce("causes", F.array().cast("array<string>")))


def simulate_detector(spark, shifts: list[float], sims: int = 200, length: int = 300, change_at: int = 100, seed: int = 7) -> DataFrame:
    """(shift, detected, mean_delay, mean_run): CUSUM on seeded noise; for shift 0 mean_run is the run length to a false alarm. Simulations are dealt over the cluster."""

    def run(batches):
        for pdf in batches:
            rows = []
            for shift, i in zip(pdf["shift"], pdf["i"], strict=True):
                z = np.random.default_rng(seed * 1_000_003 + int(i)).normal(size=length)
                z[change_at:] += shift
                up = down = 0.0
                at = -1
                for t in range(0 if shift == 0 else change_at, length):
                    up, down = max(0.0, up + z[t] - CUSUM_K), max(0.0, down - z[t] - CUSUM_K)
                    if up > CUSUM_H or down > CUSUM_H:
                        at = t
                        break
                rows.append((shift, at))
            yield pd.DataFrame(rows, columns=["shift", "at"])

    grid = spark.range(sims).select(F.explode(F.array(*(F.lit(float(s)) for s in shifts))).alias("shift"), F.col("id").alias("i"))
    found = grid.mapInPandas(run, "shift double, at int")
    hit = F.col("at") >= 0
    return found.groupBy("shift").agg(F.avg(hit.cast("double")).alias("detected"), F.avg(F.when(hit, F.col("at") - change_at)).alias("mean_delay"), F.avg(F.when(hit, F.col("at")).otherwise(length)).alias("mean_run"))


def days_of_cover(stock: DataFrame, daily: DataFrame, *, lead: int = 3, safety: int = 2, cycle: int = 7) -> DataFrame:
    """stock (product, kegs, pints_per_keg) with daily demand: on_hand, days, reorder and order. Products without a demand keep null cover."""
    s = stock.join(daily.select("product", "daily_pints"), "product", "left").withColumn("on_hand", F.col("kegs") * F.col("pints_per_keg"))
    days = F.when(F.col("daily_pints") > 0, F.col("on_hand") / F.col("daily_pints"))
    need = F.greatest(F.lit(0.0), F.ceil((F.col("daily_pints") * (lead + safety + cycle) - F.col("on_hand")) / F.col("pints_per_keg")))
    return s.select("*", F.round(days, 6).alias("days"), (days < lead + safety).alias("reorder"), F.when(F.col("daily_pints") > 0, need).cast("long").alias("order_kegs"))


def checklist(steps: DataFrame, done: DataFrame, *, sunday: bool = False) -> DataFrame:
    """(n_steps, n_missed, missed_weight, n_critical, unsigned, skipped, severity): skipped if under a fifth is done."""
    wanted = steps if sunday else steps.where("not sunday_only")
    missed = wanted.join(done.select("number").distinct(), "number", "left_anti")
    m = missed.agg(F.count("*").alias("n_missed"), F.coalesce(F.sum("weight"), F.lit(0)).alias("missed_weight"), F.count_if(F.col("weight") >= 5).alias("n_critical"), F.count_if("is_signoff").alias("unsigned"))
    both = wanted.agg(F.count("*").alias("n_steps")).crossJoin(m)  # one row each
    skipped = F.coalesce(F.col("n_steps") - F.col("n_missed") < 0.2 * F.col("n_steps"), F.lit(False))
    return both.withColumn("skipped", skipped).withColumn("severity", F.when(F.col("skipped") | (F.col("n_critical") >= 2), "high").when((F.col("n_critical") == 1) | (F.col("missed_weight") >= 6), "medium").when(F.col("n_missed") > 0, "low").otherwise("ok"))


def clusters(signals: DataFrame, gap_days: int = 7) -> DataFrame:
    """signals (venue, source, onset, direction, severity, magnitude) with cluster: numbers within a venue and direction; a new one where the gap to the previous member is longer."""
    w = Window.partitionBy("venue", "direction").orderBy("onset", "source")
    opens = F.coalesce(F.datediff("onset", F.lag("onset").over(w)) > gap_days, F.lit(True))
    return signals.withColumn("_o", opens.cast("int")).withColumn("cluster", F.sum("_o").over(w)).drop("_o")


def briefing_items(clustered: DataFrame, today: str, prior: DataFrame | None = None, *, event_only: tuple[str, ...] = ()) -> DataFrame:
    """(item_key, venue, direction, source, severity, onset, n_evidence, trust, caveats, status, score), the best first.

    A cluster's head is a change-point, else a deviation (which absorbs a stock flag), else a stock flag, else whatever is
    severest; among equals the severest, then the latest. The rest is evidence. A single deviation of an event-only venue
    has half the trust, for its band is narrow. prior (item_key, score): items not met again are resolved with half their
    score; score 0 is left out.
    """
    rank = F.struct(_lookup(F.col("source"), HEAD_RANK, 0).alias("s"), _lookup(F.col("severity"), SEVERITY_RANK, 0).alias("v"), "onset", "source")
    head = clustered.groupBy("venue", "direction", "cluster").agg(
        F.max_by(F.struct("source", "severity", "onset"), rank).alias("h"), F.count("*").alias("n"), F.count_if(F.col("source") == "deviation").alias("_dev"), F.count_if(F.col("source") == "stock").alias("_stock")
    )
    items = head.select(F.concat_ws(":", "venue", "direction", F.col("h.onset").cast("string"), "h.source").alias("item_key"), "venue", "direction", "h.*", (F.col("n") - 1).alias("n_evidence"), "_dev", "_stock")
    sparse = F.col("venue").isin(*event_only) & (F.col("source") == "deviation") & (F.col("_dev") == 1)
    to_order = (F.col("_stock") > 0) & (F.col("source") != "stock")
    items = items.withColumn("trust", F.when(sparse, SPARSE_TRUST).otherwise(1.0)).withColumn("caveats", F.array_compact(F.array(F.when(sparse, "small-sample"), F.when(to_order, "action: reorder"))))
    empty = clustered.sparkSession.createDataFrame([], "item_key string, score double")
    before = (empty if prior is None else prior).select("item_key", F.col("score").alias("_prior"), F.lit(True).alias("_was"))
    both = items.withColumn("_is", F.lit(True)).join(before, "item_key", "full")
    status = F.when(F.col("_is").isNull(), "resolved").when(F.col("_was").isNull(), "new").otherwise("continuing")
    age = F.datediff(F.lit(today).cast("date"), F.col("onset"))
    recency = F.when(age <= 0, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - 0.5 * age / RECENCY_DAYS))
    s = both.withColumn("status", status)
    score = _lookup(F.col("source"), SOURCE_WEIGHT, 0) * _lookup(F.col("severity"), SEVERITY_WEIGHT, 0) * recency * _lookup(F.col("status"), NOVELTY, 1) * F.col("trust") * F.when(F.col("direction") == "down", 1.1).otherwise(1.0)
    s = s.withColumn("score", F.round(F.when(F.col("status") == "resolved", F.col("_prior") * NOVELTY["resolved"]).otherwise(score), 6)).where((F.col("score") > 0) | (F.col("status") == "resolved"))
    order = [F.desc("score"), F.desc(_lookup(F.col("severity"), SEVERITY_RANK, 0)), "venue", F.desc(_lookup(F.col("source"), SOURCE_RANK, 0)), F.desc("onset"), "item_key"]
    return s.select("item_key", "venue", "direction", "source", "severity", "onset", "n_evidence", "trust", "caveats", "status", "score").orderBy(*order)


def run_hash(items: DataFrame) -> DataFrame:
    """(run_hash): md5 of the sorted item keys of a briefing, which has some dozens of items."""
    return items.agg(F.md5(F.array_join(F.array_sort(F.collect_list("item_key")), ",")).alias("run_hash"))


def headline(item: Column, venue: Column, direction: Column, n: Column) -> Column:
    return F.format_string("%s %s at %s (%d more signs)", item, direction, venue, n)


def weather_skill(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """(lead, n, temp_mae, rain_mae) of forecasts joined to observations by cell and date."""
    j = observed.join(forecast.withColumnsRenamed({"temp": "temp_f", "rain": "rain_f"}), ["cell", "date"])
    return j.groupBy("lead").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("temp") - F.col("temp_f"))), 6).alias("temp_mae"), F.round(F.avg(F.abs(F.col("rain") - F.col("rain_f"))), 6).alias("rain_mae"))


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """(cell, date, temp_max, rain, sun_hours) of hourly readings."""
    return hourly.groupBy("cell", F.to_date("ts").alias("date")).agg(F.max("temp").alias("temp_max"), F.sum("rain").alias("rain"), (F.sum("sun_seconds") / 3600).alias("sun_hours"))


def climatology(daily: DataFrame, value: str, window: int = 15) -> DataFrame:
    """(cell, doy, normal): the mean over days of the year within `window`, around the year's end too. Sums by day are copied to their 2 * window + 1 neighbours."""
    sums = daily.groupBy("cell", F.dayofyear("date").alias("d")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    spread = sums.select("cell", "s", "n", F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.pmod(F.col("d") - 1 + k, F.lit(366)) + 1)).alias("doy"))
    return spread.groupBy("cell", "doy").agg(F.round(safe_ratio(F.sum("s"), F.sum("n")), 6).alias("normal"))
