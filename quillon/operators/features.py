"""Features of daily series, and splits that don't leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.calendar import is_bank_holiday, is_school_term, uni_phase
from quillon.functions.cleaning import HAPPY_HOUR, NO_TRADE, PRICE_BREAK
from quillon.functions.conventions import dow_monday



def in_intervals(d: Column, intervals: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(False)
    for a, b in intervals:
        out = out | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return out


def term_changes(dates: DataFrame, intervals: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(date, into_term): days after which school term turns to vacation or back, by rule, or by the intervals given."""
    in_term = is_school_term if intervals is None else lambda d: in_intervals(d, intervals)
    d = dates.select("date").distinct().withColumn("now", in_term(F.col("date"))).withColumn("next", in_term(F.date_add("date", 1)))
    return d.where(F.col("now") != F.col("next")).select("date", F.col("next").alias("into_term"))


def calendar_features(days: DataFrame, *, price_break: str = PRICE_BREAK) -> DataFrame:
    """days with flags and parts of their date; holidays and terms follow rules, for any year."""
    d, dow = F.col("date"), dow_monday("date")
    flag = lambda c: c.cast("int")
    return days.select(
        "*", dow.alias("dow_mon"), flag(dow >= 4).alias("is_weekend"), *(flag(dow == i).alias(f"dow_{i}") for i in range(7)),
        F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.floor(F.month(d) % 12 / 3).cast("int").alias("season"), F.weekofyear(d).alias("iso_week"),
        flag(dow.isin(*HAPPY_HOUR)).alias("is_happy_hour"), flag(dow.isin(*NO_TRADE)).alias("is_structural_zero"),
        flag(is_bank_holiday(d)).alias("is_bank_holiday"), flag(d >= F.lit(price_break).cast("date")).alias("price_regime"),
        flag(is_school_term(d)).alias("is_school_term"), uni_phase(d).alias("uni_phase"),
    )


def with_exogenous(days: DataFrame, weather: DataFrame, happenings: DataFrame) -> DataFrame:
    """days (venue, date, ...) with the weather of their venue (temp, null where unknown) and the highest rank of the events of their date (0: none).

    Events (venue or null for all, date, rank) are reduced to a row for each venue and date before they are joined.
    """
    everywhere = happenings.where("venue is null").groupBy("date").agg(F.max("rank").alias("_all"))
    own = happenings.where("venue is not null").groupBy("venue", "date").agg(F.max("rank").alias("_own"))
    met = days.join(weather.groupBy("venue", "date").agg(F.max("temp").alias("temp")), ["venue", "date"], "left").join(own, ["venue", "date"], "left").join(everywhere, "date", "left")
    rank = F.greatest(F.coalesce("_own", F.lit(0)), F.coalesce("_all", F.lit(0)))
    return met.select(*days.columns, "temp", rank.alias("event_rank"), (rank > 0).cast("int").alias("has_event"))


def history_features(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """lag_7, lag_14, and mean, median and spread of the 28 days before (null with fewer than 7). The series is dense."""
    w = Window.partitionBy(*keys).orderBy("date")
    past = w.rowsBetween(-28, -1)
    n = F.count(value).over(past)
    # a framed median is not among Spark's window functions: the frame holds 28 values at most
    held = F.array_sort(F.collect_list(value).over(past))
    middle = (F.element_at(held, F.ceil(F.size(held) / 2).cast("int")) + F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))) / 2
    return series.select(
        "*", F.lag(value, 7).over(w).alias("lag_7"), F.lag(value, 14).over(w).alias("lag_14"), F.when(n >= 7, F.round(F.avg(value).over(past), 6)).alias("roll_mean_28"), F.when(n >= 7, F.round(middle, 6)).alias("roll_median_28")
    )


def rolling_peak(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The greatest mean of 7 rows, fewer at the beginning, per key."""
    mean = F.avg(value).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(-6, 0))
    return series.withColumn("m", mean).groupBy(*keys).agg(F.round(F.max("m"), 6).alias("peak_7"))


def time_split(series: DataFrame, test_weeks: int = 8, val_weeks: int = 4) -> DataFrame:
    """Adds split: the last test_weeks are "test", the val_weeks before them "val", the rest "train"; by calendar from the last date of all."""
    last = series.agg(F.max("date").alias("_last"))
    edge = lambda weeks: F.date_sub("_last", 7 * weeks)
    label = F.when(F.col("date") > edge(test_weeks), "test").when(F.col("date") > edge(test_weeks + val_weeks), "val").otherwise("train")
    return series.crossJoin(F.broadcast(last)).withColumn("split", label).drop("_last")  # one row


def rolling_origin(series: DataFrame, n_folds: int = 6, horizon: int = 7, min_train: int = 120) -> DataFrame:
    """(fold, role, rows of the series): expanding folds, the latest first; a fold tests `horizon` days and trains on all before. Folds with fewer than min_train training days are left out."""
    venue = Window.partitionBy("venue")
    own = series.withColumns({"_first": F.min("date").over(venue), "_last": F.max("date").over(venue)})  # the series is read once: it may be a join of all lines
    folds = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")).withColumn("_end", F.date_sub("_last", F.col("fold") * horizon))
    folds = folds.withColumn("_cut", F.date_sub("_end", horizon)).where((F.datediff("_cut", "_first") + 1 >= min_train) & (F.col("date") <= F.col("_end")))
    return folds.withColumn("role", F.when(F.col("date") <= F.col("_cut"), "train").otherwise("test")).drop("_first", "_last", "_end", "_cut")


def leave_one_venue_out(venues: DataFrame) -> DataFrame:
    """(held_out, donor): every venue with every other. Venues are few; the pairs are the result."""
    other = venues.select(F.col("venue").alias("donor"))
    return venues.select(F.col("venue").alias("held_out")).join(F.broadcast(other), F.col("held_out") != F.col("donor"))


def assert_no_leakage(folds: DataFrame) -> DataFrame:
    """(venue, fold, train_end, test_start, leaks)."""
    edges = folds.groupBy("venue", "fold").agg(F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train_end"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test_start"))
    return edges.withColumn("leaks", F.col("train_end") >= F.col("test_start"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def coverage_gaps(df: DataFrame, first: str, last: str) -> None:
    """Raise unless the dates cover the interval."""
    a, b = df.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    if a is None or a > first or b < last:
        raise ValueError(f"covers {a} to {b}, not {first} to {last}")
