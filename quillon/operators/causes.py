"""What coincides with a change-point: closures, prices, terms, weather, events, promotions and empty stock, gathered as facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.calendar import is_bank_holiday, is_school_term, uni_phase

#: Days around an onset in which a fact counts, and weights of facts (fixed values). Weather weighs more for draught layers.
REACH_DAYS = 7
WEIGHTS = {"closure": 100, "price": 90, "uni": 65, "school": 60, "event": 55, "promo": 50, "stock": 45}
WEATHER_WEIGHT, DRAUGHT_WEIGHT, WARM_AND_UP = 40, 70, 5

#: What is said where nothing coincides (fixed value).
NOTHING = "no coincident calendar/weather/event/promo signal"

_FACT = "venue string, date date, reach int, kind string, label string, weight int, direction string"


def _facts(rows: DataFrame, kind: str, label: Column, *, venue: Column | None = None, direction: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        (none if venue is None else venue).alias("venue"), "date", F.lit(REACH_DAYS).alias("reach"), F.lit(kind).alias("kind"), label.alias("label"),
        F.lit(WEIGHTS[kind]).alias("weight"), F.lit(direction).cast("string").alias("direction"),
    )


def closures(spans: DataFrame) -> DataFrame:
    """Facts of closed venues (venue, last_active, is_closed)."""
    return _facts(spans.where("is_closed").withColumn("date", F.col("last_active")), "closure", F.concat(F.lit("closure of "), "venue"), venue=F.col("venue"))


def price_breaks(lines: DataFrame) -> DataFrame:
    """The first day of the month whose mean price of a unit differs most, as a ratio, from the month before: one fact for all venues."""
    months = lines.where(~F.col("excluded") & (F.col("qty") > 0)).groupBy(F.trunc("date", "month").alias("date")).agg((F.sum("gross_cents") / F.sum("qty")).alias("price"))
    step = F.round(F.abs(F.log(F.col("price") / F.lag("price").over(Window.orderBy("date")))), 12)  # a row for each month
    top = months.withColumn("step", step).where("step is not null").orderBy(F.desc("step"), "date").limit(1)
    return _facts(top, "price", F.lit("price-regime change"))


def term_edges(days: DataFrame) -> DataFrame:
    """Facts of days (date) after which a school or university term begins or ends."""
    dates = days.select("date").distinct()
    school = dates.where(is_school_term(F.col("date")) != is_school_term(F.date_add("date", 1)))
    in_term = lambda d: uni_phase(d) != "vacation"
    uni = dates.where(in_term(F.col("date")) != in_term(F.date_add("date", 1)))
    return _facts(school, "school", F.lit("school term/holiday")).unionByName(_facts(uni, "uni", F.lit("university term/vacation")))


def weather_spells(weather: DataFrame, *, draught: bool = False, least_days: int = 30) -> DataFrame:
    """Facts of weather (venue, date, temp): days around which the mean of the window lies more than one standard deviation off the venue's own.

    The windows run over one row a day and venue. A warm spell weighs more for a rise.
    """
    all_ = weather.groupBy("venue").agg(F.avg("temp").alias("_mean"), F.stddev("temp").alias("_sd"), F.count("*").alias("_n"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    near = Window.partitionBy("venue").orderBy(day).rangeBetween(-REACH_DAYS, REACH_DAYS)
    off = weather.withColumn("_win", F.avg("temp").over(near)).join(F.broadcast(all_), "venue")  # a row for each venue
    gap = F.round(F.col("_win") - F.col("_mean"), 9)
    off = off.where((F.abs(gap) > F.col("_sd")) & (F.col("_n") > least_days)).withColumn("_warm", gap > 0)
    base = F.lit(DRAUGHT_WEIGHT if draught else WEATHER_WEIGHT)
    one = lambda direction: off.select(
        "venue", "date", F.lit(0).alias("reach"), F.lit("weather").alias("kind"), F.when(F.col("_warm"), "warm spell").otherwise("cold snap").alias("label"),
        (base + F.when(F.col("_warm") & (F.lit(direction) == "up"), WARM_AND_UP).otherwise(0)).alias("weight"), F.lit(direction).alias("direction"),
    )
    return one("up").unionByName(one("down"))


def holidays(days: DataFrame) -> DataFrame:
    return _facts(days.select("date").distinct().where(is_bank_holiday(F.col("date"))), "event", F.lit("bank holiday"))


def events(happenings: DataFrame) -> DataFrame:
    """Facts of local events (venue or null for all, date, name)."""
    return _facts(happenings, "event", F.col("name"), venue=F.col("venue"))


def promotions(spikes: DataFrame) -> DataFrame:
    """Facts of discount days (venue, date, is_spike)."""
    return _facts(spikes.where("is_spike"), "promo", F.lit("discount day"), venue=F.col("venue"))


def empty_stock(cover: DataFrame) -> DataFrame:
    """Facts of snapshots (venue, date, reorder) that ask for an order; they can explain a fall only."""
    return _facts(cover.where("reorder").select("venue", "date").distinct(), "stock", F.lit("reorder flag"), venue=F.col("venue"), direction="down")


def gather(*facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, facts)


def attribute(points: DataFrame, facts: DataFrame) -> DataFrame:
    """points (venue, onset, direction, ...) with causes: labels of the facts that reach the onset, the weightiest first, then by label.

    A label counts once for a point. A fact is copied to the onsets that it reaches, so that the range join is an equi-join; a
    fact of no venue reaches all, one with a direction only points of that direction.
    """
    near = facts.select(F.col("venue").alias("_v"), F.col("direction").alias("_d"), "label", "weight", F.explode(F.sequence(F.expr("date_sub(date, reach)"), F.expr("date_add(date, reach)"))).alias("onset"))
    keys = ["venue", "onset", "direction"]
    hit = points.select(*keys).distinct().join(near.distinct(), "onset").where("(_v is null or _v = venue) and (_d is null or _d = direction)")
    each = hit.groupBy(*keys, "label").agg(F.max("weight").alias("w"))
    best = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "label"))).alias("_c"))
    labels = F.transform("_c", lambda x: x["label"])
    return points.join(best, keys, "left").withColumn("causes", F.coalesce(labels, F.array(F.lit(NOTHING)))).drop("_c")
