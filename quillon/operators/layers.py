"""Venue, category and item days; dense calendars; daily series; spans and closures; manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.conventions import dow_sunday, safe_ratio
from quillon.sources.views import VAT, VAT_INCLUSIVE

#: Key columns of each layer.
LAYERS = {"L1": ("venue",), "L2": ("venue", "category"), "L3": ("venue", "item", "category")}


def _sums(venue: Column) -> list[Column]:
    net = F.sum("net_e4")
    return [
        (net / 10000).alias("revenue"), (F.when(F.first(venue).isin(*VAT_INCLUSIVE), net / (10000 * (1 + VAT))).otherwise(net / 10000)).alias("revenue_exvat"),
        F.sum("qty").alias("units"), (F.sum("disc_e4") / 10000).alias("discounts"), F.count("*").alias("n_lines"), F.countDistinct("transaction_id").alias("n_transactions"),
    ]


def layer(lines: DataFrame, name: str) -> DataFrame:
    """A layer's days. Excluded venues never enter; a missing category is "Uncategorised"; L3 leaves out lines without an item."""
    kept = lines.where(~F.col("excluded"))
    if name != "L1":
        kept = kept.withColumn("category", F.coalesce("category", F.lit("Uncategorised")))
    if name == "L3":
        kept = kept.where("item is not null")
    return kept.groupBy(*LAYERS[name], "date").agg(*_sums(F.col("venue"))).withColumn("dow", dow_sunday("date"))


def dense_calendar(days: DataFrame, keys: list[str], values: list[str], date: str = "date") -> DataFrame:
    """Every day from the first to the last of each key; missing days get 0 in `values`.

    A day stands for itself and for the missing ones after it, so that the days, and all they are made of, are read once.
    """
    after = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    own = days.where(F.col(date).isNotNull()).select(*keys, F.col(date).alias("_a"), F.greatest(date, F.date_sub(after, 1)).alias("_b"), *values)  # the last day has none after it
    every = own.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date), "_a", *values)
    return every.select(*keys, date, *(F.when(F.col(date) == F.col("_a"), F.col(v)).alias(v) for v in values)).na.fill(0, values)


def read_series(days: DataFrame, venue: str, value: str = "revenue", *, key: tuple[str, str] | None = None, fill: bool = False, only_until: str | None = None) -> DataFrame:
    """(date, dow, value) of a venue, or of a category or item of it, in order; fill: missing days are 0."""
    kept = days.where(F.col("venue") == venue)
    if key:
        kept = kept.where(F.col(key[0]) == key[1])
    if only_until:
        kept = kept.where(F.col("date") <= F.lit(only_until).cast("date"))
    one = kept.groupBy("venue", "date").agg(F.sum(value).alias("value"))
    one = dense_calendar(one, ["venue"], ["value"]) if fill else one
    return one.select("date", dow_sunday("date").alias("dow"), "value").orderBy("date")


def daily_series(days: DataFrame, value: str = "revenue") -> DataFrame:
    """(venue, date, value) on the dense calendar of every venue."""
    return dense_calendar(days.select("venue", "date", F.col(value).cast("double").alias("value")), ["venue"], ["value"])


def spike_days(lines: DataFrame, share_at: float = 0.95) -> DataFrame:
    """Days on which discounts eat nearly all of the gross: share = |discounts| / gross, to 4 places half-even."""
    sums = lines.where(~F.col("excluded")).groupBy("venue", "date").agg(F.sum("disc_e4").alias("d"), F.sum("gross_cents").alias("g"))
    return sums.select("venue", "date", F.bround(F.abs(safe_ratio(F.col("d") / 100, F.col("g"))), 4).alias("share")).withColumn("is_spike", F.coalesce(F.col("share") >= share_at, F.lit(False)))


def active_span(series: DataFrame, *, event_only: tuple[str, ...] = ()) -> DataFrame:
    """(venue, first_active, last_active, last_date, is_closed): closed venues' last positive day lies before the last day of all venues."""
    spans = series.groupBy("venue").agg(F.min(F.when(F.col("value") > 0, F.col("date"))).alias("first_active"), F.max(F.when(F.col("value") > 0, F.col("date"))).alias("last_active"), F.max("date").alias("last_date"))
    last = spans.agg(F.max("last_date").alias("dataset_last"))
    out = spans.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("is_closed", ~F.col("venue").isin(*event_only) & (F.col("last_active") < F.col("dataset_last"))).drop("dataset_last") if event_only else out.withColumn("is_closed", F.col("last_active") < F.col("dataset_last")).drop("dataset_last")


def trim_to_active(series: DataFrame) -> DataFrame:
    spans = active_span(series).select("venue", "first_active", "last_active")
    return series.join(spans, "venue").where(F.col("date").between(F.col("first_active"), F.col("last_active"))).drop("first_active", "last_active")


def trading_series(series: DataFrame, *, event_only: tuple[str, ...] = ()) -> DataFrame:
    """(venue, date, value) of every venue from its first active day on: to its last one, but for a closed venue to the last day of all venues with zeros, so that a closure is a drop."""
    last = series.agg(F.max("date").alias("_end"))
    spans = active_span(series, event_only=event_only).crossJoin(F.broadcast(last))  # one row
    end = F.when(F.col("is_closed"), F.col("_end")).otherwise(F.col("last_active"))
    days = spans.where("first_active is not null").select("venue", F.explode(F.sequence("first_active", end)).alias("date"))
    return days.join(series.select("venue", "date", "value"), ["venue", "date"], "left").na.fill(0.0, ["value"])


def manifest(lines: DataFrame) -> DataFrame:
    """A row per venue and one for all (venue null): counts, null shares, span and sums. One pass by grouping sets."""
    null_share = lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"null_{c}")
    return lines.rollup("venue").agg(
        F.count("*").alias("n_rows"), F.countDistinct("transaction_id").alias("n_transactions"), null_share("category"), null_share("item"), null_share("ts"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("qty").alias("qty"), (F.sum("net_e4") / 10000).alias("net"), (F.sum("gross_cents") / 100).alias("gross"), (F.sum("disc_e4") / 10000).alias("discounts"), (F.abs(F.sum(F.col("gross_cents") * 100 + F.col("disc_e4") - F.col("net_e4"))) <= 0.01 * F.sum("net_e4")).alias("reconciles"),
    )


def drop_with_reason(rows: DataFrame, reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that no reason drops, and (drop_reason, n): what each reason dropped; the first that holds counts."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        reason = F.when(condition, name).otherwise(reason)
    tagged = rows.withColumn("drop_reason", reason)
    return tagged.where("drop_reason is null").drop("drop_reason"), tagged.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def working_capital(snapshots: DataFrame) -> DataFrame:
    """(mean, least, greatest, their months, cv) of a value by month."""
    cv = F.stddev_samp("value") / F.avg("value")
    return snapshots.agg(
        F.round(F.avg("value"), 4).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min_by("month", F.struct("value", "month")).alias("min_month"), F.max_by("month", F.struct("value", "month")).alias("max_month"), F.round(cv, 6).alias("cv")
    )


def top_items(days: DataFrame, k: int = 3, value: str = "revenue") -> DataFrame:
    """The hierarchy's nodes: per venue and category the k items of most value and, if more than 1 is left, OTHER (at least 0)."""
    items = days.groupBy("venue", "category", "item").agg(F.sum(value).alias("total"))
    rank = F.row_number().over(Window.partitionBy("venue", "category").orderBy(F.desc("total"), "item"))
    ranked = items.withColumn("rank", rank)
    top = ranked.where(F.col("rank") <= k).select("venue", "category", F.concat_ws("::", F.lit("ITEM"), "category", "item").alias("node"), "total")
    rest = ranked.groupBy("venue", "category").agg(F.greatest(F.sum(F.when(F.col("rank") > k, F.col("total"))), F.lit(0.0)).alias("total")).where("total > 1")
    return top.unionByName(rest.select("venue", "category", F.concat_ws("::", F.lit("ITEM"), "category", F.lit("OTHER")).alias("node"), "total"))


def node_series(days: DataFrame, k: int = 3, value: str = "revenue") -> DataFrame:
    """(venue, node, parent, date, value): the daily series of VENUE, CAT and ITEM nodes over the venue's calendar, 0 on days without sales.

    OTHER is what a category has beyond its k items, at least 0 on each day, and is kept if its sum is more than 1. Values
    are added as whole ten-thousandths.
    """
    sums = days.groupBy("venue", "category", "item", "date").agg(F.sum(F.round(F.col(value) * 10000).cast("long")).alias("value"))
    total = sums.groupBy("venue", "category", "item").agg(F.sum("value").alias("_t"))
    top = total.withColumn("_r", F.row_number().over(Window.partitionBy("venue", "category").orderBy(F.desc("_t"), "item"))).where(F.col("_r") <= k)
    marked = sums.join(top.select("venue", "category", "item", F.lit(True).alias("_top")), ["venue", "category", "item"], "left")
    parent = F.concat(F.lit("CAT::"), "category")
    item = lambda last: F.concat_ws("::", F.lit("ITEM"), "category", last)
    items = marked.where("_top").select("venue", item("item").alias("node"), parent.alias("parent"), "date", "value")
    by_category = marked.groupBy("venue", "category", "date").agg(F.sum("value").alias("value"), F.greatest(F.sum(F.when(F.col("_top").isNull(), F.col("value")).otherwise(0)), F.lit(0)).alias("_rest"))
    other = by_category.select("venue", item(F.lit("OTHER")).alias("node"), parent.alias("parent"), "date", F.col("_rest").alias("value"))
    kept = other.groupBy("venue", "node").agg(F.sum("value").alias("_s")).where("_s > 10000").drop("_s")
    category = by_category.select("venue", parent.alias("node"), F.lit("VENUE").alias("parent"), "date", "value")
    venue = by_category.groupBy("venue", "date").agg(F.sum("value").alias("value")).select("venue", F.lit("VENUE").alias("node"), F.lit(None).cast("string").alias("parent"), "date", "value")
    sold = items.unionByName(other.join(kept, ["venue", "node"], "left_semi")).unionByName(category).unionByName(venue)
    spans = sums.groupBy("venue").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    every = sold.select("venue", "node", "parent").distinct().join(spans, "venue").select("venue", "node", "parent", F.explode(F.sequence("_a", "_b")).alias("date"))
    return every.join(sold.drop("parent"), ["venue", "node", "date"], "left").withColumn("value", F.coalesce(F.col("value") / 10000, F.lit(0.0)))
