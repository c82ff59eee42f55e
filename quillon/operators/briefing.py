"""The briefing as a job: signals collected from their sources, the run before read back, reasons and headlines, the envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.causes import attribute
from quillon.sources.store import Store

#: Rows of a venue's stream that are scanned for deviations (fixed value), and the marker of a run without items.
SCAN_ROWS, NO_ITEMS = 90, "__none__"

SIGNAL = ["venue", "source", "onset", "known", "direction", "severity", "magnitude", "what"]


def collect(deviations: DataFrame, points: DataFrame, stock: DataFrame, misses: DataFrame | None = None) -> DataFrame:
    """Signals of all sources in one form; known is the day on which each could be seen, what tells it in words.

    deviations (venue, date, direction, severity, z, actual); points as change_points returns them; stock (venue, as_of,
    product, days, order_kegs), the lines that ask for an order: high if nothing is left, else medium; misses (venue, date,
    severity, weight, checklist) of real checklists, where there are any.
    """
    side = lambda up, down: F.when(F.col("direction") == "up", up).otherwise(down)
    rows = deviations.select(
        "venue", F.lit("deviation").alias("source"), F.col("date").alias("onset"), F.col("date").alias("known"), "direction", "severity", F.col("z").alias("magnitude"),
        F.concat(F.round("actual").cast("long").cast("string"), side(F.lit(" above"), F.lit(" below")), F.lit(" band on "), F.col("date").cast("string")).alias("what"),
    )
    move = F.when(F.col("percent").isNull(), side(F.lit("a sustained uplift"), F.lit("a sustained downturn"))).otherwise(
        F.concat(F.round(F.abs("percent")).cast("long").cast("string"), side(F.lit("% above normal"), F.lit("% below normal")))
    )
    rows = rows.unionByName(points.select(
        "venue", F.lit("change_point").alias("source"), "onset", F.col("alarm").alias("known"), "direction", "severity", F.coalesce("percent", F.lit(0.0)).alias("magnitude"),
        F.concat(F.lit("sustained shift since "), F.col("onset").cast("string"), F.lit(" ("), move, F.lit(")")).alias("what"),
    ))
    rows = rows.unionByName(stock.select(
        "venue", F.lit("stock").alias("source"), F.col("as_of").alias("onset"), F.col("as_of").alias("known"), F.lit("down").alias("direction"),
        F.when(F.col("days") <= 0, "high").otherwise("medium").alias("severity"), F.coalesce("days", F.lit(0.0)).alias("magnitude"),
        F.concat(F.col("product"), F.lit(" low: "), F.format_string("%.1f", "days"), F.lit(" days' cover, order "), F.col("order_kegs").cast("string")).alias("what"),
    ))
    if misses is not None:
        rows = rows.unionByName(misses.where("severity <> 'ok'").select(
            "venue", F.lit("checklist").alias("source"), F.col("date").alias("onset"), F.col("date").alias("known"), F.lit("na").alias("direction"), "severity",
            F.col("weight").cast("double").alias("magnitude"), F.concat(F.col("checklist"), F.lit(" checklist missed on "), F.col("date").cast("string")).alias("what"),
        ))
    return rows.select(*SIGNAL)


def latest_run(store: Store) -> DataFrame:
    """(item_key, score) of the last run that was kept; nothing before the first one."""
    runs = store.read("briefing_runs", "item_key string, score double, run_at string")
    last = runs.agg(F.max("run_at").alias("_last"))
    return runs.join(F.broadcast(last), F.col("run_at") == F.col("_last")).where(F.col("item_key") != NO_ITEMS).select("item_key", "score")  # one row


def headlines(items: DataFrame, signals: DataFrame, facts: DataFrame) -> DataFrame:
    """items with reason and headline: what the head says, and the first cause that coincides with it. Items that are gone have cleared."""
    keys = ["venue", "direction", "source", "onset"]
    said = signals.groupBy(*keys).agg(F.min("what").alias("_what"))
    heads = items.where("status <> 'resolved'").select("venue", "onset", "direction").distinct()
    why = attribute(heads, facts).select("venue", "onset", "direction", F.element_at("causes", 1).alias("_why"))
    met = items.join(said, keys, "left").join(why, ["venue", "onset", "direction"], "left")
    gone = F.col("status") == "resolved"
    reason = F.when(gone, "cleared").otherwise(F.col("_why"))
    plain = F.col("source").isin("stock", "checklist")
    told = F.concat(F.col("venue"), F.lit(": "), F.col("_what"), F.when(plain, "").otherwise(F.concat(F.lit("; "), F.col("_why"))))
    return met.select(*items.columns, reason.alias("reason"), F.when(gone, F.concat(F.lit("cleared: "), "item_key")).otherwise(told).alias("headline"))


def envelope(items: DataFrame, as_of: Column) -> DataFrame:
    """(as_of, n_new, n_continuing, n_resolved, run_hash): one row; the hash is of the keys that are there now."""
    count = lambda status: F.count_if(F.col("status") == status)
    now = F.collect_list(F.when(F.col("status") != "resolved", F.col("item_key")))  # a briefing has some dozens of items
    return items.agg(
        F.max(as_of).alias("as_of"), count("new").alias("n_new"), count("continuing").alias("n_continuing"), count("resolved").alias("n_resolved"),
        F.md5(F.array_join(F.array_sort(now), ",").cast("binary")).alias("run_hash"),
    )
