"""Stock history: product master, snapshot aggregates, dead stock, stock views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def product_master(panel: DataFrame, core_snapshots: int = 6) -> DataFrame:
    """(product, first_name, last_name, n_snapshots, mean_qty, max_value, is_core) of a panel (snapshot_date, product, name, qty, value)."""
    return panel.groupBy("product").agg(
        F.min_by("name", F.struct("snapshot_date", "name")).alias("first_name"), F.max_by("name", F.struct("snapshot_date", "name")).alias("last_name"), F.countDistinct("snapshot_date").alias("n_snapshots"),
        F.round(F.avg("qty"), 6).alias("mean_qty"), F.max("value").alias("max_value"), (F.countDistinct("snapshot_date") >= core_snapshots).alias("is_core"),
    )


def snapshot_totals(panel: DataFrame, categories: list[str]) -> DataFrame:
    """(snapshot_date, a column of value for each category, value, n, n_zero, zero_pct, days_since): a row per snapshot."""
    wide = panel.groupBy("snapshot_date").pivot("category", categories).agg(F.sum("value")).na.fill(0)
    sums = panel.groupBy("snapshot_date").agg(F.sum("value").alias("value"), F.count("*").alias("n"), F.count_if(F.col("qty") == 0).alias("n_zero"))
    back = F.lag("snapshot_date").over(Window.orderBy("snapshot_date"))  # a row per snapshot
    return wide.join(sums, "snapshot_date").withColumns({"zero_pct": F.round(100 * F.col("n_zero") / F.col("n"), 4), "days_since": F.datediff("snapshot_date", back)})


def latest_snapshot(panel: DataFrame) -> DataFrame:
    last = panel.agg(F.max("snapshot_date").alias("_last"))
    return panel.join(F.broadcast(last), F.col("snapshot_date") == F.col("_last")).drop("_last")  # one row


def dead_stock(panel: DataFrame, k: int = 8) -> DataFrame:
    """The dearest k products of the latest snapshot that hold stock whose amount never changed."""
    still = panel.groupBy("product").agg(F.min("qty").alias("a"), F.max("qty").alias("b"), F.countDistinct("snapshot_date").alias("n")).where("a = b and a > 0 and n > 1").select("product")
    return latest_snapshot(panel).join(still, "product").orderBy(F.desc("value"), "product").limit(k)


def cover_order(cover: DataFrame) -> DataFrame:
    """Reorders first, then the shortest cover; without cover last."""
    return cover.orderBy(F.desc_nulls_last("reorder"), F.asc_nulls_last("days"), "product")


def stock_view(stock: DataFrame, venues: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Stock lines with venue and supplier names; a line without a supplier stays."""
    return stock.join(venues, "venue_id").join(suppliers, "supplier_id", "left")


def price_change(old, new):
    """Percent, half-even to one place; null without an old price."""
    return F.bround(100 * (new - old) / F.nullif(old, F.lit(0)), 1)


def update_one(stock: DataFrame, name: str, delta: int) -> DataFrame:
    """stock with the amount of the one line of that name changed, at least 0; unchanged if the name isn't unique."""
    hit = stock.where(F.lower("name") == name.strip().lower()).agg(F.count("*").alias("_n"))
    changed = F.when((F.lower("name") == name.strip().lower()) & (F.col("_n") == 1), F.greatest(F.col("current") + delta, F.lit(0))).otherwise(F.col("current"))
    return stock.crossJoin(F.broadcast(hit)).withColumn("current", changed).drop("_n")  # one row
