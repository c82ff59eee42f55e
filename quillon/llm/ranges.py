"""Rows dealt to tasks by ranges of an order, so that places and running totals need no task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: monotonically_increasing_id() puts the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def deal(rows: DataFrame, order: list, label: str) -> DataFrame:
    """rows with part and place: sorted by order over all tasks, part by part and from place 0 in each; written to the shared folder.

    rows are read twice (once for the ranges), so they should be written already. Rows that are equal in order stay in one part.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = dealt.withColumn("_at", at).withColumns(
        {"part": F.shiftright("_at", _PLACE_BITS).cast("int"), "place": F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)}
    )
    return materialise(marked.drop("_at"), label)


def ranked(dealt: DataFrame, name: str) -> DataFrame:
    """dealt with each row's rank over all parts, from 1. One number for each part is broadcast."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part").agg(F.count("*").alias("_n"))
    offsets = counts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(offsets), "part").withColumn(name, F.col("_before") + F.col("place") + 1).drop("_before")


def running(dealt: DataFrame, key: str, so_far: dict[str, tuple[Column, str]]) -> DataFrame:
    """dealt (by key first) with running totals within each key, a row's own value included.

    so_far: for each new column the value of a row and how values add up: "sum", "xor" or "count". A key that spans parts gets
    the totals of its earlier parts, one row for each of them; no window holds more than one part's rows of a key.
    """
    fold = {"sum": F.sum, "xor": F.bit_xor, "count": F.count}
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b), "count": lambda a, b: a + b}
    inner = Window.partitionBy(key, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "part").agg(*(fold[how](value).alias(name) for name, (value, how) in so_far.items()))
    carried = totals.select(
        F.col(key).alias("_key"), F.col("part").alias("_part"),
        *(F.coalesce(fold["sum" if how == "count" else how](name).over(before), F.lit(0)).alias(f"_{name}") for name, (_, how) in so_far.items()),
    )
    within = dealt.withColumns({name: fold[how](value).over(inner) for name, (value, how) in so_far.items()})
    met = within.join(carried, within[key].eqNullSafe(carried["_key"]) & (within["part"] == carried["_part"]))
    return met.withColumns({name: add[how](F.col(name), F.col(f"_{name}")) for name, (_, how) in so_far.items()}).select(*within.columns)
