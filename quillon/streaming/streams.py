"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.store import Store


def event_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def outcomes_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Outcome counts by tumbling day; days close when the watermark has passed them."""
    day = F.window("created_at", "1 day")
    counts = events.withWatermark("created_at", late).groupBy(day.alias("w"), "outcome").agg(F.count("*").alias("n"))
    return counts.select(F.to_date("w.start").alias("day"), "outcome", "n")


def sessions(signals: DataFrame, gap: str = "7 days", late: str = "14 days") -> DataFrame:
    """(venue, direction, first, last, n): signals in session windows; a gap closes a session."""
    w = F.session_window("onset", gap)
    return signals.withWatermark("onset", late).groupBy("venue", "direction", w.alias("w")).agg(F.count("*").alias("n"), F.min("onset").alias("first"), F.max("onset").alias("last")).select("venue", "direction", "first", "last", "n")


def first_messages(messages: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Messages without repeated ids; state is kept for the time to live."""
    return messages.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["message_id"])


def append_new_days(incoming: DataFrame, store: Store, add: Callable[[Store, DataFrame], object], checkpoint: str):
    """Each micro-batch goes through the batch refresh, which drops what its venue's watermark has passed; a replayed batch adds nothing."""
    return incoming.writeStream.foreachBatch(lambda df, _: add(store, df) and None).option("checkpointLocation", checkpoint)
