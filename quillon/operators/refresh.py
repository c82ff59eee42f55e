"""Incremental refresh: watermarks, appends, refit decisions, schedules, queues and limits."""

from __future__ import annotations

from collections import deque
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ordered import flag_in_order
from quillon.sources.store import Store, merged

#: Reminder windows in days before expiry, rate limits, queue limits (fixed values).
LEAD_DAYS, ATTEMPTS, CADENCE_DAYS = (30, 7, 1, 0), 3, 7


def accept_new(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """The incoming rows later than their own venue's last held day; late rows are dropped. The watermark is a row per venue."""
    mark = held.groupBy("venue").agg(F.max("date").alias("_mark"))
    return incoming.join(mark, "venue", "left").where(F.col("_mark").isNull() | (F.col("date") > F.col("_mark"))).drop("_mark")


def watermarks(rows: DataFrame, layer: str, at: str) -> DataFrame:
    return rows.groupBy("venue").agg(F.max("date").alias("last_date")).select("venue", F.lit(layer).alias("layer"), "last_date", F.lit(at).cast("timestamp").alias("updated_at"))


def should_refit(mode: str, fits: DataFrame, points: DataFrame, today: str) -> DataFrame:
    """(venue, refit): never, force, or auto: a week since the last fit, or a change-point after it; a venue without a fit is not refitted."""
    last = fits.groupBy("venue").agg(F.max("fit_date").alias("f")).join(points.groupBy("venue").agg(F.max("onset").alias("o")), "venue", "left")
    auto = (F.datediff(F.lit(today).cast("date"), "f") >= CADENCE_DAYS) | F.coalesce(F.col("o") > F.col("f"), F.lit(False))
    return last.select("venue", {"never": F.lit(False), "force": F.lit(True)}.get(mode, auto).alias("refit"))


def freshness(marks: DataFrame, data: DataFrame, today: str, stale_after: int = 1) -> DataFrame:
    """(venue, last_date, days, stale): by watermark, else by the data; days before today."""
    d = data.groupBy("venue").agg(F.max("date").alias("d"))
    m = marks.groupBy("venue").agg(F.max("last_date").alias("m"))
    age = F.datediff(F.lit(today).cast("date"), F.coalesce("m", "d"))
    return d.join(m, "venue", "full").select("venue", F.coalesce("m", "d").alias("last_date"), age.alias("days"), (age > stale_after).alias("stale"))


def estate(fresh: DataFrame) -> DataFrame:
    """(any_stale, newest, oldest, n): one row over all venues."""
    return fresh.agg(F.bool_or("stale").alias("any_stale"), F.max("last_date").alias("newest"), F.min("last_date").alias("oldest"), F.count("*").alias("n"))


def refresh(store: Store, incoming: DataFrame, layer: str, at: str) -> int:
    """Append what is new, move the watermarks; returns the rows added. A second run adds none."""
    held = store.read("line_items", incoming.schema)
    added = accept_new(incoming, held)
    n = added.count()
    if n:
        store.append("line_items", added)
        store.upsert("data_watermark", watermarks(store.read("line_items"), layer, at), ["venue", "layer"])
    return n


def promote(store: Store, forecasts: DataFrame) -> None:
    """Make forecasts the served ones: a row per venue, layer, key, date and model."""
    store.upsert("served_forecast", forecasts, ["venue", "layer", "key", "target_date", "model"])


def next_run(now: Column, zone: str, kind: Column, hour: Column, day: Column) -> Column:
    """The next UTC time after now at which a schedule is due: daily at an hour, weekly on a weekday (Monday 0), monthly on a day.

    The first fitting hour of the next 32 days; a schedule that fits none of them (day 31 from the end of January) looks
    again a day later, at the full hour. Of the local days only the first three that fit are looked at (one may have passed,
    one may lack the hour), and of those the hours about the one asked for, which differ where clocks change.
    """
    start = F.date_trunc("hour", now)
    today = F.to_date(F.from_utc_timestamp(start, zone))
    days = F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: F.date_add(today, i))
    fitting = F.filter(days, lambda d: F.when(kind == "daily", True).when(kind == "weekly", F.weekday(d) == day).otherwise(F.dayofmonth(d) == day))
    second = lambda t: F.unix_micros(t) / 1_000_000

    def about(d: Column) -> Column:
        # hours from start to the one asked for; a change of clocks moves it by up to two
        at = F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + hour * 3600), zone)
        return F.transform(F.sequence(F.lit(-2), F.lit(3)), lambda k: F.floor((second(at) - second(start)) / 3600).cast("int") + k)

    def due(n: Column) -> Column:
        local = F.from_utc_timestamp(F.timestamp_micros(F.unix_micros(start) + n * F.lit(3_600_000_000)), zone)
        on_day = F.when(kind == "daily", True).when(kind == "weekly", F.weekday(local) == day).otherwise(F.dayofmonth(local) == day)
        return n.between(1, 768) & (F.hour(local) == hour) & on_day

    hours = F.flatten(F.transform(F.slice(fitting, 1, 3), about))
    first = F.array_min(F.filter(hours, due))
    return F.coalesce(F.timestamp_micros(F.unix_micros(start) + first * F.lit(3_600_000_000)), F.date_trunc("hour", now + F.expr("INTERVAL 24 HOURS")))


def advanced(schedules: DataFrame, claimed: DataFrame, now: str, zone: str) -> DataFrame:
    """schedules (schedule_id, kind, hour, day, next_run_at, ...) with the next slot of those claimed."""
    late = next_run(F.lit(now).cast("timestamp"), zone, F.col("kind"), F.col("hour"), F.col("day"))
    taken = claimed.select("schedule_id", F.lit(True).alias("_taken"))
    return schedules.join(taken, "schedule_id", "left").withColumn("next_run_at", F.when(F.col("_taken"), late).otherwise(F.col("next_run_at"))).select(*schedules.columns)


def claim_due(schedules: DataFrame, now: str, most: int = 50) -> DataFrame:
    return schedules.where(F.col("active") & (F.col("next_run_at") <= F.lit(now).cast("timestamp"))).orderBy("next_run_at", "schedule_id").limit(most)


def expiry_reminders(items: DataFrame, today: str) -> DataFrame:
    """(item_id, fire, stamped): of the reminder windows that an item (item_id, expires, stamped_leads) has entered and not been reminded of, the tightest fires and all are stamped."""
    left = F.datediff("expires", F.lit(today).cast("date"))
    leads = F.array(*(F.lit(x) for x in LEAD_DAYS))
    open_ = F.filter(leads, lambda x: (left <= x) & ~F.array_contains("stamped_leads", x))
    return items.where(left.between(-30, 31)).withColumn("stamped", open_).where(F.size("stamped") > 0).select("item_id", F.array_min("stamped").alias("fire"), "stamped")


def rate_limited(hits: DataFrame, *, most: int = 30, seconds: int = 3600) -> DataFrame:
    """hits (key, at) with allowed: at most `most` allowed ones within the last `seconds`; refused ones don't count. The state of a key is the times of its last `most` allowed hits."""

    def step(taken: deque | None, at) -> tuple[deque, bool]:
        taken = deque() if taken is None else taken
        while taken and (at - taken[0]).total_seconds() >= seconds:
            taken.popleft()
        ok = len(taken) < most
        if ok:
            taken.append(at)
        return taken, ok

    return flag_in_order(hits, ["key"], ["at", *(c for c in hits.columns if c not in ("key", "at"))], ["at"], step, "allowed")


def first_sightings(messages: DataFrame, hours: int = 24) -> DataFrame:
    """messages (message_id, at) without those within `hours` of a counted sighting of the same id. The state of an id is its last counted sighting."""

    def step(last, at) -> tuple[Any, bool]:
        fresh = last is None or (at - last).total_seconds() >= hours * 3600
        return (at if fresh else last), fresh

    return flag_in_order(messages, ["message_id"], ["at"], ["at"], step, "_fresh").where("_fresh").drop("_fresh")


def issuer_guard(issued: DataFrame, asked: DataFrame, most: int, hours: int = 24) -> DataFrame:
    """asked (issuer, at) with allowed: fewer than `most` of the issuer's issues (issuer, at) lie within the hours before. Issues are counted by a running count, so that no range is joined."""
    span = F.expr(f"INTERVAL {hours} HOURS")
    marks = issued.select("issuer", F.col("at").alias("t"), F.lit(1).alias("d")).unionByName(issued.select("issuer", (F.col("at") + span).alias("t"), F.lit(-1).alias("d")))
    events = marks.groupBy("issuer", "t").agg(F.sum("d").alias("d"), F.lit(False).alias("ask")).unionByName(asked.select("issuer", F.col("at").alias("t")).distinct().select("issuer", "t", F.lit(0).alias("d"), F.lit(True).alias("ask")))
    so_far = Window.partitionBy("issuer").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("n", F.sum("d").over(so_far)).where("ask").select("issuer", F.col("t").alias("at"), (F.col("n") < most).alias("allowed"))
    return asked.join(held, ["issuer", "at"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def retag_candidates(tagged: DataFrame, queue: DataFrame, *, least: float) -> DataFrame:
    """(item_id, similarity): items (item_id, similarity) whose best tag lies under the threshold and that may be queued."""
    low = tagged.groupBy("item_id").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") < least)
    return low.join(enqueue(queue, low.select("item_id")), "item_id", "left_semi")


def enqueue(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted items (item_id) that may be queued: none active, fewer than ATTEMPTS tries."""
    busy = queue.where(F.col("status").isin("pending", "running")).select("item_id")
    spent = queue.groupBy("item_id").agg(F.max("attempts").alias("n")).where(F.col("n") >= ATTEMPTS).select("item_id")
    return wanted.distinct().join(busy, "item_id", "left_anti").join(spent, "item_id", "left_anti")


def drain(queue: DataFrame, most: int = 20) -> DataFrame:
    return queue.where("status = 'pending'").orderBy("created_at", "item_id").limit(most)


def due_reminders(tasks: DataFrame, cutoff: str, most: int = 200) -> DataFrame:
    return tasks.where((F.col("status") == "open") & (F.col("due_at") <= F.lit(cutoff).cast("timestamp_ntz")) & ~F.col("reminded")).orderBy("due_at", "task_id").limit(most)


def nudges(stock: DataFrame, cutoffs: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """(venue_id, n_below, first_cutoff): venues with stock under par and an order cutoff within the hours."""
    at = F.lit(now).cast("timestamp")
    soon = cutoffs.where((F.col("cutoff_at") >= at) & (F.col("cutoff_at") <= at + F.expr(f"INTERVAL {hours} HOURS"))).groupBy("venue_id").agg(F.min("cutoff_at").alias("first_cutoff"))
    return stock.where("current < par").groupBy("venue_id").agg(F.count("*").alias("n_below")).join(soon, "venue_id")


def latest_version_gap(docs: DataFrame, sections: DataFrame, current: int) -> DataFrame:
    """Documents without sections, or whose newest sections are of an older version."""
    newest = sections.groupBy("doc_id").agg(F.max("version").alias("version"))
    return docs.select("doc_id").join(newest, "doc_id", "left").where(F.col("version").isNull() | (F.col("version") < current))


def set_where(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """UPDATE ... FROM: rows with the columns of changes where keys meet."""
    names = [c for c in changes.columns if c not in keys]
    j = rows.join(changes.withColumnsRenamed({c: f"_n_{c}" for c in names}).withColumn("_hit", F.lit(True)), keys, "left")
    return j.select(*(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))


def insert_missing(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING."""
    return merged(more, rows, keys)
