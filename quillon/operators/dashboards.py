"""Operational dashboards over event logs, messages, tasks and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.conventions import safe_ratio, week_start


def zero_filled_days(rows: DataFrame, first: str, last: str, keys: list[str], *, date: str = "day") -> DataFrame:
    """All days of [first, last], both included, with 0 in every other column where rows has none."""
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(date))
    values = [c for c in rows.columns if c != date and c not in keys]
    return days.join(rows, date, "left").na.fill(0, values)


def outcomes_by_day(events: DataFrame, first: str, last: str) -> DataFrame:
    """(day, hit, no_data, error, total) for every day."""
    day = F.to_date("created_at")
    n = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    counts = events.where(day.between(first, last)).groupBy(day.alias("day")).agg(n("hit").alias("hit"), n("no-data").alias("no_data"), n("error").alias("error"), F.count("*").alias("total"))
    return zero_filled_days(counts, first, last, [])


def escalations_by_day(events: DataFrame, escalated: Column, resolved: Column) -> DataFrame:
    """(day, n, n_escalated, n_resolved, resolution_rate): of escalated events the share that is resolved; null without any."""
    e, r = F.count_if(escalated), F.count_if(escalated & resolved)
    return events.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), e.alias("n_escalated"), r.alias("n_resolved"), F.round(safe_ratio(r, e), 6).alias("resolution_rate"))


def costs_by_day(events: DataFrame, cost: str = "value") -> DataFrame:
    """(day, cents, n_costed, cents_per_event): each row is rounded to cents before it is summed."""
    each = F.floor(F.col(cost) * 100 + 0.5).cast("long")
    return events.groupBy(F.to_date("created_at").alias("day")).agg(F.coalesce(F.sum(each), F.lit(0)).alias("cents"), F.count(cost).alias("n_costed"), F.round(safe_ratio(F.sum(each), F.count("*")), 6).alias("cents_per_event"))


def feedback_by_day(events: DataFrame, kind: str = "event_type", *, up: str, down: str, again: str) -> DataFrame:
    """(day, up, down, regenerate, positive_rate): regenerations don't count for the rate."""
    n = lambda x: F.count_if(F.col(kind) == x)
    return events.groupBy(F.to_date("created_at").alias("day")).agg(n(up).alias("up"), n(down).alias("down"), n(again).alias("regenerate"), F.round(safe_ratio(n(up), n(up) + n(down)), 6).alias("positive_rate"))


def funnel(rows: DataFrame, status: str, adopted: list[str], dismissed: list[str], uplift: str) -> DataFrame:
    """(n, n_adopted, n_dismissed, uplift of the adopted, adoption_rate)."""
    a, d = F.count_if(F.col(status).isin(adopted)), F.count_if(F.col(status).isin(dismissed))
    return rows.agg(F.count("*").alias("n"), a.alias("n_adopted"), d.alias("n_dismissed"), F.sum(F.when(F.col(status).isin(adopted), F.col(uplift))).alias("uplift"), F.round(safe_ratio(a, a + d), 6).alias("adoption_rate"))


def weekly_active(events: DataFrame, zone: str, first_monday: str, weeks: int) -> DataFrame:
    """(week, n_users, n_events) for every week from a Monday, by the venue's own clock; a week begins on Monday."""
    spark = events.sparkSession
    week = week_start(F.col("created_at").cast("timestamp"), zone)
    counts = events.groupBy(week.alias("week")).agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_events"))
    every = spark.range(weeks).select(F.date_add(F.lit(first_monday).cast("date"), (F.col("id") * 7).cast("int")).alias("week"))
    return every.join(counts, "week", "left").na.fill(0)


def hours_recovered(events: DataFrame, since: str, until: str, minutes: float = 4.2, pence_per_hour: int = 2500) -> DataFrame:
    """(hits, hours, pence) in the half-open interval [since, until)."""
    kept = events.where((F.col("outcome") == "hit") & (F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(until).cast("timestamp_ntz")))
    hours = F.count("*") * minutes / 60
    return kept.agg(F.count("*").alias("hits"), F.round(hours, 4).alias("hours"), F.floor(hours * pence_per_hour + 0.5).cast("long").alias("pence"))


def top_queries(events: DataFrame, outcome: str, k: int = 10, *, trim: bool = True) -> DataFrame:
    """(query, n, last_asked): the k most asked with an outcome; ties by the latest, then by text."""
    q = F.lower(F.trim("query") if trim else F.col("query"))
    return events.where(F.col("outcome") == outcome).groupBy(q.alias("query")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_asked")).orderBy(F.desc("n"), F.desc("last_asked"), "query").limit(k)


def unanswered(events: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(query, n, last_asked) of queries without data that nobody dismissed."""
    q = F.lower("query")
    return events.where("outcome = 'no-data'").groupBy(q.alias("query")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_asked")).join(dismissed.select(F.lower("query").alias("query")).distinct(), "query", "left_anti")


def active_staff(events: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, name, n, last_seen): the k most active who are members."""
    n = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
    return n.join(members.select("user_id", "name"), "user_id").orderBy(F.desc("n"), F.desc("last_seen"), "user_id").limit(k)


def competency(events: DataFrame) -> DataFrame:
    """(user_id, total, repeats, repeat_rate): a repeat is a text that the user asked before."""
    n, d = F.count("*"), F.countDistinct(F.lower(F.trim("query")))
    return events.groupBy("user_id").agg(n.alias("total"), (n - d).alias("repeats"), F.round((n - d) / n, 6).alias("repeat_rate"))


def onboarding(members: DataFrame, events: DataFrame) -> DataFrame:
    """competency for every member, with 0 for those who never asked."""
    return members.select("user_id").join(competency(events), "user_id", "left").na.fill(0, ["total", "repeats"])


def first_independent_day(events: DataFrame, *, days: int = 14, trailing: int = 7, least: int = 5, below: float = 0.1) -> DataFrame:
    """(user_id, first_day): the first day within `days` of a user's first event at whose start the trailing days hold at least `least` queries with a repeat rate under `below`; null if there is none.

    Every event is copied to the at most `trailing` boundaries that see it.
    """
    e = events.withColumn("at", F.col("created_at").cast("timestamp")).withColumn("q", F.lower(F.trim("query")))
    joined = e.groupBy("user_id").agg(F.min("at").alias("joined"))
    age = (F.unix_micros("at") - F.unix_micros("joined")) / 86_400_000_000
    placed = e.join(joined, "user_id").withColumn("d", F.floor(age)).where(F.col("d") < days)
    seen = placed.select("user_id", "q", F.explode(F.sequence(F.col("d") + 1, F.least(F.col("d") + trailing, F.lit(days)))).alias("day"))
    rate = seen.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.countDistinct("q").alias("u")).where((F.col("n") >= least) & ((F.col("n") - F.col("u")) / F.col("n") < below))
    return joined.select("user_id").join(rate.groupBy("user_id").agg(F.min("day").alias("first_day")), "user_id", "left")


def by_month(messages: DataFrame, k: int = 12) -> DataFrame:
    """(month, n): the latest k calendar months."""
    return messages.groupBy(F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc("month")).limit(k)


def tool_frequency(messages: DataFrame, log: str, k: int = 30) -> DataFrame:
    """(tool, n): the k most called, from an array of called tools in each message."""
    return messages.select(F.explode(log).alias("tool")).groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool").limit(k)


def grounding(messages: DataFrame, cited: Column, used_tool: Column, cost: str) -> DataFrame:
    """(n, n_cited, n_tool, n_tool_uncited, cost, mean_cost) over replies."""
    return messages.agg(F.count("*").alias("n"), F.count_if(cited).alias("n_cited"), F.count_if(used_tool).alias("n_tool"), F.count_if(used_tool & ~cited).alias("n_tool_uncited"), F.sum(cost).alias("cost"), F.round(F.avg(cost), 6).alias("mean_cost"))


def adoption(members: DataFrame, messages: DataFrame) -> DataFrame:
    """(venue_id, n_members, n_active, n_conversations, n_messages); members without activity count."""
    m = members.select("user_id", F.col("venue_id").alias("home")).join(messages.select("user_id", "conv_id", "turn"), "user_id", "left")
    return m.groupBy(F.col("home").alias("venue_id")).agg(F.countDistinct("user_id").alias("n_members"), F.countDistinct(F.when(F.col("conv_id").isNotNull(), F.col("user_id"))).alias("n_active"), F.countDistinct("conv_id").alias("n_conversations"), F.count("turn").alias("n_messages"))


def latest_per_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`; a key's rows are reduced by partial aggregation, not sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*keys, "_m.*")


def next_reply(messages: DataFrame) -> DataFrame:
    """Each user turn with the next assistant turn of its conversation; null if none follows."""
    # read backwards, so that the frame only grows
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("role") == "assistant", F.struct(F.col("turn").alias("t"), F.col("text").alias("x"))), ignorenulls=True).over(w)
    return messages.withColumn("_r", reply).where("role = 'user'").select("conv_id", "turn", "text", F.col("_r.t").alias("reply_turn"), F.col("_r.x").alias("reply"))


def failure_rates(pairs: DataFrame, failed: Column) -> DataFrame:
    """(day, n, n_failed, rate, rate_7): of replies; rate_7 is the mean rate of 7 rows of days."""
    days = pairs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))
    rate = days.withColumn("rate", F.round(F.col("n_failed") / F.col("n"), 6))
    return rate.withColumn("rate_7", F.round(F.avg(F.col("n_failed") / F.col("n")).over(Window.orderBy("day").rowsBetween(-6, 0)), 6))  # a row per day


def cluster_scorecard(rows: DataFrame, cluster: str, failed: Column, examples: str, *, most: int = 3, gap_at: float = 0.5) -> DataFrame:
    """(cluster, n, n_failed, density, score, is_gap, examples): examples are the first by text of those that failed."""
    n, f = F.count("*"), F.count_if(failed)
    # the first texts are kept by rank, not gathered
    base = rows.groupBy(cluster).agg(n.alias("n"), f.alias("n_failed"), F.round(f / n, 6).alias("density"), F.round(f / n * f, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(examples))
    best = rows.where(failed).select(cluster, examples).distinct().withColumn("_r", rank).where(F.col("_r") <= most).groupBy(cluster).agg(F.array_sort(F.collect_list(examples)).alias("examples"))
    return base.withColumn("is_gap", F.col("density") >= gap_at).join(best, cluster, "left")


def due_counters(tasks: DataFrame, now: str) -> DataFrame:
    """(n_open, n_overdue, n_due_30, n_undated) in one pass; all of open tasks."""
    at, is_open = F.lit(now).cast("timestamp_ntz"), F.col("status") == "open"
    return tasks.agg(F.count_if(is_open).alias("n_open"), F.count_if(is_open & (F.col("due_at") < at)).alias("n_overdue"), F.count_if(is_open & (F.col("due_at") >= at) & (F.col("due_at") < at + F.expr("INTERVAL 30 DAYS"))).alias("n_due_30"), F.count_if(is_open & F.col("due_at").isNull()).alias("n_undated"))


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def task_list(tasks: DataFrame, k: int = 50) -> DataFrame:
    """Open first, then by due time (undated last), then the newest. Sorted before the limit, so that no row hides another."""
    return tasks.orderBy(F.when(F.col("status") == "open", 0).otherwise(1), F.asc_nulls_last("due_at"), F.desc("created_at"), "task_id").limit(k)


def page(rows: DataFrame, after: tuple | None, columns: list[str], size: int) -> DataFrame:
    """A keyset page, descending by columns: rows below `after`, at most size + 1, so that a further row tells of a next page."""
    key = F.struct(*columns)
    kept = rows if after is None else rows.where(key < F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(after, columns, strict=True))))
    return kept.orderBy(*(F.desc(c) for c in columns)).limit(size + 1)


def offset_page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """An offset page with the total of rows beside each."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))  # one row


def below_par(stock: DataFrame, k: int = 50) -> DataFrame:
    """Stock under its par, the most depleted first: 1 - current / par."""
    return stock.where("current < par and par > 0").withColumn("depletion", F.round(1 - F.col("current") / F.col("par"), 6)).orderBy(F.desc("depletion"), "name", "stock_id").limit(k)


def suppliers_with_stock(stock: DataFrame) -> DataFrame:
    """(venue_id, supplier_id, n): suppliers that have a stock line at a venue."""
    return stock.groupBy("venue_id", "supplier_id").agg(F.count("*").alias("n"))


def usage_mix(messages: DataFrame) -> DataFrame:
    """(venue_id, channel, n_conversations, n_messages)."""
    return messages.groupBy("venue_id", "channel").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"))


def named_askers(gaps: DataFrame, ids: str, names: DataFrame) -> DataFrame:
    """gaps with asker_names: the names of an array of ids, in its order; unknown ids are left out."""
    keyed = gaps.select("*", F.posexplode_outer(ids).alias("_p", "user_id")).join(names.select("user_id", "name"), "user_id", "left")
    rest = [c for c in gaps.columns if c != ids]
    return keyed.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("_p", "name")))), lambda x: x["name"]).alias("asker_names"))
