"""Queries of incremental refresh, schedules and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import refresh as r
from quillon.plans.layers import L1, l1_daily
from quillon.sources import paged
from quillon.sources.partitioned import PartedTable
from quillon.sources.store import Store, merged, read_bands, shared_folder
from quillon.streaming import stateful
from quillon.sources.views import STOCK, TASKS, stock, tasks

EARLY = "1996-06-30"


def _forecasts(s: SparkSession, p: str) -> tuple[DataFrame, DataFrame]:
    """A forecast a week ahead of every layer day, with a null key, and its band at two levels."""
    f = l1_daily(s, p).select("venue", F.lit("L1").alias("layer"), F.lit(None).cast("string").alias("key"), F.date_add("date", 7).alias("target_date"), F.lit("naive").alias("model"), F.col("revenue").alias("yhat"))
    b = f.select("venue", "layer", "key", "target_date", "model", F.explode(F.array(F.lit(0.8), F.lit(0.9))).alias("level"), "yhat").withColumns({"lo": F.round(F.col("yhat") * (1 - F.col("level")), 4), "hi": F.round(F.col("yhat") * (1 + F.col("level")), 4)}).drop("yhat")
    return f, b


def upserted(s: SparkSession, p: str) -> DataFrame:
    days = l1_daily(s, p).select("venue", F.when(F.col("dow") == 0, None).otherwise(F.col("dow")).alias("key"), "date", "revenue")
    new = days.where("date >= DATE '1997-01-01'").withColumn("revenue", F.lit(0.0))
    return merged(days, new, ["venue", "key", "date"])


def accepted_days(s: SparkSession, p: str) -> DataFrame:
    days = l1_daily(s, p).select("venue", "date", "units")
    held = days.where((F.col("date") <= F.lit(EARLY).cast("date")) | (F.col("venue") == "ASIA"))
    return r.accept_new(days, held)


def _replayed(s: SparkSession, p: str, decide) -> DataFrame:
    """What a stream over all events decides, in as many micro-batches as there are files, once it has caught up."""
    path, out = f"{p}/events.parquet", shared_folder(s, "decided")
    rows = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")  # a pattern: the table may be one file
    # rows of one time are taken in the order of their numbers
    lean = rows.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("tag"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    was = s.conf.get(setting)
    stateful.use_keyed_state(s)
    try:
        sink = decide(lean).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(setting, was)
    return s.read.parquet(out).withColumn("event_id", F.col("tag").cast("long"))


def throttle_stream(s: SparkSession, p: str) -> DataFrame:
    return _replayed(s, p, lambda rows: stateful.throttled(rows, "key", most=2, seconds=86_400, wait=False)).select("event_id", "allowed", "in_window", "reply")


def sightings_stream(s: SparkSession, p: str) -> DataFrame:
    return _replayed(s, p, lambda rows: stateful.first_sightings(rows, "key", hours=72, wait=False)).select("event_id", "fresh")


def _freshness(s: SparkSession, p: str) -> DataFrame:
    """On the day after the last one of all venues: those that end earlier are stale."""
    days = l1_daily(s, p)
    today = days.agg(F.date_add(F.max("date"), 1).cast("string")).first()[0]
    return r.freshness(s.createDataFrame([], "venue string, last_date date"), days, today)


def upserted_months(s: SparkSession, p: str) -> DataFrame:
    """Daily rows parted by month; the days of one month are revised, and one part is written again."""
    days = l1_daily(s, p).select("venue", "date", "revenue")
    kept = PartedTable(Store(s, shared_folder(s, "store")), "days", F.date_format("date", "yyyy-MM"))
    kept.upsert(days, ["venue", "date"])
    before = {m: kept.folders(m) for m in kept.parts()}
    kept.upsert(days.where("date between DATE'1997-01-01' and DATE'1997-01-31'").withColumn("revenue", F.lit(1.0)), ["venue", "date"])
    again = [m for m in kept.parts() if kept.folders(m) != before.get(m)]
    month = F.date_format("date", "yyyy-MM")
    sums = kept.read().groupBy(month.alias("month")).agg(F.count("*").alias("days"), F.round(F.sum("revenue"), 2).alias("revenue"))
    return sums.withColumn("written_again", F.col("month").isin(again))


def paged_orders(s: SparkSession, p: str) -> DataFrame:
    """Completed orders of two locations since a day, through the paged source: time, location and state are asked of the client."""
    paged.register(s)
    rows = s.read.format("paged_orders").option("path", f"{p}/orders.parquet").load()
    return rows.where("created_at >= TIMESTAMP_NTZ'1996-03-01' and location_id in (1, 3) and state = 'COMPLETED'").drop("page")


QUERIES = {
    "upserted_months": upserted_months,
    "paged_orders": paged_orders,
    "throttle_stream": throttle_stream,
    "sightings_stream": sightings_stream,
    "upserted": upserted,
    "accepted_days": accepted_days,
    "served_bands": lambda s, p: read_bands(*_forecasts(s, p)),
    "freshness": _freshness,
    "estate_freshness": lambda s, p: r.estate(_freshness(s, p)),
    "due_reminders": lambda s, p: r.due_reminders(tasks(s, p), "1996-01-01 00:00:00"),
    "expiry_reminders": lambda s, p: r.expiry_reminders(tasks(s, p).where("due_at is not null").select(F.col("task_id").alias("item_id"), F.to_date("due_at").alias("expires"), F.when(F.col("reminded"), F.array(F.lit(30), F.lit(7))).otherwise(F.array().cast("array<int>")).alias("stamped_leads")), "1996-01-01"),
    "next_runs": lambda s, p: stock(s, p).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "stock_id").select("stock_id", r.next_run(F.lit("2024-03-30 10:30:00").cast("timestamp"), "Europe/London", F.when(F.col("stock_id") % 3 == 0, "daily").when(F.col("stock_id") % 3 == 1, "weekly").otherwise("monthly"), (F.col("stock_id") % 24).cast("int"), (F.col("stock_id") % 7 + 1).cast("int")).cast("string").alias("next_run_at")),
    "nudges": lambda s, p: r.nudges(stock(s, p), stock(s, p).select("venue_id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("stock_id") % 48).cast("int"))).alias("cutoff_at")), "2024-01-01 05:00:00").withColumn("first_cutoff", F.col("first_cutoff").cast("timestamp_ntz")),
    "rate_limited": lambda s, p: r.rate_limited(s.read.parquet(f"{p}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at")), most=2, seconds=86_400).select("event_id", "allowed"),
}
_BANDS = f"{L1}, f AS (SELECT venue, 'L1' AS layer, CAST(NULL AS VARCHAR) AS key, date + 7 AS target_date, 'naive' AS model, revenue AS yhat FROM l1)"
#: Every user's events in order, in microseconds. Of the throttle's state the last two allowed hits and the last answer are carried.
_EVENTS = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_DAY = "86400000000"
ORACLES = {
    "upserted_months": f"""WITH {L1}, d AS (SELECT strftime(date, '%Y-%m') AS month, CASE WHEN month = '1997-01' THEN 1.0::DOUBLE ELSE revenue END AS revenue FROM l1)
      SELECT month, count(*) AS days, round(sum(revenue), 2) AS revenue, month = '1997-01' AS written_again FROM d GROUP BY month""",
    "paged_orders": """
      SELECT o_orderkey AS order_id, o_custkey % 5 AS location_id, 'COMPLETED' AS state, o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, false AS truncated
      FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 IN (1, 3) AND o_orderdate >= TIMESTAMP '1996-03-01'""",
    "throttle_stream": f"""WITH RECURSIVE {_EVENTS},
      f AS (
        SELECT event_id, user_id, k, true AS allowed, 1 AS in_window, false AS reply, CAST(NULL AS BIGINT) AS a, t AS b, CAST(NULL AS BIGINT) AS answered FROM e WHERE k = 1
        UNION ALL
        SELECT event_id, user_id, k, ok, live + ok::INTEGER, NOT ok AND due, CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN t ELSE b END, CASE WHEN NOT ok AND due THEN t ELSE answered END
        FROM (
          SELECT e.event_id, e.user_id, e.k, e.t, f.a, f.b, f.answered,
            coalesce((e.t - f.a < {_DAY})::INTEGER, 0) + (e.t - f.b < {_DAY})::INTEGER AS live,
            live < 2 AS ok, coalesce(e.t - f.answered > {_DAY} // 2, true) AS due
          FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
      SELECT event_id, allowed, in_window, reply FROM f""",
    "sightings_stream": f"""WITH RECURSIVE {_EVENTS},
      f AS (
        SELECT event_id, user_id, k, true AS fresh, t AS last FROM e WHERE k = 1
        UNION ALL
        SELECT e.event_id, e.user_id, e.k, e.t - f.last >= 3 * {_DAY}, CASE WHEN e.t - f.last >= 3 * {_DAY} THEN e.t ELSE f.last END
        FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT event_id, fresh FROM f""",
    "upserted": f"""WITH {L1}, d AS (SELECT venue, CASE WHEN dow = 0 THEN NULL ELSE dow END AS key, date, revenue FROM l1) SELECT venue, key, date, CASE WHEN date >= DATE '1997-01-01' THEN 0.0::DOUBLE ELSE revenue END AS revenue FROM d""",
    "accepted_days": f"""WITH {L1}, m AS (SELECT venue, max(date) AS mark FROM l1 WHERE date <= DATE '{EARLY}' OR venue = 'ASIA' GROUP BY venue) SELECT l1.venue, date, units FROM l1 LEFT JOIN m USING (venue) WHERE mark IS NULL OR date > mark""",
    "served_bands": f"WITH {_BANDS} SELECT f.*, level::DOUBLE AS level, round(yhat * (1 - level::DOUBLE), 4) AS lo, round(yhat * (1 + level::DOUBLE), 4) AS hi FROM f, (VALUES (0.8), (0.9)) AS v(level)",
    "freshness": f"""WITH {L1}, m AS (SELECT venue, max(date) AS last_date FROM l1 GROUP BY venue), t AS (SELECT max(last_date) + 1 AS today FROM m)
      SELECT venue, last_date, CAST(today - last_date AS INTEGER) AS days, today - last_date > 1 AS stale FROM m, t""",
    "estate_freshness": f"""WITH {L1}, m AS (SELECT venue, max(date) AS d FROM l1 GROUP BY venue)
      SELECT bool_or((SELECT max(d) FROM m) + 1 - d > 1) AS any_stale, max(d) AS newest, min(d) AS oldest, count(*) AS n FROM m""",
    "due_reminders": f"WITH {TASKS} SELECT * FROM tasks WHERE status = 'open' AND due_at <= TIMESTAMP '1996-01-01' AND NOT reminded ORDER BY due_at, task_id LIMIT 200",
    "expiry_reminders": f"""WITH {TASKS}, w AS (SELECT task_id AS item_id, lead, CAST(due_at AS DATE) - DATE '1996-01-01' AS days, reminded FROM tasks, (VALUES (30), (7), (1), (0)) AS v(lead) WHERE due_at IS NOT NULL)
      SELECT item_id, min(lead) AS fire, list(lead ORDER BY lead DESC) AS stamped FROM w WHERE days BETWEEN -30 AND 31 AND days <= lead AND NOT (reminded AND lead IN (30, 7)) GROUP BY item_id""",
    "nudges": f"""WITH {STOCK}, c AS (SELECT venue_id, min(TIMESTAMP '2024-01-01' + to_hours(CAST(stock_id % 48 AS INTEGER))) AS first_cutoff FROM stock WHERE stock_id % 48 BETWEEN 5 AND 11 GROUP BY venue_id)
      SELECT venue_id, count(*) AS n_below, any_value(first_cutoff) AS first_cutoff FROM stock JOIN c USING (venue_id) WHERE current < par GROUP BY venue_id""",
    "rate_limited": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      f AS (SELECT event_id, user_id, k, true AS allowed, NULL::TIMESTAMP AS a, CAST(ts AS TIMESTAMP) AS b FROM e WHERE k = 1
        UNION ALL
        SELECT e.event_id, e.user_id, e.k, coalesce(epoch_us(e.ts) - epoch_us(f.a) >= 86400000000, true), CASE WHEN coalesce(epoch_us(e.ts) - epoch_us(f.a) >= 86400000000, true) THEN f.b ELSE f.a END,
          CASE WHEN coalesce(epoch_us(e.ts) - epoch_us(f.a) >= 86400000000, true) THEN CAST(e.ts AS TIMESTAMP) ELSE f.b END
        FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
      SELECT event_id, allowed FROM f""",
}
