"""Adapter views: retail and service entities over the driver's tables, as DataFrames and, for oracles, as SQL.

Money is kept in whole numbers (cents, or ten-thousandths where a rate multiplies cents), so that sums are exact and the
same in whatever order partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Venues that sell VAT-inclusive, and those kept out of the layers (fixed values of the adapter).
VAT_INCLUSIVE, EXCLUDED, VAT = ("EUROPE",), ("MIDDLE EAST",), 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column | str) -> Column:
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("long")


def venue_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, venue). Nations and regions are a fixed few dozen rows; the optimizer broadcasts them by their files' size."""
    t = lambda name: table(spark, sf_dir, name)
    venues = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("venue"))
    return t("customer").join(venues, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), "venue")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold line: lineitem with its order's day, its part's category and item and its customer's region as venue.

    Customers and parts grow with the lines: files small enough to be broadcast hold millions of them, which would pass the driver.
    """
    t = lambda name: table(spark, sf_dir, name)
    sold = t("orders").join(venue_of_customer(spark, sf_dir).hint("merge"), F.col("o_custkey") == F.col("custkey")).select("o_orderkey", "o_orderdate", "o_orderpriority", "venue")
    gross, off, vat = cents("l_extendedprice"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
    return (
        t("lineitem")
        .join(sold.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("transaction_id"), F.col("p_type").alias("category"), F.col("p_name").alias("item"), F.col("p_brand").alias("price_point"), F.col("o_orderpriority").alias("channel"), "venue",
            F.round("l_quantity").cast("long").alias("qty"), (gross * (100 - off)).alias("net_e4"), gross.alias("gross_cents"), (-gross * off).alias("disc_e4"), (gross * vat).alias("tax_e4"),
            F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("date"), F.col("venue").isin(*EXCLUDED).alias("excluded"),
        )
    )


LINE_ITEMS = """line_items AS (
  SELECT l_orderkey AS transaction_id, p_type AS category, p_name AS item, p_brand AS price_point, o_orderpriority AS channel, r_name AS venue,
         CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS net_e4, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_cents,
         -CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS disc_e4, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) AS tax_e4,
         o_orderdate AS ts, CAST(o_orderdate AS DATE) AS date, r_name = 'MIDDLE EAST' AS excluded
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as search analytics: error events are errors, views found nothing, the rest are hits."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", (F.col("user_id") % 5).alias("venue_id"), "user_id", F.concat(F.lit("q"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("query"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "no-data").otherwise("hit").alias("outcome"), "event_type", "value", F.col("ts").alias("created_at"),
    )


SEARCH_EVENTS = """search_events AS (
  SELECT event_id, user_id % 5 AS venue_id, user_id, 'q' || coalesce(json_extract_string(props, '$.k'), '') AS query,
         CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'no-data' ELSE 'hit' END AS outcome, event_type, value, ts AS created_at FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages with a time (an hour apart by conversation, a minute by turn), an owner and a channel derived from the conversation."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.col("conv_id") * 3600 + F.col("turn") * 60
    return c.select(
        "conv_id", "turn", "role", "text", (F.col("conv_id") % 40).alias("user_id"), (F.col("conv_id") % 5).alias("venue_id"), F.when(F.col("conv_id") % 3 == 0, "whatsapp").otherwise("web").alias("channel"),
        (start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("created_at"),
    )


MESSAGES = """messages AS (
  SELECT conv_id, turn, role, text, conv_id % 40 AS user_id, conv_id % 5 AS venue_id, CASE WHEN conv_id % 3 = 0 THEN 'whatsapp' ELSE 'web' END AS channel,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created_at FROM conversations)"""


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stock lines: par and current levels derived from the key, a venue, a supplier."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("stock_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), (k % 5).alias("venue_id"), (k % 10 + 1).alias("supplier_id"),
        F.col("p_size").cast("long").alias("par"), (k * 7 % 60).alias("current"), cents("p_retailprice").alias("price_cents"), F.when(k % 11 == 0, None).otherwise(k % 9).alias("weekly_use"),
    )


STOCK = """stock AS (
  SELECT p_partkey AS stock_id, p_name AS name, p_type AS category, p_brand AS brand, p_partkey % 5 AS venue_id, p_partkey % 10 + 1 AS supplier_id, CAST(p_size AS BIGINT) AS par, p_partkey * 7 % 60 AS current,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 9 END AS weekly_use FROM part)"""


def pos_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-of-sale orders as nested documents: each with its line items as an array of structs."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("variation_id"), F.round("l_quantity").cast("long").alias("quantity"), cents("l_extendedprice").alias("gross_cents"), F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"), F.col("l_returnflag").alias("modifier")))).alias("line_items")
    )
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 5).alias("location_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CANCELED").alias("state"),
        F.col("o_orderdate").alias("created_at"), cents("o_totalprice").alias("total_cents"), F.coalesce("line_items", F.array().cast("array<struct<line:int,variation_id:bigint,quantity:bigint,gross_cents:bigint,discount_pct:bigint,modifier:string>>")).alias("line_items"),
    )


POS_LINES = """pos_lines AS (
  SELECT o_orderkey AS order_id, o_custkey % 5 AS location_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'OPEN' ELSE 'CANCELED' END AS state, o_orderdate AS created_at,
         l_partkey AS variation_id, CAST(round(l_quantity) AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_cents, CAST(round(l_discount * 100) AS BIGINT) AS discount_pct, l_returnflag AS modifier
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = cents("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("payment_id"), (F.col("o_custkey") % 5).alias("location_id"), F.col("o_orderpriority").alias("source_type"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("FAILED").alias("status"),
        amount.alias("amount_cents"), (amount % 500).alias("tip_cents"), F.col("o_orderdate").alias("created_at"),
    )


PAYMENTS = """payments AS (
  SELECT o_orderkey AS payment_id, o_custkey % 5 AS location_id, o_orderpriority AS source_type, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'APPROVED' ELSE 'FAILED' END AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, CAST(round(o_totalprice * 100) AS BIGINT) % 500 AS tip_cents, o_orderdate AS created_at FROM orders)"""


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shifts: a member, a job, minutes worked (null: still open), and the hourly rate."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("shift_id"), (F.col("o_custkey") % 50).alias("member_id"), F.col("o_orderpriority").alias("job"), (F.col("o_custkey") % 5).alias("location_id"), F.col("o_orderdate").alias("start_at"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(180 + F.col("o_orderkey") % 360).alias("minutes"),
    )


SHIFTS = """shifts AS (
  SELECT o_orderkey AS shift_id, o_custkey % 50 AS member_id, o_orderpriority AS job, o_custkey % 5 AS location_id, o_orderdate AS start_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 180 + o_orderkey % 360 END AS minutes FROM orders)"""


def scheduled_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a rota: each with a draft and, unless the order is open, a published version half an hour longer; some are deleted, some end before they start."""
    o = table(spark, sf_dir, "orders")
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    minutes = F.when(k % 23 == 0, -30).otherwise(180 + k % 360)
    version = lambda more: F.struct(
        (F.col("o_custkey") % 50).alias("member_id"), F.col("o_orderpriority").alias("job"), (F.col("o_custkey") % 5).alias("location_id"), start.alias("start_at"), (start + F.make_dt_interval(mins=(minutes + more).cast("int"))).alias("end_at"),
        (k % 19 == 0).alias("is_deleted"),
    )
    return o.select(k.alias("shift_id"), version(0).alias("draft"), F.when(F.col("o_orderstatus") != "O", version(30)).alias("published"))


SCHEDULED = """scheduled AS (
  SELECT o_orderkey AS shift_id, o_custkey % 50 AS member_id, o_orderpriority AS job, o_custkey % 5 AS location_id, CAST(o_orderdate AS TIMESTAMP) AS start_at, o_orderstatus <> 'O' AS is_published, o_orderkey % 19 = 0 AS is_deleted,
         CASE WHEN o_orderkey % 23 = 0 THEN -30 ELSE 180 + o_orderkey % 360 END + CASE WHEN o_orderstatus <> 'O' THEN 30 ELSE 0 END AS minutes FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks with a due time and a status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("assignee_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_orderpriority").alias("severity"),
        F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderdate")).alias("due_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4 == 0).alias("reminded"),
    )


TASKS = """tasks AS (
  SELECT o_orderkey AS task_id, o_custkey % 50 AS assignee_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, o_orderpriority AS severity,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS due_at, o_orderdate AS created_at, o_orderkey % 4 = 0 AS reminded FROM orders)"""
