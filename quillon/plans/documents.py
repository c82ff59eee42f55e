"""Queries of nested JSON documents, built from orders, lines and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import documents as d
from quillon.sources.views import cents, table

_STATES = {"F": "COMPLETED", "O": "OPEN", "P": "CANCELED"}


def _state(c: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair)), F.col(c))


def _money(c: Column) -> Column:
    return F.struct(c.alias("amount"), F.lit("GBP").alias("currency"))


def _json(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("document"))


def _orders(s: SparkSession, p: str) -> DataFrame:
    return table(s, p, "orders")


def _id() -> Column:
    return F.col("o_orderkey").alias("id")


def _place() -> Column:
    return (F.col("o_custkey") % 5).alias("location_id")


def _total() -> Column:
    return cents("o_totalprice")


def _at() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")


def json_orders(s: SparkSession, p: str) -> DataFrame:
    docs = _json(_orders(s, p), _id(), _place(), _state("o_orderstatus").alias("state"), _at().alias("created_at"), _money(_total()).alias("total_money"))
    return d.rows_of(docs, "order")


def json_lines(s: SparkSession, p: str) -> DataFrame:
    """Orders with their lines nested; returned lines carry a modifier."""
    modifiers = F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.lit("returned").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    line = F.struct(
        F.col("l_linenumber").alias("uid"), F.col("l_partkey").alias("catalog_object_id"), F.round("l_quantity").cast("long").cast("string").alias("quantity"),
        _money(cents("l_extendedprice")).alias("gross_sales_money"), modifiers.alias("modifiers"),
    )
    held = table(s, p, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("line_items"))
    docs = _json(_orders(s, p).join(held, F.col("o_orderkey") == F.col("l_orderkey")), _id(), _state("o_orderstatus").alias("state"), "line_items")
    return d.rows_of(docs, "line")


def json_payments(s: SparkSession, p: str) -> DataFrame:
    """Every seventh payment has no tip, every eleventh an amount that is no number."""
    amount = F.when(F.col("o_orderkey") % 11 == 0, F.lit("unknown")).otherwise(_total().cast("string"))
    tip = F.when(F.col("o_orderkey") % 7 != 0, _money(_total() % 500))
    docs = _json(_orders(s, p), _id(), _place(), _state("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source_type"), F.struct(amount.alias("amount")).alias("amount_money"), tip.alias("tip_money"))
    return d.rows_of(docs, "payment")


def json_refunds(s: SparkSession, p: str) -> DataFrame:
    back = table(s, p, "lineitem").where("l_returnflag = 'R'")
    docs = _json(back, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("payment_id"), F.lit("COMPLETED").alias("status"), _money(cents("l_extendedprice")).alias("amount_money"))
    return d.rows_of(docs, "refund")


def json_shifts(s: SparkSession, p: str) -> DataFrame:
    """An order that is neither filled nor open is a shift without an end."""
    end = F.when(F.col("o_orderstatus") != "P", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd HH:mm:ss"))
    wage = F.struct(F.col("o_orderpriority").alias("title"), F.struct(_money(1000 + F.col("o_custkey") % 500).alias("hourly_rate")).alias("inner"))
    wage = F.struct(wage["title"].alias("title"), wage["inner"]["hourly_rate"].alias("hourly_rate"))
    docs = _json(_orders(s, p), _id(), (F.col("o_custkey") % 50).alias("team_member_id"), _at().alias("start_at"), end.alias("end_at"), wage.alias("wage"))
    return d.rows_of(docs, "shift")


def json_invoices(s: SparkSession, p: str) -> DataFrame:
    paid = F.when(F.col("o_orderstatus") == "F", _total()).otherwise(0)
    request = F.struct(_money(_total()).alias("computed_amount_money"), _money(paid).alias("total_completed_amount_money"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("due_date"))
    return d.rows_of(_json(_orders(s, p), _id(), _state("o_orderstatus").alias("status"), F.array(request).alias("payment_requests")), "invoice")


def json_bookings(s: SparkSession, p: str) -> DataFrame:
    """Orders as bookings of one to three segments."""
    parts = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda k: F.struct((30 + 15 * k).alias("duration_minutes"), (F.col("o_custkey") % 50 + k).alias("team_member_id")))
    return d.rows_of(_json(_orders(s, p), _id(), _state("o_orderstatus").alias("status"), _at().alias("start_at"), parts.alias("appointment_segments")), "booking")


def json_tool_calls(s: SparkSession, p: str) -> DataFrame:
    """Events as messages that called as many tools as their key modulo 4; every ninth log is cut off in the middle."""
    k = F.col("event_id")
    calls = F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.struct(F.concat("event_type", i.cast("string")).alias("name"), (F.col("event_type") == "error").alias("error")))
    calls = F.when(k % 4 > 0, calls).otherwise(F.array().cast("array<struct<name:string,error:boolean>>"))
    docs = table(s, p, "events").select(k.alias("id"), calls.alias("calls")).select("id", F.to_json(F.struct("id", "calls")).alias("j"))
    return d.rows_of(docs.select(F.when(F.col("id") % 9 == 0, F.expr("left(j, 12)")).otherwise(F.col("j")).alias("document")), "tool_call")


def event_numbers(s: SparkSession, p: str) -> DataFrame:
    """The number that each event's own JSON holds."""
    numbers = d.Mapper({"k": ("$.k", "bigint")})
    return d.rows_of(table(s, p, "events"), numbers, "props").groupBy("k").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (json_orders, json_lines, json_payments, json_refunds, json_shifts, json_invoices, json_bookings, json_tool_calls, event_numbers)}

_STATE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'OPEN' ELSE 'CANCELED' END"
_TOTAL_SQL = "CAST(round(o_totalprice * 100) AS BIGINT)"
ORACLES = {
    "json_orders": f"SELECT o_orderkey AS order_id, o_custkey % 5 AS location_id, {_STATE_SQL} AS state, o_orderdate AS created_at, {_TOTAL_SQL} AS total, 'GBP' AS currency FROM orders",
    "json_lines": f"""SELECT o_orderkey AS order_id, {_STATE_SQL} AS state, l_linenumber AS line, l_partkey AS variation_id, CAST(round(l_quantity) AS BIGINT) AS quantity,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS modifier FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "json_payments": f"""SELECT o_orderkey AS payment_id, o_custkey % 5 AS location_id, {_STATE_SQL} AS status, o_orderpriority AS source_type,
      CASE WHEN o_orderkey % 11 <> 0 THEN {_TOTAL_SQL} END AS amount, CASE WHEN o_orderkey % 7 <> 0 THEN {_TOTAL_SQL} % 500 END AS tip FROM orders""",
    "json_refunds": """SELECT l_orderkey * 10 + l_linenumber AS refund_id, l_orderkey AS payment_id, 'COMPLETED' AS status, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(NULL AS VARCHAR) AS reason
      FROM lineitem WHERE l_returnflag = 'R'""",
    "json_shifts": """SELECT o_orderkey AS shift_id, o_custkey % 50 AS member_id, o_orderdate AS start_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 6 HOUR END AS end_at,
      o_orderpriority AS job, 1000 + o_custkey % 500 AS rate FROM orders""",
    "json_invoices": f"""SELECT o_orderkey AS invoice_id, {_STATE_SQL} AS status, {_TOTAL_SQL} AS due, CASE WHEN o_orderstatus = 'F' THEN {_TOTAL_SQL} ELSE 0 END AS paid,
      CAST(o_orderdate AS DATE) + 30 AS due_date FROM orders""",
    "json_bookings": f"""SELECT o_orderkey AS booking_id, {_STATE_SQL} AS status, o_orderdate AS start_at, CAST(30 + 15 * k AS INTEGER) AS minutes, o_custkey % 50 + k AS member_id
      FROM orders, range(3) AS r(k) WHERE k <= o_orderkey % 3""",
    "json_tool_calls": """SELECT event_id AS message_id, event_type || CAST(k AS VARCHAR) AS tool, event_type = 'error' AS failed FROM events, range(1, 4) AS r(k) WHERE k <= event_id % 4 AND event_id % 9 <> 0""",
    "event_numbers": "SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
