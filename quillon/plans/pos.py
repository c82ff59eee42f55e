"""Queries of the point of sale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import pos
from quillon.sources.views import PAYMENTS, POS_LINES, SCHEDULED, SHIFTS, cents, payments, pos_orders, scheduled_shifts, shifts, table

NOW = "2001-12-01 00:00:00"


def _lines(s: SparkSession, p: str) -> DataFrame:
    return pos.exploded(pos_orders(s, p))


def _catalog(s: SparkSession, p: str) -> DataFrame:
    """Items with their category; every 17th is not in the catalog."""
    return table(s, p, "part").where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("variation_id"), F.col("p_type").alias("category"))


def _costs(s: SparkSession, p: str) -> DataFrame:
    li = table(s, p, "lineitem").where("l_partkey % 3 <> 0")
    return pos.item_unit_costs(li.select(F.col("l_partkey").alias("variation_id"), F.round("l_quantity").cast("long").alias("quantity"), (F.col("l_partkey") % 900 + 100).alias("unit_cents")))


def _wages(s: SparkSession, p: str) -> DataFrame:
    """A rate for each member and job, for some members only; and a general one for others."""
    m = s.range(50).select(F.col("id").alias("member_id"))
    jobs = table(s, p, "orders").select(F.col("o_orderpriority").alias("job")).distinct()
    own = m.where("member_id % 2 = 0").join(F.broadcast(jobs)).select("member_id", "job", (1000 + F.col("member_id") * 10 + F.length("job")).alias("rate_cents"))  # fifty members by a handful of jobs
    return own.unionByName(m.where("member_id % 3 = 0").select("member_id", F.lit(None).cast("string").alias("job"), (F.col("member_id") * 7 + 900).alias("rate_cents")))


def _refunds(s: SparkSession, p: str) -> DataFrame:
    return table(s, p, "lineitem").where("l_returnflag = 'R'").select(cents("l_extendedprice").alias("gross_cents"))


def pos_scheduled(s: SparkSession, p: str) -> DataFrame:
    """The rota of two years, published shifts only."""
    return pos.scheduled_labour(scheduled_shifts(s, p), _wages(s, p), "1995-01-01", "1997-01-01")


def pos_gift_cards(s: SparkSession, p: str) -> DataFrame:
    """Customers' accounts as gift cards: every fourth is spent, every seventh has no balance."""
    k = F.col("c_custkey")
    cards = table(s, p, "customer").select(F.when(k % 4 == 0, "DEACTIVATED").otherwise("ACTIVE").alias("state"), F.when(k % 7 != 0, F.abs(cents("c_acctbal"))).alias("balance_cents"))
    return pos.gift_card_liability(cards)


def pos_customers(s: SparkSession, p: str) -> DataFrame:
    k = F.col("c_custkey")
    email = F.when(k % 3 == 0, None).when(k % 5 == 0, "").otherwise(F.lower("c_name"))
    created = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval((k % 90).cast("int"))
    return pos.customer_summary(table(s, p, "customer").select(email.alias("email"), F.when(k % 2 == 0, F.col("c_name")).alias("phone"), created.alias("created_at")), NOW)


def pos_loyalty(s: SparkSession, p: str) -> DataFrame:
    """Regions as programmes, customers as accounts, some without a balance."""
    programs = table(s, p, "region").select(F.col("r_name").alias("program_id"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("points_name"), F.col("r_regionkey").alias("position"))
    k = F.col("c_custkey")
    return pos.loyalty_summary(programs, table(s, p, "customer").select(F.when(k % 6 != 0, k % 400).alias("balance")))


def pos_bookings(s: SparkSession, p: str) -> DataFrame:
    """Orders as bookings, as seen at the start of 1997, thirty days ahead."""
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "ACCEPTED").when(k % 4 == 1, "PENDING").when(k % 4 == 2, "CANCELLED_BY_SELLER").otherwise(F.lit(None))
    rows = table(s, p, "orders").select((F.col("o_custkey") % 5).alias("location_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_at"))
    return pos.booking_summary(rows, "1997-01-01", 720)


def pos_percent(s: SparkSession, p: str) -> DataFrame:
    """What parts cost by a percentage of their price; some percentages are out of range."""
    cost, margin = pos.cogs_from_percent(cents("p_retailprice") / 100, F.col("p_partkey") % 110)
    return table(s, p, "part").select("p_partkey", cost.alias("cogs"), margin.alias("margin"))


QUERIES = {f.__name__: f for f in (pos_scheduled, pos_gift_cards, pos_customers, pos_loyalty, pos_bookings, pos_percent)} | {
    "pos_sales": lambda s, p: pos.sales_summary(pos_orders(s, p)),
    "pos_top_items": lambda s, p: pos.top_items(_lines(s, p)),
    "pos_categories": lambda s, p: pos.category_sales(_lines(s, p), _catalog(s, p)),
    "pos_modifiers": lambda s, p: pos.modifier_popularity(_lines(s, p)),
    "pos_discounts": lambda s, p: pos.discount_usage(_lines(s, p)),
    "pos_tenders": lambda s, p: pos.payment_breakdown(payments(s, p)),
    "pos_refunds": lambda s, p: pos.refund_summary(_refunds(s, p), table(s, p, "lineitem").select(cents("l_extendedprice").alias("gross_cents"))),
    "pos_hourly": lambda s, p: pos.hourly(payments(s, p).withColumnRenamed("amount_cents", "total_cents"), "Europe/London"),
    "pos_labour": lambda s, p: pos.labour_summary(shifts(s, p), _wages(s, p), NOW),
    "pos_cogs": lambda s, p: pos.cogs_summary(_lines(s, p), _costs(s, p)),
    "pos_uncosted": lambda s, p: pos.top_uncosted(_lines(s, p), _costs(s, p)),
    "pos_compare": lambda s, p: pos.compare_periods(payments(s, p).withColumnRenamed("amount_cents", "total_cents"), "1995-01-01 00:00:00"),
    "pos_invoices": lambda s, p: pos.open_balances(payments(s, p), "1996-01-01 00:00:00"),
    "pos_drawers": lambda s, p: pos.drawer_variance(payments(s, p).select("location_id", F.col("amount_cents").alias("expected_cents"), (F.col("amount_cents") + F.when(F.col("payment_id") % 5 == 0, F.col("payment_id") % 40 - 20).otherwise(0)).alias("counted_cents"))),
}

_LINES = f"{POS_LINES}, sold AS (SELECT * FROM pos_lines WHERE state = 'COMPLETED')"
_NET = "(gross_cents - CAST(floor((gross_cents * discount_pct + 50) / 100) AS BIGINT))"
_COSTS = """receipts AS (SELECT l_partkey AS variation_id, CAST(round(l_quantity) AS BIGINT) AS n, l_partkey % 900 + 100 AS u FROM lineitem WHERE l_partkey % 3 <> 0 AND round(l_quantity) > 0),
  costs AS (SELECT variation_id, CAST(sum(n * u) // sum(n) AS BIGINT) AS unit_cost FROM receipts GROUP BY variation_id HAVING sum(n * u) > 0)"""
_WAGES = """m AS (SELECT k AS member_id FROM range(50) AS r(k)), own AS (SELECT member_id, job, 1000 + member_id * 10 + length(job) AS r1 FROM m, (SELECT DISTINCT o_orderpriority AS job FROM orders) WHERE member_id % 2 = 0),
  general AS (SELECT member_id, member_id * 7 + 900 AS r2 FROM m WHERE member_id % 3 = 0)"""
_BY_ITEM = f"{_LINES}, {_COSTS}, items AS (SELECT s.variation_id, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(gross_cents) AS BIGINT) AS g, any_value(unit_cost) AS unit_cost FROM sold s LEFT JOIN costs c ON c.variation_id = s.variation_id GROUP BY s.variation_id)"
ORACLES = {
    "pos_sales": f"""WITH {_LINES}, n AS (SELECT location_id, count(DISTINCT o_orderkey) AS k FROM (SELECT o_custkey % 5 AS location_id, o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY location_id)
      SELECT location_id, any_value(k) AS n_orders, CAST(sum(gross_cents) AS BIGINT) AS gross, CAST(sum(gross_cents) - sum({_NET}) AS BIGINT) AS discount, CAST(sum({_NET}) AS BIGINT) AS net, round(sum({_NET}) / any_value(k), 4) AS average FROM n JOIN sold USING (location_id) GROUP BY location_id""",
    "pos_top_items": f"WITH {_LINES} SELECT variation_id, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(gross_cents) AS BIGINT) AS gross, count(DISTINCT order_id) AS n_orders FROM sold GROUP BY variation_id ORDER BY gross DESC, variation_id LIMIT 50",
    "pos_categories": f"""WITH {_LINES}, c AS (SELECT coalesce(p_type, 'Uncategorised') AS category, quantity, gross_cents FROM sold LEFT JOIN (SELECT * FROM part WHERE p_partkey % 17 <> 0) ON p_partkey = variation_id)
      SELECT category, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(gross_cents) AS BIGINT) AS gross, round(sum(gross_cents) / (SELECT sum(gross_cents) FROM c), 6) AS share FROM c GROUP BY category""",
    "pos_modifiers": f"WITH {_LINES} SELECT modifier, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM sold WHERE quantity > 0 GROUP BY modifier",
    "pos_discounts": f"WITH {_LINES} SELECT discount_pct, count(*) AS n, count(DISTINCT order_id) AS n_orders, CAST(sum(gross_cents - {_NET}) AS BIGINT) AS amount FROM sold WHERE discount_pct > 0 GROUP BY discount_pct",
    "pos_tenders": f"""WITH {PAYMENTS}, t AS (SELECT *, CASE WHEN source_type IN ('CARD', '1-URGENT', '2-HIGH') THEN 'CARD' WHEN source_type IN ('CASH', '3-MEDIUM') THEN 'CASH' ELSE 'OTHER' END AS tender FROM payments WHERE status IN ('COMPLETED', 'APPROVED'))
      SELECT tender, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS amount, CAST(sum(tip_cents) AS BIGINT) AS tips, round(avg(amount_cents), 4) AS average FROM t GROUP BY ROLLUP (tender)""",
    "pos_refunds": """WITH l AS (SELECT l_returnflag AS f, CAST(round(l_extendedprice * 100) AS BIGINT) AS g FROM lineitem)
      SELECT count(*) FILTER (WHERE f = 'R') AS n, CAST(coalesce(sum(g) FILTER (WHERE f = 'R'), 0) AS BIGINT) AS amount, CAST(coalesce(sum(g), 0) AS BIGINT) AS gross, round(coalesce(sum(g) FILTER (WHERE f = 'R'), 0) / nullif(sum(g), 0), 6) AS rate FROM l""",
    "pos_hourly": f"""WITH {PAYMENTS}, h AS (SELECT CAST(hour(timezone('Europe/London', timezone('UTC', created_at))) AS INTEGER) AS hour, amount_cents FROM payments)
      SELECT CAST(k AS INTEGER) AS hour, count(amount_cents) AS n, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total FROM range(24) AS r(k) LEFT JOIN h ON hour = k GROUP BY k""",
    "pos_labour": f"""WITH {SHIFTS}, {_WAGES},
      x AS (SELECT s.*, coalesce(minutes, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(start_at)) // 60000000)) AS mins, coalesce(r1, r2) AS rate FROM shifts s LEFT JOIN own USING (member_id, job) LEFT JOIN general g ON g.member_id = s.member_id)
      SELECT location_id, count(*) AS n_shifts, count(*) FILTER (WHERE minutes IS NULL) AS n_open, round(sum(mins) / 60, 4) AS hours, CAST(coalesce(sum(rate * mins // 60), 0) AS BIGINT) AS cost, count(*) FILTER (WHERE rate IS NULL) AS n_uncosted FROM x GROUP BY location_id""",
    "pos_cogs": f"""WITH {_BY_ITEM}, t AS (SELECT count(*) AS n, CAST(coalesce(sum(g), 0) AS BIGINT) AS gross, CAST(sum(q * unit_cost) AS BIGINT) AS cogs, count(*) FILTER (WHERE unit_cost IS NULL) AS n_uncosted FROM items),
      c AS (SELECT *, CASE WHEN n > 0 THEN floor(10000 * (n - n_uncosted) / n + 0.5) / 100 ELSE 0 END AS coverage FROM t)
      SELECT gross, cogs, coverage, CASE WHEN coverage >= 50 AND gross > 0 THEN floor(10000 * (gross - cogs) / gross + 0.5) / 100 END AS margin, n_uncosted, coverage < 50 AS ask_percent,
        CASE WHEN gross = 0 THEN 'no-completed-orders' WHEN coverage = 0 THEN 'no-known-costs' END AS no_data FROM c""",
    "pos_scheduled": f"""WITH {SCHEDULED}, {_WAGES}, x AS (
        SELECT s.*, coalesce(r1, r2) AS rate FROM scheduled s LEFT JOIN own USING (member_id, job) LEFT JOIN general g ON g.member_id = s.member_id
        WHERE is_published AND NOT is_deleted AND minutes > 0 AND start_at >= TIMESTAMP '1995-01-01' AND start_at < TIMESTAMP '1997-01-01')
      SELECT location_id, count(*) AS n_shifts, round(sum(minutes) / 60, 2) AS hours, CAST(sum(rate * CAST(round(minutes * 60 * 2500 / 9) AS BIGINT) // 1000000) AS BIGINT) AS cost,
        floor(10000 * count(rate) / count(*) + 0.5) / 100 AS coverage, count(*) FILTER (WHERE rate IS NULL) AS n_uncosted FROM x GROUP BY location_id""",
    "pos_gift_cards": "SELECT count(*) AS n_active, CAST(sum(abs(CAST(round(c_acctbal * 100) AS BIGINT))) FILTER (WHERE c_custkey % 7 <> 0) AS BIGINT) AS liability FROM customer WHERE c_custkey % 4 <> 0",
    "pos_customers": """SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0) AS with_email, count(*) FILTER (WHERE c_custkey % 2 = 0) AS with_phone,
      count(*) FILTER (WHERE c_custkey % 90 < 30) AS n_new FROM customer""",
    "pos_loyalty": """SELECT arg_min(r_name, r_regionkey) AS program_id, 'ACTIVE' AS status, 'points' AS points_name, (SELECT count(*) FROM customer) AS n_accounts,
      (SELECT CAST(sum(c_custkey % 400) AS BIGINT) FROM customer WHERE c_custkey % 6 <> 0) AS points FROM region""",
    "pos_bookings": """SELECT o_custkey % 5 AS location_id, count(*) AS n_upcoming, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS n_accepted, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS n_pending,
      count(*) FILTER (WHERE o_orderkey % 4 = 2) AS n_cancelled, CAST(min(o_orderdate) AS TIMESTAMP) AS next_at FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-01-31' GROUP BY o_custkey % 5""",
    "pos_percent": """SELECT p_partkey, CASE WHEN p_partkey % 110 <= 100 THEN floor(round(p_retailprice * 100) / 100 * (p_partkey % 110) / 100 * 100 + 0.5) / 100 END AS cogs,
      CASE WHEN p_partkey % 110 <= 100 THEN floor((100 - p_partkey % 110) * 100.0 + 0.5) / 100 END AS margin FROM part""",
    "pos_uncosted": f"WITH {_BY_ITEM} SELECT variation_id, g AS gross FROM items WHERE unit_cost IS NULL ORDER BY gross DESC, variation_id LIMIT 10",
    "pos_compare": f"""WITH {PAYMENTS}, s AS (SELECT count(*) FILTER (WHERE created_at < TIMESTAMP '1995-01-01') AS o0, count(*) FILTER (WHERE created_at >= TIMESTAMP '1995-01-01') AS o1, CAST(coalesce(sum(amount_cents) FILTER (WHERE created_at < TIMESTAMP '1995-01-01'), 0) AS BIGINT) AS t0,
      CAST(coalesce(sum(amount_cents) FILTER (WHERE created_at >= TIMESTAMP '1995-01-01'), 0) AS BIGINT) AS t1 FROM payments), r AS (SELECT 'orders' AS metric, o0 AS before, o1 AS after FROM s UNION ALL SELECT 'total', t0, t1 FROM s)
      SELECT *, after - before AS delta, round(100 * (after - before) / nullif(before, 0), 4) AS percent FROM r""",
    "pos_invoices": f"""WITH {PAYMENTS} SELECT count(*) FILTER (WHERE status <> 'COMPLETED') AS n_open, CAST(coalesce(sum(amount_cents) FILTER (WHERE status <> 'COMPLETED'), 0) AS BIGINT) AS amount, min(created_at) FILTER (WHERE status <> 'COMPLETED') AS first_due,
      count(*) FILTER (WHERE status <> 'COMPLETED' AND created_at < TIMESTAMP '1996-01-01') AS n_overdue FROM payments""",
    "pos_drawers": f"""WITH {PAYMENTS}, d AS (SELECT location_id, amount_cents AS e, amount_cents + CASE WHEN payment_id % 5 = 0 THEN payment_id % 40 - 20 ELSE 0 END AS c FROM payments)
      SELECT location_id, count(*) AS n, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(c) AS BIGINT) AS counted, CAST(sum(c - e) AS BIGINT) AS variance, count(*) FILTER (WHERE c <> e) AS n_off FROM d GROUP BY location_id""",
}
