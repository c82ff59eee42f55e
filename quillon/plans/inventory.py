"""Queries of stock history, inboxes and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import inbox, inventory, signals, studies
from quillon.sources.views import MESSAGES, STOCK, messages, stock, table


def _panel(s: SparkSession, p: str) -> DataFrame:
    """Six snapshots, ten days apart, of every stock line; a third of the products changes its amount."""
    days = s.range(6).select(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") * 10).cast("int")).alias("snapshot_date"), F.col("id").alias("t"))
    qty = F.when(F.col("stock_id") % 3 == 0, F.pmod(F.col("current") - F.col("t"), F.lit(40))).otherwise(F.col("current"))
    dealt = stock(s, p).repartition("stock_id")  # a table of one file would be one task's work, and a product's rows stay together
    return dealt.join(F.broadcast(days)).select("snapshot_date", F.col("stock_id").alias("product"), F.concat_ws(" ", "name", (F.col("t") % 2).cast("string")).alias("name"), "category", qty.alias("qty"), (qty * F.col("price_cents")).alias("value"))  # six rows


PANEL = f"""{STOCK}, panel AS (SELECT DATE '2025-01-01' + CAST(10 * t AS INTEGER) AS snapshot_date, stock_id AS product, name || ' ' || CAST(t % 2 AS VARCHAR) AS name, category, q AS qty, q * price_cents AS value
  FROM (SELECT *, CASE WHEN stock_id % 3 = 0 THEN (current - t + 40) % 40 ELSE current END AS q FROM stock, range(6) AS r(t)))"""
CATEGORIES = ["ECONOMY", "STANDARD", "PROMO"]


def _weather(s: SparkSession, p: str) -> DataFrame:
    """Hourly readings of five cells from the event log."""
    e = table(s, p, "events")
    return e.select((F.col("user_id") % 5).alias("cell"), "ts", F.floor("value").cast("long").alias("temp"), (F.col("event_id") % 4).alias("rain"), (F.col("event_id") % 3 * 1200).alias("sun_seconds"))


WEATHER = "hourly AS (SELECT user_id % 5 AS cell, ts, CAST(floor(value) AS BIGINT) AS temp, event_id % 4 AS rain, event_id % 3 * 1200 AS sun_seconds FROM events)"
_DAILY = f"{WEATHER}, daily AS (SELECT cell, CAST(ts AS DATE) AS date, max(temp) AS temp_max, CAST(sum(rain) AS BIGINT) AS rain, sum(sun_seconds) / 3600 AS sun_hours FROM hourly GROUP BY cell, CAST(ts AS DATE))"


def _docs(s: SparkSession, p: str) -> DataFrame:
    d = table(s, p, "documents")
    k = F.col("doc_id") % 6
    return d.select("doc_id", F.when(k == 0, "failed").when(k < 4, "ready").otherwise("pending").alias("status"), F.when(k == 1, None).otherwise(F.col("lang")).alias("kind"), F.when(k == 2, '{"type": "menu"}').when(k == 3, "null").alias("proposal"), F.col("n_chars").alias("created_at"))


QUERIES = {
    "product_master": lambda s, p: inventory.product_master(_panel(s, p)),
    "snapshot_totals": lambda s, p: inventory.snapshot_totals(_panel(s, p), CATEGORIES),
    "dead_stock": lambda s, p: inventory.dead_stock(_panel(s, p)),
    "weather_daily": lambda s, p: signals.hourly_to_daily(_weather(s, p)),
    "climatology": lambda s, p: signals.climatology(signals.hourly_to_daily(_weather(s, p)), "temp_max"),
    "weather_skill": lambda s, p: signals.weather_skill(signals.hourly_to_daily(_weather(s, p)).select("cell", "date", F.col("temp_max").alias("temp"), "rain"), signals.hourly_to_daily(_weather(s, p)).select("cell", F.date_add("date", 3).alias("date"), F.col("temp_max").alias("temp"), "rain", F.lit(3).alias("lead"))),
    "dry_wet": lambda s, p: studies.dry_wet_contrast(signals.hourly_to_daily(_weather(s, p)).select("date", "rain", F.col("temp_max").alias("value")), 100),
    "inbox": lambda s, p: inbox.inbox(_docs(s, p)),
    "unread": lambda s, p: inbox.unread(messages(s, p), messages(s, p).where("conv_id % 2 = 0 and turn = 1").select("conv_id", F.col("created_at").alias("read_at"))),
    "question_topics": lambda s, p: studies.topics(messages(s, p).where("role = 'user'").select("conv_id", "turn", "text")).select("conv_id", "turn", "topic"),
}
ORACLES = {
    "product_master": f"""WITH {PANEL} SELECT product, arg_min(name, (snapshot_date, name)) AS first_name, arg_max(name, (snapshot_date, name)) AS last_name, count(DISTINCT snapshot_date) AS n_snapshots, round(avg(qty), 6) AS mean_qty, max(value) AS max_value, count(DISTINCT snapshot_date) >= 6 AS is_core FROM panel GROUP BY product""",
    "snapshot_totals": f"""WITH {PANEL} SELECT snapshot_date, {", ".join(f'''CAST(coalesce(sum(value) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS "{c}"''' for c in CATEGORIES)}, CAST(sum(value) AS BIGINT) AS value, count(*) AS n, count(*) FILTER (WHERE qty = 0) AS n_zero,
      round(100 * count(*) FILTER (WHERE qty = 0) / count(*), 4) AS zero_pct, CAST(snapshot_date - lag(snapshot_date) OVER (ORDER BY snapshot_date) AS INTEGER) AS days_since FROM panel GROUP BY snapshot_date""",
    "dead_stock": f"""WITH {PANEL}, still AS (SELECT product FROM panel GROUP BY product HAVING min(qty) = max(qty) AND min(qty) > 0 AND count(DISTINCT snapshot_date) > 1)
      SELECT panel.* FROM panel JOIN still USING (product) WHERE snapshot_date = (SELECT max(snapshot_date) FROM panel) ORDER BY value DESC, product LIMIT 8""",
    "weather_daily": f"WITH {_DAILY} SELECT * FROM daily",
    "climatology": f"""WITH {_DAILY}, d AS (SELECT cell, CAST(dayofyear(date) AS INTEGER) AS d, CAST(sum(temp_max) AS BIGINT) AS s, count(temp_max) AS n FROM daily GROUP BY ALL), x AS (SELECT cell, CAST((d - 1 + k + 366) % 366 + 1 AS INTEGER) AS doy, s, n FROM d, range(-15, 16) AS r(k))
      SELECT cell, doy, round(sum(s) / sum(n), 6) AS normal FROM x GROUP BY cell, doy""",
    "weather_skill": f"WITH {_DAILY} SELECT 3 AS lead, count(*) AS n, round(avg(abs(o.temp_max - f.temp_max)), 6) AS temp_mae, round(avg(abs(o.rain - f.rain)), 6) AS rain_mae FROM daily o JOIN daily f ON f.cell = o.cell AND o.date = f.date + 3",
    "dry_wet": f"""WITH {_DAILY} SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, count(*) FILTER (WHERE rain < 100) AS n_dry, count(*) FILTER (WHERE rain >= 100) AS n_wet, round(avg(temp_max) FILTER (WHERE rain < 100), 4) AS dry, round(avg(temp_max) FILTER (WHERE rain >= 100), 4) AS wet,
      round(avg(temp_max) FILTER (WHERE rain >= 100) / nullif(avg(temp_max) FILTER (WHERE rain < 100), 0), 6) AS ratio FROM daily GROUP BY 1""",
    "inbox": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN doc_id % 6 < 4 THEN 'ready' ELSE 'pending' END AS status, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE lang END AS kind, CASE WHEN doc_id % 6 = 2 THEN '{"type": "menu"}' WHEN doc_id % 6 = 3 THEN 'null' END AS proposal, n_chars AS created_at FROM documents)
      SELECT * FROM d WHERE status = 'failed' OR (status = 'ready' AND (kind IS NULL OR (proposal IS NOT NULL AND trim(proposal) <> 'null'))) ORDER BY created_at DESC, doc_id DESC LIMIT 200""",
    "unread": f"""WITH {MESSAGES}, r AS (SELECT conv_id, max(created_at) AS seen FROM messages WHERE conv_id % 2 = 0 AND turn = 1 GROUP BY conv_id) SELECT conv_id, count(*) AS n FROM messages LEFT JOIN r USING (conv_id) WHERE role = 'assistant' AND (seen IS NULL OR created_at > seen) GROUP BY conv_id""",
}
