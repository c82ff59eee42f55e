"""Queries of the layers: days, calendars, features, folds, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.calendar import BANK_HOLIDAY_SQL, EASTERS_SQL, SCHOOL_TERM_SQL, UNI_PHASE_SQL
from quillon.operators import features, layers, metrics
from quillon.sources.views import LINE_ITEMS, line_items

_SUMS = """sum(net_e4) / 10000 AS revenue, CASE WHEN venue = 'EUROPE' THEN sum(net_e4) / (10000 * 1.2::DOUBLE) ELSE sum(net_e4) / 10000 END AS revenue_exvat, CAST(sum(qty) AS BIGINT) AS units,
      sum(disc_e4) / 10000 AS discounts, count(*) AS n_lines, count(DISTINCT transaction_id) AS n_transactions, CAST(dayofweek(date) AS INTEGER) AS dow"""

#: A day within the data from which another price list is taken to hold.
PRICES_CHANGED = "1998-07-01"

L1 = f"{LINE_ITEMS}, l1 AS (SELECT venue, date, {_SUMS} FROM line_items WHERE NOT excluded GROUP BY venue, date)"
SERIES = f"""{L1}, spans AS (SELECT venue, min(date) AS a, max(date) AS b FROM l1 GROUP BY venue),
  calendar AS (SELECT venue, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans),
  series AS (SELECT venue, date, coalesce(revenue, 0) AS value FROM calendar LEFT JOIN l1 USING (venue, date))"""
FOLDS = f"""{SERIES}, bounds AS (SELECT venue, min(date) AS first, max(date) AS last FROM series GROUP BY venue),
  cuts AS (SELECT venue, CAST(k AS INTEGER) AS fold, first, last - CAST(7 * k AS INTEGER) AS done, last - CAST(7 * k + 7 AS INTEGER) AS cut FROM bounds, range(6) AS r(k)),
  folds AS (SELECT s.venue, fold, date, value, CASE WHEN date <= cut THEN 'train' ELSE 'test' END AS role FROM series s JOIN cuts c ON s.venue = c.venue AND date <= done WHERE cut - first + 1 >= 120)"""
NAIVE = f"""{FOLDS}, naive AS (SELECT t.venue, t.fold, t.date, t.value AS y, p.value AS yhat FROM folds t JOIN folds p ON p.venue = t.venue AND p.fold = t.fold AND p.role = 'train' AND p.date = t.date - 7 WHERE t.role = 'test')"""


def l1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(line_items(spark, sf_dir), "L1")


def l2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(line_items(spark, sf_dir), "L2")


def l3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer(line_items(spark, sf_dir), "L3")


def series_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.daily_series(l1_daily(spark, sf_dir))


def l1_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(spark, sf_dir)


def spike_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.spike_days(line_items(spark, sf_dir), 0.05)


def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.manifest(line_items(spark, sf_dir))


def active_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.active_span(series_of(spark, sf_dir))


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.top_items(l3_daily(spark, sf_dir)).withColumn("total", F.round("total", 2))


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.calendar_features(series_of(spark, sf_dir), price_break=PRICES_CHANGED)


def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.history_features(series_of(spark, sf_dir), ["venue"])


def rolling_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rolling_peak(series_of(spark, sf_dir), ["venue"])


def term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the data after which a school term begins or ends."""
    return features.term_changes(series_of(spark, sf_dir))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.time_split(series_of(spark, sf_dir)).groupBy("venue", "split").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def fold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.assert_no_leakage(features.rolling_origin(series_of(spark, sf_dir)))


def venue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.leave_one_venue_out(l1_daily(spark, sf_dir).select("venue").distinct())


def naive_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasonal naive forecast of every fold's test days, with the fold's scale."""
    folds = features.rolling_origin(series_of(spark, sf_dir))
    train = folds.where("role = 'train'")
    past = train.select("venue", "fold", F.date_add("date", 7).alias("date"), F.col("value").alias("yhat"))
    return folds.where("role = 'test'").select("venue", "fold", "date", F.col("value").alias("y")).join(past, ["venue", "fold", "date"]).join(metrics.mase_scale(train, ["venue", "fold"]), ["venue", "fold"])


def naive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_metrics(naive_scored(spark, sf_dir), ["venue", "fold"])


def lag_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series_of(spark, sf_dir)
    past = s.select("venue", F.date_add("date", 7).alias("date"), F.col("value").alias("yhat"))
    return s.select("venue", "date", F.col("value").alias("y")).join(past, ["venue", "date"])


def conformal_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lag_residuals(spark, sf_dir).select("venue", F.when(F.weekday("date").isin(0, 1), "Mon-Tue").otherwise("rest").alias("regime"), F.abs(F.col("y") - F.col("yhat")).alias("score"))
    return metrics.mondrian_quantiles(scores, ["venue"], "regime", 0.9).withColumns({"q": F.round("q", 4), "q_all": F.round("q_all", 4)})


def online_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval_metrics(metrics.online_bands(lag_residuals(spark, sf_dir), ["venue"], 0.9), ["venue"])


QUERIES = {f.__name__: f for f in (l1_daily, l2_daily, l3_daily, l1_calendar, spike_days, ingest_manifest, active_spans, hierarchy_nodes, calendar_features, history_features, rolling_peak, term_changes, time_split, fold_edges, venue_pairs, naive_errors, conformal_quantiles, online_bands)}

RESIDUALS = f"{SERIES}, residuals AS (SELECT s.venue, s.date, s.value AS y, p.value AS yhat, abs(s.value - p.value) AS score FROM series s JOIN series p ON p.venue = s.venue AND p.date = s.date - 7)"
ORACLES = {
    "l1_daily": f"WITH {L1} SELECT * FROM l1",
    "l2_daily": f"WITH {LINE_ITEMS} SELECT venue, coalesce(category, 'Uncategorised') AS category, date, {_SUMS} FROM line_items WHERE NOT excluded GROUP BY venue, category, date",
    "l3_daily": f"WITH {LINE_ITEMS} SELECT venue, item, coalesce(category, 'Uncategorised') AS category, date, {_SUMS} FROM line_items WHERE NOT excluded AND item IS NOT NULL GROUP BY venue, item, category, date",
    "l1_calendar": f"WITH {SERIES} SELECT * FROM series",
    "spike_days": f"""WITH {LINE_ITEMS}, s AS (SELECT venue, date, round_even(abs(sum(disc_e4) / 100 / sum(gross_cents)), 4) AS share FROM line_items WHERE NOT excluded GROUP BY ALL)
      SELECT *, share >= 0.05 AS is_spike FROM s""",
    "ingest_manifest": f"""WITH {LINE_ITEMS} SELECT venue, count(*) AS n_rows, count(DISTINCT transaction_id) AS n_transactions, round(avg(CAST(category IS NULL AS INTEGER)), 6) AS null_category, round(avg(CAST(item IS NULL AS INTEGER)), 6) AS null_item,
      round(avg(CAST(ts IS NULL AS INTEGER)), 6) AS null_ts, min(date) AS first_date, max(date) AS last_date, CAST(sum(qty) AS BIGINT) AS qty, sum(net_e4) / 10000 AS net, sum(gross_cents) / 100 AS gross, sum(disc_e4) / 10000 AS discounts,
      abs(sum(gross_cents * 100 + disc_e4 - net_e4)) <= 0.01 * sum(net_e4) AS reconciles FROM line_items GROUP BY ROLLUP (venue)""",
    "active_spans": f"""WITH {SERIES}, s AS (SELECT venue, min(date) FILTER (WHERE value > 0) AS first_active, max(date) FILTER (WHERE value > 0) AS last_active, max(date) AS last_date FROM series GROUP BY venue)
      SELECT *, last_active < (SELECT max(last_date) FROM s) AS is_closed FROM s""",
    "hierarchy_nodes": f"""WITH {LINE_ITEMS}, i AS (SELECT venue, category, item, sum(net_e4) / 10000 AS total, row_number() OVER (PARTITION BY venue, category ORDER BY sum(net_e4) DESC, item) AS r FROM line_items WHERE NOT excluded GROUP BY venue, category, item)
      SELECT venue, category, 'ITEM::' || category || '::' || item AS node, round(total, 2) AS total FROM i WHERE r <= 3
      UNION ALL SELECT venue, category, 'ITEM::' || category || '::OTHER', round(greatest(sum(total) FILTER (WHERE r > 3), 0), 2) FROM i GROUP BY venue, category HAVING sum(total) FILTER (WHERE r > 3) > 1""",
    "calendar_features": f"""WITH {SERIES}, {EASTERS_SQL}, d AS (
        SELECT venue, date, value, CAST(isodow(date) - 1 AS INTEGER) AS dow_mon, date AS d, e FROM series JOIN easters ON y = year(date))
      SELECT venue, date, value, dow_mon, CAST(dow_mon >= 4 AS INTEGER) AS is_weekend, {", ".join(f"CAST(dow_mon = {i} AS INTEGER) AS dow_{i}" for i in range(7))},
        CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) % 12 // 3 AS INTEGER) AS season, CAST(weekofyear(date) AS INTEGER) AS iso_week,
        CAST(dow_mon IN (2, 4) AS INTEGER) AS is_happy_hour, CAST(dow_mon IN (0, 1) AS INTEGER) AS is_structural_zero,
        CAST({BANK_HOLIDAY_SQL} AS INTEGER) AS is_bank_holiday, CAST(date >= DATE '{PRICES_CHANGED}' AS INTEGER) AS price_regime,
        CAST({SCHOOL_TERM_SQL} AS INTEGER) AS is_school_term, {UNI_PHASE_SQL} AS uni_phase FROM d""",
    "history_features": f"""WITH {SERIES} SELECT venue, date, value, lag(value, 7) OVER w AS lag_7, lag(value, 14) OVER w AS lag_14, CASE WHEN count(*) OVER p >= 7 THEN round(avg(value) OVER p, 6) END AS roll_mean_28,
        CASE WHEN count(*) OVER p >= 7 THEN round(median(value) OVER p, 6) END AS roll_median_28 FROM series WINDOW w AS (PARTITION BY venue ORDER BY date), p AS (PARTITION BY venue ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""",
    "rolling_peak": f"WITH {SERIES}, m AS (SELECT venue, avg(value) OVER (PARTITION BY venue ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM series) SELECT venue, round(max(m), 6) AS peak_7 FROM m GROUP BY venue",
    "term_changes": f"""WITH {SERIES}, {EASTERS_SQL}, own AS (SELECT DISTINCT date FROM series),
      t AS (SELECT d, {SCHOOL_TERM_SQL} AS in_term FROM (SELECT date AS d FROM own UNION SELECT date + 1 FROM own) JOIN easters ON y = year(d))
      SELECT date, b.in_term AS into_term FROM own JOIN t a ON a.d = date JOIN t b ON b.d = date + 1 WHERE a.in_term <> b.in_term""",
    "time_split": f"""WITH {SERIES}, l AS (SELECT max(date) AS last FROM series), s AS (SELECT *, CASE WHEN date > last - 56 THEN 'test' WHEN date > last - 84 THEN 'val' ELSE 'train' END AS split FROM series, l)
      SELECT venue, split, min(date) AS first, max(date) AS last, count(*) AS n FROM s GROUP BY venue, split""",
    "fold_edges": f"WITH {FOLDS}, e AS (SELECT venue, fold, max(date) FILTER (WHERE role = 'train') AS train_end, min(date) FILTER (WHERE role = 'test') AS test_start FROM folds GROUP BY venue, fold) SELECT *, train_end >= test_start AS leaks FROM e",
    "venue_pairs": f"WITH {L1}, v AS (SELECT DISTINCT venue FROM l1) SELECT a.venue AS held_out, b.venue AS donor FROM v a JOIN v b ON a.venue <> b.venue",
    "naive_errors": f"""WITH {NAIVE}, d AS (SELECT venue, fold, abs(value - lag(value, 7) OVER (PARTITION BY venue, fold ORDER BY date)) AS d FROM folds WHERE role = 'train'), s AS (SELECT venue, fold, nullif(avg(d), 0) AS scale FROM d GROUP BY venue, fold)
      SELECT venue, fold, count(*) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(avg(CASE WHEN y <> 0 THEN 200 * abs(y - yhat) / (abs(y) + abs(yhat)) END), 6) AS smape, round(avg(abs(y - yhat)) / any_value(scale), 6) AS mase
      FROM naive JOIN s USING (venue, fold) GROUP BY venue, fold""",
    "conformal_quantiles": f"""WITH {RESIDUALS}, g AS (SELECT venue, CASE WHEN isodow(date) <= 2 THEN 'Mon-Tue' ELSE 'rest' END AS regime, score FROM residuals),
      a AS (SELECT venue, count(*) AS n, list(score ORDER BY score) AS s FROM g GROUP BY venue), b AS (SELECT venue, regime, count(*) AS n, list(score ORDER BY score) AS s FROM g GROUP BY venue, regime)
      SELECT b.venue, regime, b.n, round(b.s[CAST(least(ceil((b.n + 1) * 0.9::DOUBLE), b.n) AS BIGINT)], 4) AS q, round(a.s[CAST(least(ceil((a.n + 1) * 0.9::DOUBLE), a.n) AS BIGINT)], 4) AS q_all FROM a JOIN b ON a.venue = b.venue""",
    "online_bands": f"""WITH {RESIDUALS}, r AS (SELECT *, (date - min(date) OVER (PARTITION BY venue)) // 7 AS block FROM residuals), k AS (SELECT DISTINCT venue, block FROM r),
      past AS (SELECT k.venue, k.block, count(*) AS n, list(score ORDER BY score) AS s FROM k JOIN r ON r.venue = k.venue AND r.block < k.block GROUP BY ALL HAVING count(*) >= 70),
      b AS (SELECT r.venue, y, greatest(yhat - s[CAST(least(ceil((n + 1) * 0.9::DOUBLE), n) AS BIGINT)], 0) AS lo, yhat + s[CAST(least(ceil((n + 1) * 0.9::DOUBLE), n) AS BIGINT)] AS hi FROM r JOIN past ON past.venue = r.venue AND past.block = r.block)
      SELECT venue, count(*) AS n, round(avg(CAST(y BETWEEN lo AND hi AS INTEGER)), 6) AS coverage, round(avg(hi - lo), 6) AS width,
        round(avg(hi - lo + CASE WHEN y < lo THEN 2 / (1 - 0.9::DOUBLE) * (lo - y) WHEN y > hi THEN 2 / (1 - 0.9::DOUBLE) * (y - hi) ELSE 0 END), 6) AS winkler,
        round(avg((greatest((1 - 0.9::DOUBLE) / 2 * (y - lo), ((1 - 0.9::DOUBLE) / 2 - 1) * (y - lo)) + greatest((1 - (1 - 0.9::DOUBLE) / 2) * (y - hi), -((1 - 0.9::DOUBLE) / 2) * (y - hi))) / 2), 6) AS pinball FROM b GROUP BY venue""",
}
