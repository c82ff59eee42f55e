"""Queries of forecasts and signals."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.calendar import BANK_HOLIDAY_SQL, EASTERS_SQL, SCHOOL_TERM_SQL, UNI_PHASE_SQL, is_bank_holiday
from quillon.operators import briefing as brief
from quillon.operators import causes, features, forecast, layers, regression, signals
from quillon.plans.layers import FOLDS, NAIVE, RESIDUALS, SERIES, l3_daily, lag_residuals, series_of
from quillon.sources.store import Store, append_run, kept, shared_folder
from quillon.sources.views import LINE_ITEMS, STOCK, line_items, stock


#: Venues in the order of the numbers that stock lines have.
VENUES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _folds(s: SparkSession, p: str) -> DataFrame:
    return kept(features.rolling_origin(series_of(s, p)), "folds")


def _series(s: SparkSession, p: str) -> DataFrame:
    """The daily series, written once for all that reads it."""
    return kept(series_of(s, p), "series")


def _raw_stream(s: SparkSession, p: str) -> DataFrame:
    return signals.residual_stream(layers.trading_series(_series(s, p)))


def _stream(s: SparkSession, p: str) -> DataFrame:
    """The residual stream of all venues, written once; z to 6 places, so that thresholds fall alike in SQL."""
    return kept(_raw_stream(s, p).withColumn("z", F.round("z", 6)), "stream")


def residual_stream(s: SparkSession, p: str) -> DataFrame:
    return _raw_stream(s, p).select("venue", "date", "actual", F.round("expected", 4).alias("expected"), F.round("scale", 4).alias("scale"), F.round("z", 4).alias("z"))


def naive_forecast(s: SparkSession, p: str) -> DataFrame:
    return forecast.seasonal_naive(_folds(s, p))


def weekday_forecast(s: SparkSession, p: str) -> DataFrame:
    return forecast.robust_weekday(_folds(s, p), is_bank_holiday).withColumn("yhat", F.round("yhat", 4))


def ladder_scores(s: SparkSession, p: str) -> DataFrame:
    return forecast.evaluate(_folds(s, p), ["seasonal_naive", "robust_weekday", "holt_winters", "decomposed", "boosted_by_venue"], {"AMERICA": 1})


def ladder_best(s: SparkSession, p: str) -> DataFrame:
    return forecast.select_best(ladder_scores(s, p))


def boosted_scores(s: SparkSession, p: str) -> DataFrame:
    """One model for each venue and fold, and one for each fold over all venues."""
    return forecast.evaluate(_folds(s, p), ["boosted_by_venue", "boosted_trees"])


def _points(series: DataFrame, stream: DataFrame) -> DataFrame:
    return kept(signals.change_points(stream, layers.active_span(series), reset=False).drop("p_reset"), "points")


def change_points(s: SparkSession, p: str) -> DataFrame:
    return _points(_series(s, p), _stream(s, p))


def _weather(series: DataFrame) -> DataFrame:
    """The series with a temperature that stands in for the weather of its venue."""
    season = 10 + 8 * F.cos((F.dayofyear("date") - 200) * (2 * math.pi / 365)) + F.day("date") % 5 - 2
    return series.withColumn("temp", F.round(season, 6))


def weather_slopes(s: SparkSession, p: str) -> DataFrame:
    """What a degree is worth in every venue: slope, its p-value apart, share explained."""
    fits = regression.ols(_weather(_series(s, p)), ["venue"], "value", ["temp"]).where("term = 'temp'")
    return fits.select("venue", F.round("coef", 4).alias("slope"), F.round("r2", 9).alias("r2"), "n")


def weather_gain(s: SparkSession, p: str) -> DataFrame:
    """What the temperature adds to the weekday in every venue."""
    days = _weather(_series(s, p)).withColumns({f"d{i}": (F.weekday("date") == i).cast("double") for i in range(1, 7)})
    fits = regression.incremental(days, ["venue"], "value", [f"d{i}" for i in range(1, 7)], ["temp"])
    return fits.select("venue", "n", *(F.round(c, 8).alias(c) for c in ("r2_base", "r2", "gain")), F.round("f", 4).alias("f"))


def _facts(s: SparkSession, p: str, series: DataFrame) -> DataFrame:
    """What may coincide with a change: see operators.causes. Weather, events and stock snapshots stand in for tables that aren't there.

    The temperature follows the season, with a swing of two degrees within a week; events are each venue's best day of a
    year; stock lines are counted on days spread over six years, and ask for an order where fewer than three are left.
    """
    lines = line_items(s, p)
    weather = _weather(series).select("venue", "date", "temp")
    best = series.groupBy("venue", F.year("date").alias("y")).agg(F.max_by("date", F.struct("value", -F.unix_date("date"))).alias("date"))
    happenings = best.select("venue", "date", F.concat(F.lit("best day of "), F.col("y").cast("string")).alias("name"))
    counted = stock(s, p).select(
        F.element_at(F.array(*(F.lit(v) for v in VENUES)), (F.col("venue_id") + 1).cast("int")).alias("venue"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("stock_id") * 37 % 2400).cast("int")).alias("date"), (F.col("current") < 3).alias("reorder"),
    )
    return causes.gather(
        causes.closures(layers.active_span(series)), causes.price_breaks(lines), causes.term_edges(series), causes.holidays(series), causes.weather_spells(weather),
        causes.events(happenings), causes.promotions(layers.spike_days(lines, 0.09)), causes.empty_stock(counted),
    )


def attributed_points(s: SparkSession, p: str) -> DataFrame:
    """Change-points with all that coincides with them, the weightiest first."""
    series, stream = _series(s, p), _stream(s, p)
    found = causes.attribute(_points(series, stream), _facts(s, p, series))
    return found.select("venue", "onset", "direction", "severity", F.array_join("causes", "; ").alias("causes"))


def _signals(s: SparkSession, p: str, series: DataFrame, stream: DataFrame) -> DataFrame:
    """Deviations, change-points and stock lines that are nearly used up, counted on the last day of the data, as signals of a briefing."""
    days = signals.deviations(stream).where("status = 'deviation'")
    last = series.agg(F.max("date").alias("as_of"))
    venue = F.element_at(F.array(*(F.lit(v) for v in VENUES)), (F.col("venue_id") + 1).cast("int"))
    left = F.round(F.col("current") * 7 / F.col("weekly_use"), 6)
    low = stock(s, p).where("weekly_use > 0").select(venue.alias("venue"), F.col("stock_id").cast("string").alias("product"), left.alias("days"), F.col("weekly_use").alias("order_kegs")).where("days < 0.5")
    return kept(brief.collect(days, _points(series, stream), low.crossJoin(F.broadcast(last))), "signals")  # one row


def reconciled(s: SparkSession, p: str) -> DataFrame:
    """The hierarchy's weekday bases on the first week after the data, made coherent."""
    days = layers.layer(line_items(s, p), "L2").select("venue", "category", "date", F.col("revenue").alias("value"))
    leaf = layers.dense_calendar(days, ["venue", "category"], ["value"]).select("venue", F.concat(F.lit("CAT::"), "category").alias("node"), F.lit("VENUE").alias("parent"), "date", "value")
    root = _series(s, p).select("venue", F.lit("VENUE").alias("node"), F.lit(None).cast("string").alias("parent"), "date", "value")
    series = leaf.unionByName(root)
    names = series.select("venue", "node", "parent").distinct()  # the root's parent is null, so it is no key to join on
    base = forecast.weekday_base(series, ["venue", "node"]).join(names, ["venue", "node"])
    last = series.agg(F.max("date")).first()[0]
    monday = F.next_day(F.lit(str(last)).cast("date"), "Mon")
    week = s.range(7).select(F.date_add(monday, F.col("id").cast("int")).alias("date"))
    nodes = base.join(week.withColumn("dow", F.weekday("date")), "dow")
    return forecast.reconcile(nodes).select("venue", "date", "node", F.round("coherent", 2).alias("coherent"))


def node_series(s: SparkSession, p: str) -> DataFrame:
    return layers.node_series(kept(l3_daily(s, p).select("venue", "category", "item", "date", "revenue"), "days"))


def _nodes(s: SparkSession, p: str) -> DataFrame:
    """The nodes' series, and the days it is made of, written once: the lines are joined once, not for each of their many uses."""
    days = kept(l3_daily(s, p).select("venue", "category", "item", "date", "revenue"), "days")
    return kept(layers.node_series(days), "nodes")


def node_quantiles(s: SparkSession, p: str) -> DataFrame:
    return forecast.node_bands(_nodes(s, p))[0].withColumn("q", F.round("q", 4))


def node_coverage(s: SparkSession, p: str) -> DataFrame:
    return forecast.node_coverage(*forecast.node_bands(_nodes(s, p)))


def standby_band(s: SparkSession, p: str) -> DataFrame:
    """A band for the 28 days after the last of every venue that closed before the last day of all, from the weekly differences."""
    closed = layers.active_span(series_of(s, p)).where("is_closed").select("venue", "last_active")
    inside = lambda df: df.join(closed, "venue").where("date <= last_active").drop("last_active")
    band = forecast.standby_band(inside(series_of(s, p)), inside(lag_residuals(s, p).withColumn("score", F.abs(F.col("y") - F.col("yhat")))), closed)
    return band.select("venue", "date", "level", *(F.round(c, 4).alias(c) for c in ("yhat", "lo", "hi")))


def stock_cover(s: SparkSession, p: str) -> DataFrame:
    demand = l3_daily(s, p).groupBy(F.col("item").alias("product")).agg((F.sum("units") / F.datediff(F.max("date"), F.min("date"))).alias("daily_pints"))
    kegs = stock(s, p).groupBy(F.col("name").alias("product")).agg(F.sum("current").alias("kegs")).withColumn("pints_per_keg", F.lit(88.0))
    return signals.days_of_cover(kegs, demand).withColumn("daily_pints", F.round("daily_pints", 6))


def detector_study(s: SparkSession, p: str) -> DataFrame:
    """Shifts put into the second half of every venue's stream, and when CUSUM sees them first: (shift, venues, detected, mean_delay)."""
    venue = Window.partitionBy("venue").orderBy("date")
    halves = _stream(s, p).withColumns({"_k": F.row_number().over(venue), "_n": F.count("*").over(Window.partitionBy("venue"))})
    each = halves.withColumn("shift", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)))))
    shifted = each.select(
        F.concat_ws("|", "venue", F.col("shift").cast("string")).alias("venue"), "date", (F.col("z") + F.when(F.col("_k") > F.col("_n") / 2, F.col("shift")).otherwise(0.0)).alias("z"),
        "shift", (F.col("_k") > F.col("_n") / 2).alias("_in"),
    )
    shifted = kept(shifted, "shifted")
    begun = shifted.groupBy("venue", "shift").agg(F.min(F.when(F.col("_in"), F.col("date"))).alias("change"))
    alarms = signals.cusum(shifted.select("venue", "date", "z")).where("direction = 'up'")
    first = begun.join(alarms, "venue", "left").groupBy("venue", "shift", "change").agg(F.min(F.when(F.col("alarm") >= F.col("change"), F.col("alarm"))).alias("seen"))
    return first.groupBy("shift").agg(F.count("*").alias("venues"), F.count("seen").alias("detected"), F.round(F.avg(F.datediff("seen", "change")), 4).alias("mean_delay"))


#: Days between the two runs of the briefing query.
RUNS_APART = 28


def _run(signals_: DataFrame, stream: DataFrame, as_of: str, prior: DataFrame | None) -> DataFrame:
    """The items of a run on the day after as_of: what was known then, of deviations those among the last rows of a venue's stream."""
    near = signals.scan(stream.where(F.col("date") <= F.lit(as_of).cast("date")), brief.SCAN_ROWS).groupBy("venue").agg(F.min("date").alias("_from"))
    known = signals_.where(F.col("known") <= F.lit(as_of).cast("date")).join(F.broadcast(near), "venue", "left")
    known = known.where("source <> 'deviation' or onset >= _from").drop("_from")
    return signals.briefing_items(signals.clusters(known), str(datetime.date.fromisoformat(as_of) + datetime.timedelta(1)), prior)


def _briefing(s: SparkSession, p: str) -> tuple[DataFrame, str]:
    """Two runs, four weeks apart, the first of which is kept and read back by the second."""
    series, stream = _series(s, p), _stream(s, p)
    found = _signals(s, p, series, stream)
    last = series.agg(F.max("date")).first()[0]
    store = Store(s, shared_folder(s, "store"))
    append_run(store, _run(found, stream, str(last - datetime.timedelta(RUNS_APART)), brief.latest_run(store)).drop("caveats"), "first")
    items = kept(_run(found, stream, str(last), brief.latest_run(store)), "items")
    return brief.headlines(items, found, kept(_facts(s, p, series), "facts")), str(last)


def briefing(s: SparkSession, p: str) -> DataFrame:
    """The items of the second run, as seen on the day after the data: new, continuing and resolved ones, with reason and headline."""
    return _briefing(s, p)[0].withColumn("caveats", F.array_join("caveats", "; "))


def briefing_envelope(s: SparkSession, p: str) -> DataFrame:
    items, last = _briefing(s, p)
    return brief.envelope(items, F.lit(last).cast("date"))


QUERIES = {f.__name__: f for f in (residual_stream, naive_forecast, weekday_forecast, ladder_scores, ladder_best, boosted_scores, change_points, attributed_points, reconciled, node_series, node_quantiles, node_coverage, standby_band, stock_cover, briefing, briefing_envelope, weather_slopes, weather_gain)} | {
    "deviations": lambda s, p: signals.deviations(_stream(s, p)).select("venue", "date", "z", "status", "direction", "severity"),
    "cusum_alarms": lambda s, p: signals.cusum(_stream(s, p), h=2.0).withColumn("stat", F.round("stat", 4)),
    "persistence_alarms": lambda s, p: signals.persistence(_stream(s, p)),
    "run_lengths": lambda s, p: signals.run_lengths(_stream(s, p)),
    "detector_study": detector_study,
    "venue_transfer": lambda s, p: forecast.leave_one_out_transfer(series_of(s, p)),
    "signal_clusters": lambda s, p: signals.clusters(_signals(s, p, _series(s, p), _stream(s, p)).where("source <> 'stock'")).select("venue", "onset", "source", "direction", "cluster"),
}

#: The hierarchy's daily series.
_NODES = f"""{LINE_ITEMS}, i AS (SELECT venue, coalesce(category, 'Uncategorised') AS category, item, date, sum(net_e4) AS v FROM line_items WHERE NOT excluded AND item IS NOT NULL GROUP BY ALL),
  k AS (SELECT venue, category, item, row_number() OVER (PARTITION BY venue, category ORDER BY sum(v) DESC, item) <= 3 AS top FROM i GROUP BY venue, category, item),
  x AS (SELECT * FROM i JOIN k USING (venue, category, item)),
  rest AS (SELECT venue, category, date, greatest(coalesce(sum(v) FILTER (WHERE NOT top), 0), 0) AS v FROM x GROUP BY venue, category, date),
  sold AS (SELECT venue, 'ITEM::' || category || '::' || item AS node, 'CAT::' || category AS parent, date, v FROM x WHERE top
    UNION ALL SELECT venue, 'ITEM::' || category || '::OTHER', 'CAT::' || category, date, v FROM rest WHERE (venue, category) IN (SELECT (venue, category) FROM rest GROUP BY venue, category HAVING sum(v) > 10000)
    UNION ALL SELECT venue, 'CAT::' || category, 'VENUE', date, sum(v) FROM x GROUP BY venue, category, date
    UNION ALL SELECT venue, 'VENUE', NULL, date, sum(v) FROM x GROUP BY venue, date),
  days AS (SELECT venue, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM i GROUP BY venue),
  names AS (SELECT DISTINCT venue, node, parent FROM sold),
  nodes AS (SELECT n.venue, n.node, n.parent, d.date, coalesce(s.v, 0) / 10000 AS value FROM names n JOIN days d ON d.venue = n.venue LEFT JOIN sold s ON s.venue = n.venue AND s.node = n.node AND s.date = d.date)"""
#: The residual stream, written from the rule: weekday medians of all earlier days, and the conformal quantile of their distances.
_STREAM = f"""{SERIES}, latest AS (SELECT max(date) AS m FROM series),
  active AS (SELECT venue, min(date) AS a FROM series WHERE value > 0 GROUP BY venue),
  trading AS (SELECT venue, CAST(unnest(generate_series(a, m, INTERVAL 1 DAY)) AS DATE) AS date FROM active, latest),
  d AS (SELECT t.venue, t.date, coalesce(s.value, 0) AS value, isodow(t.date) AS dow, row_number() OVER (PARTITION BY t.venue ORDER BY t.date) - 1 AS i
        FROM trading t LEFT JOIN series s USING (venue, date)),
  now AS (SELECT * FROM d WHERE i >= 56),
  m AS (SELECT n.venue, n.i, p.dow, median(p.value) AS med FROM now n JOIN d p ON p.venue = n.venue AND p.i < n.i GROUP BY n.venue, n.i, p.dow),
  e AS (SELECT n.venue, n.i, n.date, n.value, m.med AS expected FROM now n JOIN m ON m.venue = n.venue AND m.i = n.i AND m.dow = n.dow WHERE m.med > 1e-6),
  s AS (SELECT e.venue, e.i, list(abs(p.value - m.med) ORDER BY abs(p.value - m.med)) AS l
        FROM e JOIN d p ON p.venue = e.venue AND p.i < e.i JOIN m ON m.venue = e.venue AND m.i = e.i AND m.dow = p.dow GROUP BY e.venue, e.i),
  q AS (SELECT venue, i, greatest(l[CAST(least(ceil((i + 1) * 0.9::DOUBLE), i) AS BIGINT)], 1e-6) AS scale FROM s),
  stream AS (SELECT venue, date, value AS actual, expected, scale, (value - expected) / scale AS raw, round((value - expected) / scale, 6) AS z,
        row_number() OVER (PARTITION BY venue ORDER BY date) AS k FROM e JOIN q USING (venue, i))"""
_DEVIATIONS = """deviations AS (SELECT venue, date, z, CASE WHEN abs(z) <= 1 THEN 'normal' ELSE 'deviation' END AS status, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction,
        CASE WHEN abs(z) > 2 THEN 'high' WHEN abs(z) > 1 THEN 'medium' END AS severity FROM stream)"""
_CUSUM = """walk AS (
    SELECT venue, k, date, CAST(greatest(0, z - 0.5) AS DOUBLE) AS u, CAST(greatest(0, -z - 0.5) AS DOUBLE) AS d, date AS fu, date AS fd FROM stream WHERE k = 1
    UNION ALL
    SELECT n.venue, n.k, n.date, greatest(0, CASE WHEN c.u > 5 OR c.d > 5 THEN 0 ELSE c.u END + n.z - 0.5), greatest(0, CASE WHEN c.u > 5 OR c.d > 5 THEN 0 ELSE c.d END - n.z - 0.5),
      CASE WHEN c.u = 0 OR c.u > 5 OR c.d > 5 THEN n.date ELSE c.fu END, CASE WHEN c.d = 0 OR c.u > 5 OR c.d > 5 THEN n.date ELSE c.fd END
    FROM walk c JOIN stream n ON n.venue = c.venue AND n.k = c.k + 1),
  cusum AS (SELECT venue, date AS alarm, CASE WHEN u > 5 THEN fu ELSE fd END AS onset, CASE WHEN u > 5 THEN 'up' ELSE 'down' END AS direction, CASE WHEN u > 5 THEN u ELSE d END AS stat
        FROM walk WHERE u > 5 OR d > 5)"""
#: Every day whose last seven (all of them there) hold four breaches of one side.
_PERSISTENCE = """windows AS (SELECT venue, date, k, count(*) FILTER (WHERE z > 1) OVER w AS nu, min(date) FILTER (WHERE z > 1) OVER w AS fu, count(*) FILTER (WHERE z < -1) OVER w AS nd,
        min(date) FILTER (WHERE z < -1) OVER w AS fd FROM stream WINDOW w AS (PARTITION BY venue ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  persistent AS (SELECT venue, date AS alarm, fu AS onset, 'up' AS direction, nu AS count FROM windows WHERE k >= 7 AND nu >= 4
        UNION ALL SELECT venue, date, fd, 'down', nd FROM windows WHERE k >= 7 AND nd >= 4)"""
#: Alarms merged by onset; severity by mean z or the number of breaches; falls after a closure dropped.
_POINTS = f"""{_CUSUM}, {_PERSISTENCE},
  seen AS (SELECT venue, onset, alarm, direction, stat, CAST(NULL AS BIGINT) AS count, 0 AS src FROM cusum UNION ALL SELECT venue, onset, alarm, direction, CAST(NULL AS DOUBLE), count, 1 FROM persistent),
  merged AS (SELECT venue, onset, arg_min(direction, {{'b': src, 'a': alarm}}) AS direction, min(alarm) AS alarm,
        CASE WHEN count(DISTINCT src) > 1 THEN 'both' WHEN min(src) = 0 THEN 'cusum' ELSE 'persistence' END AS detector,
        arg_min(count, alarm) FILTER (WHERE src = 1) AS count, arg_min(stat, alarm) FILTER (WHERE src = 0) AS stat FROM seen GROUP BY venue, onset),
  sized AS (SELECT p.*, (SELECT avg(z) FROM stream x WHERE x.venue = p.venue AND x.date BETWEEN p.onset AND p.alarm) AS mag, o.expected, o.scale
        FROM merged p JOIN stream o ON o.venue = p.venue AND o.date = p.onset WHERE (SELECT count(*) FROM stream x WHERE x.venue = p.venue) >= 34),
  closed AS (SELECT venue, max(date) AS z FROM series, latest WHERE value > 0 GROUP BY venue, m HAVING max(date) < m),
  closing AS (SELECT venue, min(onset) AS c FROM sized JOIN closed USING (venue) WHERE direction = 'down' AND onset >= z - 7 GROUP BY venue),
  points AS (SELECT venue, onset, alarm, CAST(alarm - onset AS INTEGER) AS delay, detector, direction, round(mag, 3) AS magnitude,
        CASE WHEN expected > 1e-6 THEN round(mag * scale / expected * 100, 1) END AS percent, count, round(stat, 2) AS stat,
        CASE WHEN abs(mag) > 1.5 OR coalesce(count, 0) >= 6 THEN 'high' WHEN abs(mag) > 0.8 OR coalesce(count, 0) >= 4 THEN 'medium' ELSE 'low' END AS severity, coalesce(onset = c, false) AS is_closure
        FROM sized LEFT JOIN closing USING (venue) WHERE c IS NULL OR direction <> 'down' OR onset <= c)"""
_CLUSTERS = f"""{_DEVIATIONS}, {_POINTS},
  signals AS (SELECT venue, 'deviation' AS source, date AS onset, direction, severity FROM deviations WHERE status = 'deviation' UNION ALL SELECT venue, 'change_point', onset, direction, severity FROM points),
  opened AS (SELECT *, CASE WHEN onset - lag(onset) OVER w <= 7 THEN 0 ELSE 1 END AS o FROM signals WINDOW w AS (PARTITION BY venue, direction ORDER BY onset, source)),
  clusters AS (SELECT *, CAST(sum(o) OVER (PARTITION BY venue, direction ORDER BY onset, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM opened)"""
_VENUE_OF = f"[{', '.join(repr(v) for v in VENUES)}][venue_id + 1]"
_WEATHER = "weather AS (SELECT venue, date, round(10 + 8 * cos((dayofyear(date) - 200) * (2 * pi() / 365)) + day(date) % 5 - 2, 6) AS temp FROM series)"
#: All facts, written from the rules.
_FACTS = f"""{STOCK}, {EASTERS_SQL},
  dates AS (SELECT DISTINCT date AS d FROM series),
  calendar_days AS (SELECT d, {SCHOOL_TERM_SQL} AS school, {UNI_PHASE_SQL} <> 'vacation' AS uni, {BANK_HOLIDAY_SQL} AS bank FROM (SELECT d FROM dates UNION SELECT d + 1 FROM dates) JOIN easters ON y = year(d)),
  edges AS (SELECT a.d, a.school <> b.school AS school, a.uni <> b.uni AS uni FROM calendar_days a JOIN dates USING (d) JOIN calendar_days b ON b.d = a.d + 1),
  months AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, sum(gross_cents) / sum(qty) AS price FROM line_items WHERE NOT excluded AND qty > 0 GROUP BY 1),
  steps AS (SELECT date, round(abs(ln(price / lag(price) OVER (ORDER BY date))), 12) AS step FROM months),
  {_WEATHER},
  spells AS (SELECT venue, date, round(avg(temp) OVER w - avg(temp) OVER v, 9) AS gap, stddev(temp) OVER v AS sd, count(*) OVER v AS n FROM weather
    WINDOW v AS (PARTITION BY venue), w AS (PARTITION BY venue ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING)),
  spikes AS (SELECT venue, date FROM line_items WHERE NOT excluded GROUP BY venue, date HAVING round_even(abs(sum(disc_e4) / 100 / sum(gross_cents)), 4) >= 0.09),
  facts AS (
    SELECT venue, z AS date, 7 AS reach, 'closure of ' || venue AS label, 100 AS w, NULL AS side FROM closed
    UNION ALL SELECT NULL, date, 7, 'price-regime change', 90, NULL FROM (SELECT date FROM steps WHERE step IS NOT NULL ORDER BY step DESC, date LIMIT 1)
    UNION ALL SELECT NULL, d, 7, 'school term/holiday', 60, NULL FROM edges WHERE school
    UNION ALL SELECT NULL, d, 7, 'university term/vacation', 65, NULL FROM edges WHERE uni
    UNION ALL SELECT NULL, d, 7, 'bank holiday', 55, NULL FROM calendar_days JOIN dates USING (d) WHERE bank
    UNION ALL SELECT venue, date, 0, CASE WHEN gap > 0 THEN 'warm spell' ELSE 'cold snap' END, 40 + CASE WHEN gap > 0 AND side = 'up' THEN 5 ELSE 0 END, side
      FROM spells, (VALUES ('up'), ('down')) AS x(side) WHERE abs(gap) > sd AND n > 30
    UNION ALL SELECT venue, date, 7, 'best day of ' || year(date), 55, NULL FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY venue, year(date) ORDER BY value DESC, date) = 1)
    UNION ALL SELECT venue, date, 7, 'discount day', 50, NULL FROM spikes
    UNION ALL SELECT DISTINCT {_VENUE_OF}, DATE '1995-01-01' + CAST(stock_id * 37 % 2400 AS INTEGER), 7, 'reorder flag', 45, 'down' FROM stock WHERE current < 3)"""


def _causes_sql(of: str) -> str:
    """causes (venue, onset, direction, all, first) of the rows of a relation."""
    return f"""hits AS (SELECT p.venue, onset, direction, label, max(w) AS w FROM (SELECT DISTINCT venue, onset, direction FROM {of}) p JOIN facts f
      ON onset BETWEEN f.date - reach AND f.date + reach AND (f.venue IS NULL OR f.venue = p.venue) AND (side IS NULL OR side = direction) GROUP BY ALL),
    reasons AS (SELECT venue, onset, direction, string_agg(label, '; ' ORDER BY w DESC, label) AS causes, first(label ORDER BY w DESC, label) AS why FROM hits GROUP BY ALL)"""


def _items_sql(name: str, days: int, prior: str | None) -> str:
    """Items of the run whose last day lies `days` before the data's last one."""
    day = f"((SELECT m FROM latest) - {days})"
    new, again = signals.NOVELTY["new"], signals.NOVELTY["continuing"]
    novelty = str(new) if prior is None else f"CASE WHEN was IS NULL THEN {new} ELSE {again} END"
    items = f"""{name}_near AS (SELECT venue, min(date) AS since FROM (SELECT * FROM stream WHERE date <= {day} QUALIFY row_number() OVER (PARTITION BY venue ORDER BY date DESC) <= {brief.SCAN_ROWS}) GROUP BY venue),
    {name}_known AS (SELECT s.* FROM told s LEFT JOIN {name}_near USING (venue) WHERE known <= {day} AND (source <> 'deviation' OR onset >= since)),
    {name}_opened AS (SELECT *, CASE WHEN onset - lag(onset) OVER w <= 7 THEN 0 ELSE 1 END AS o FROM {name}_known WINDOW w AS (PARTITION BY venue, direction ORDER BY onset, source)),
    {name}_clusters AS (SELECT *, sum(o) OVER (PARTITION BY venue, direction ORDER BY onset, source ROWS UNBOUNDED PRECEDING) AS cluster FROM {name}_opened),
    {name}_heads AS (SELECT venue, direction, count(*) - 1 AS n_evidence, count(*) FILTER (source = 'stock') AS n_stock,
      arg_max({{'s': source, 'v': severity, 'o': onset}}, (CASE source WHEN 'change_point' THEN 3 WHEN 'deviation' THEN 2 ELSE 1 END, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, onset)) AS h
      FROM {name}_clusters GROUP BY venue, direction, cluster),
    {name}_keyed AS (SELECT *, venue || ':' || direction || ':' || CAST(h.o AS VARCHAR) || ':' || h.s AS item_key FROM {name}_heads),
    {name}_met AS (SELECT k.*, {'NULL' if prior is None else 'p.score'} AS was FROM {name}_keyed k {'' if prior is None else f'LEFT JOIN {prior} p USING (item_key)'}),
    {name} AS (SELECT item_key, venue, direction, h.s AS source, h.v AS severity, h.o AS onset, n_evidence, 1.0::DOUBLE AS trust, CASE WHEN n_stock > 0 AND h.s <> 'stock' THEN 'action: reorder' ELSE '' END AS caveats,
      CASE WHEN was IS NULL THEN 'new' ELSE 'continuing' END AS status,
      round(CASE h.s WHEN 'change_point' THEN 1.0 WHEN 'deviation' THEN 0.6 ELSE {signals.SOURCE_WEIGHT["stock"]} END::DOUBLE * CASE h.v WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.0 ELSE 0.6 END::DOUBLE
        * CASE WHEN {day} + 1 <= h.o THEN 1 ELSE greatest(0.5::DOUBLE, 1 - 0.5::DOUBLE * ({day} + 1 - h.o) / 14) END * ({novelty})::DOUBLE * CASE direction WHEN 'down' THEN 1.1 ELSE 1 END::DOUBLE, 6) AS score FROM {name}_met)"""
    return items


_BRIEFING = f"""{_STREAM}, {_CLUSTERS}, {_FACTS},
  low AS (SELECT {_VENUE_OF} AS venue, CAST(stock_id AS VARCHAR) AS product, round(current * 7 / weekly_use, 6) AS days, weekly_use AS kegs FROM stock WHERE weekly_use > 0),
  told AS (
    SELECT venue, 'deviation' AS source, date AS onset, date AS known, direction, severity,
      CAST(CAST(round(actual) AS BIGINT) AS VARCHAR) || CASE direction WHEN 'up' THEN ' above' ELSE ' below' END || ' band on ' || CAST(date AS VARCHAR) AS what
    FROM deviations JOIN (SELECT venue, date, actual FROM stream) USING (venue, date) WHERE status = 'deviation'
    UNION ALL SELECT venue, 'change_point', onset, alarm, direction, severity, 'sustained shift since ' || CAST(onset AS VARCHAR) || ' (' ||
      CASE WHEN percent IS NULL THEN CASE direction WHEN 'up' THEN 'a sustained uplift' ELSE 'a sustained downturn' END
        ELSE CAST(CAST(round(abs(percent)) AS BIGINT) AS VARCHAR) || CASE direction WHEN 'up' THEN '% above normal' ELSE '% below normal' END END || ')' FROM points
    UNION ALL SELECT venue, 'stock', m, m, 'down', CASE WHEN days <= 0 THEN 'high' ELSE 'medium' END, product || ' low: ' || format('{{:.1f}}', days) || ' days'' cover, order ' || CAST(kegs AS VARCHAR)
      FROM low, latest WHERE days < 0.5),
  {_items_sql("prior", RUNS_APART, None)}, {_items_sql("items", 0, "prior")}, {_causes_sql("items")},
  said AS (SELECT venue, direction, source, onset, min(what) AS what FROM told GROUP BY ALL),
  briefing AS (
    SELECT i.*, coalesce(why, '{causes.NOTHING}') AS reason, venue || ': ' || what || CASE source WHEN 'stock' THEN '' ELSE '; ' || coalesce(why, '{causes.NOTHING}') END AS headline
    FROM items i JOIN said USING (venue, direction, source, onset) LEFT JOIN reasons USING (venue, onset, direction)
    UNION ALL SELECT item_key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'resolved', round(score * {signals.NOVELTY["resolved"]}, 6), 'cleared', 'cleared: ' || item_key FROM prior WHERE item_key NOT IN (SELECT item_key FROM items))"""
ORACLES = {
    "naive_forecast": f"WITH {NAIVE} SELECT * FROM naive",
    "weekday_forecast": f"""WITH {FOLDS}, {EASTERS_SQL},
      f AS (SELECT * EXCLUDE (y, e, d), isodow(date) AS dow, month(date) AS m, {BANK_HOLIDAY_SQL} AS h FROM (SELECT *, date AS d FROM folds) JOIN easters ON y = year(date)), t AS (SELECT * FROM f WHERE role = 'train'),
      a AS (SELECT venue, fold, median(value) AS overall FROM t GROUP BY venue, fold), d AS (SELECT venue, fold, dow, median(value) AS v FROM t GROUP BY venue, fold, dow), k AS (SELECT venue, fold, m, median(value) AS v FROM t GROUP BY venue, fold, m),
      x AS (SELECT t.venue, t.fold, median(t.value / d.v) AS x FROM t JOIN d USING (venue, fold, dow) WHERE h AND d.v > 0 GROUP BY t.venue, t.fold HAVING count(*) >= 3)
      SELECT f.venue, f.fold, f.date, f.value AS y, round(coalesce(d.v, overall) * coalesce(least(greatest(k.v / greatest(overall, 1e-9), 0.5), 2.0), 1) * CASE WHEN h THEN coalesce(x, 1) ELSE 1 END, 4) AS yhat
      FROM f JOIN a USING (venue, fold) LEFT JOIN d USING (venue, fold, dow) LEFT JOIN k USING (venue, fold, m) LEFT JOIN x USING (venue, fold) WHERE role = 'test'""",
    "stock_cover": f"""WITH {SERIES}, {STOCK}, w AS (SELECT item AS product, sum(qty) / (max(date) - min(date)) AS daily_pints FROM line_items WHERE NOT excluded AND item IS NOT NULL GROUP BY item),
      k AS (SELECT name AS product, CAST(sum(current) AS BIGINT) AS kegs, 88.0::DOUBLE AS pints_per_keg FROM stock GROUP BY name), j AS (SELECT product, kegs, pints_per_keg, daily_pints, kegs * pints_per_keg AS on_hand FROM k LEFT JOIN w USING (product))
      SELECT product, kegs, pints_per_keg, round(daily_pints, 6) AS daily_pints, on_hand, round(on_hand / nullif(daily_pints, 0), 6) AS days, on_hand / nullif(daily_pints, 0) < 5 AS reorder, CASE WHEN daily_pints > 0 THEN CAST(greatest(0, ceil((daily_pints * 12 - on_hand) / pints_per_keg)) AS BIGINT) END AS order_kegs FROM j""",
    "venue_transfer": f"""WITH {SERIES}, d AS (SELECT *, isodow(date) AS dow FROM series), s AS (SELECT venue, dow, avg(value) AS m FROM d GROUP BY venue, dow),
      u AS (SELECT venue, dow, m / avg(m) OVER (PARTITION BY venue) AS s FROM s),
      o AS (SELECT v.venue, dow, avg(s) AS s FROM (SELECT DISTINCT venue FROM d) v JOIN u ON u.venue <> v.venue GROUP BY v.venue, dow),
      shape AS (SELECT venue, dow, s / avg(s) OVER (PARTITION BY venue) AS shape FROM o),
      a AS (SELECT venue, min(date) AS a, max(date) AS b FROM d WHERE value > 0 GROUP BY venue),
      g AS (SELECT venue, date, value, dow, date - a AS t, history FROM d JOIN a USING (venue), (VALUES (14), (21), (28), (42), (56)) AS h(history) WHERE date BETWEEN a AND b),
      l AS (SELECT venue, history, avg(value) AS level FROM g WHERE t < history GROUP BY venue, history),
      e AS (SELECT x.venue, x.history, avg(abs(x.value - y.value)) AS scale FROM g x JOIN g y ON y.venue = x.venue AND y.history = x.history AND y.t = x.t - 7 WHERE x.t < x.history GROUP BY x.venue, x.history),
      n AS (SELECT venue, history, dow, value AS naive FROM g WHERE t < history AND t >= history - 7),
      r AS (SELECT venue, history, count(*) AS n, round(any_value(level), 1) AS anchor, round(avg(abs(value - level * shape)) / any_value(scale), 6) AS mase_transfer, round(avg(abs(value - naive)) / any_value(scale), 6) AS mase_naive
            FROM g JOIN l USING (venue, history) JOIN e USING (venue, history) JOIN shape USING (venue, dow) JOIN n USING (venue, history, dow) WHERE t >= history GROUP BY venue, history)
      SELECT *, mase_transfer < mase_naive AS wins FROM r""",
    "node_series": f"WITH {_NODES} SELECT * FROM nodes",
    "node_quantiles": f"""WITH {_NODES}, v AS (SELECT venue, node, date, value, isodow(date) AS dow, max(date) OVER (PARTITION BY venue) - 56 AS edge FROM nodes),
      t AS (SELECT * FROM v WHERE date < edge AND node <> 'VENUE'), m AS (SELECT venue, node, dow, median(value) AS yhat FROM t GROUP BY venue, node, dow),
      s AS (SELECT venue, node, list(abs(value - yhat) ORDER BY abs(value - yhat)) AS l FROM t JOIN m USING (venue, node, dow) GROUP BY venue, node)
      SELECT venue, node, level, len(l) AS n, round(l[CAST(least(ceil((len(l) + 1) * level), len(l)) AS INTEGER)], 4) AS q FROM s, (VALUES (0.8::DOUBLE), (0.9::DOUBLE)) AS h(level)""",
    "standby_band": f"""WITH {RESIDUALS}, a AS (SELECT venue, max(date) FILTER (WHERE value > 0) AS b, max(date) AS z FROM series GROUP BY venue), c AS (SELECT venue, b FROM a WHERE b < (SELECT max(z) FROM a)),
      y AS (SELECT venue, isodow(date) AS dow, greatest(median(value), 0) AS yhat FROM series JOIN c USING (venue) WHERE date <= b GROUP BY venue, isodow(date)),
      s AS (SELECT venue, isodow(date) <= 2 AS early, list(score ORDER BY score) AS l FROM residuals JOIN c USING (venue) WHERE date <= b GROUP BY venue, isodow(date) <= 2),
      q AS (SELECT venue, early, l[CAST(least(ceil((len(l) + 1) * 0.9::DOUBLE), len(l)) AS INTEGER)] AS q FROM s),
      f AS (SELECT venue, CAST(b + CAST(k + 1 AS INTEGER) AS DATE) AS date FROM c, range(28) AS r(k))
      SELECT f.venue, date, 0.9::DOUBLE AS level, round(yhat, 4) AS yhat, round(greatest(yhat - q, 0), 4) AS lo, round(yhat + q, 4) AS hi
      FROM f JOIN y ON y.venue = f.venue AND y.dow = isodow(date) JOIN q ON q.venue = f.venue AND q.early = (isodow(date) <= 2)""",
    "residual_stream": f"WITH {_STREAM} SELECT venue, date, actual, round(expected, 4) AS expected, round(scale, 4) AS scale, round(raw, 4) AS z FROM stream",
    "deviations": f"WITH {_STREAM}, {_DEVIATIONS} SELECT * FROM deviations",
    "cusum_alarms": f"WITH RECURSIVE {_STREAM}, {_CUSUM.replace('> 5', '> 2')} SELECT venue, alarm, onset, direction, round(stat, 4) AS stat FROM cusum",
    "weather_slopes": f"""WITH {SERIES}, {_WEATHER} SELECT venue, round(regr_slope(value, temp), 4) AS slope, round(regr_r2(value, temp), 9) AS r2, count(*) AS n
      FROM series JOIN weather USING (venue, date) GROUP BY venue""",
    "weather_gain": f"""WITH {SERIES}, {_WEATHER},
      c AS (SELECT venue, value - avg(value) OVER v AS y, value - avg(value) OVER w AS yw, temp - avg(temp) OVER w AS tw FROM series JOIN weather USING (venue, date)
        WINDOW v AS (PARTITION BY venue), w AS (PARTITION BY venue, isodow(date))),
      q AS (SELECT venue, count(*) AS n, sum(y * y) AS total, sum(yw * yw) AS base, sum(yw * yw) - sum(yw * tw) ^ 2 / sum(tw * tw) AS whole FROM c GROUP BY venue)
      SELECT venue, n, round(1 - base / total, 8) AS r2_base, round(1 - whole / total, 8) AS r2, round((base - whole) / total, 8) AS gain, round((base - whole) / (whole / (n - 8)), 4) AS f FROM q""",
    "detector_study": f"""WITH RECURSIVE {_STREAM.replace("stream AS (", "own AS (")},
      halves AS (SELECT venue, date, z, k, count(*) OVER (PARTITION BY venue) AS n FROM own),
      stream AS (SELECT venue || '|' || CAST(shift AS VARCHAR) AS venue, shift, date, k, k > n / 2 AS inside, z + CASE WHEN k > n / 2 THEN shift ELSE 0 END AS z
        FROM halves, (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0)) AS v(shift)), {_CUSUM},
      begun AS (SELECT venue, shift, min(date) FILTER (inside) AS change FROM stream GROUP BY venue, shift),
      seen AS (SELECT b.venue, shift, change, min(alarm) AS seen FROM begun b LEFT JOIN cusum c ON c.venue = b.venue AND direction = 'up' AND alarm >= change GROUP BY ALL)
      SELECT shift, count(*) AS venues, count(seen) AS detected, round(avg(seen - change), 4) AS mean_delay FROM seen GROUP BY shift""",
    "reconciled": f"""WITH {SERIES},
      sold AS (SELECT venue, 'CAT::' || coalesce(category, 'Uncategorised') AS node, date, sum(net_e4) / 10000 AS v FROM line_items WHERE NOT excluded GROUP BY ALL),
      spread AS (SELECT venue, node, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sold GROUP BY venue, node),
      both_levels AS (SELECT venue, node, date, coalesce(v, 0) AS value FROM spread LEFT JOIN sold USING (venue, node, date) UNION ALL SELECT venue, 'VENUE', date, value FROM series),
      medians AS (SELECT venue, node, isodow(date) AS dow, median(value) AS yhat FROM both_levels GROUP BY ALL),
      weights AS (SELECT b.venue, b.node, 1 / greatest(var_pop(value - yhat), 1e-6::DOUBLE) AS w FROM both_levels b JOIN medians m ON m.venue = b.venue AND m.node = b.node AND m.dow = isodow(date) GROUP BY ALL),
      week AS (SELECT max(date) + CAST(8 - isodow(max(date)) + k AS INTEGER) AS date FROM series, range(7) AS r(k) GROUP BY k),
      n AS (SELECT venue, node, date, yhat, w FROM medians JOIN weights USING (venue, node) JOIN week ON isodow(date) = dow),
      root AS (SELECT venue, date, yhat AS y0, w AS w0 FROM n WHERE node = 'VENUE'),
      leaf AS (SELECT *, w + 1e-6::DOUBLE * least(1, avg(w + w0) OVER (PARTITION BY venue, date)) AS a, w * yhat + w0 * y0 AS r FROM n JOIN root USING (venue, date) WHERE node <> 'VENUE'),
      solved AS (SELECT venue, date, node, r / a - w0 / a * sum(r / a) OVER d / (1 + w0 * sum(1 / a) OVER d) AS b FROM leaf WINDOW d AS (PARTITION BY venue, date))
      SELECT venue, date, node, round(b, 2) AS coherent FROM solved UNION ALL SELECT venue, date, 'VENUE', round(sum(b), 2) FROM solved GROUP BY venue, date""",
    "persistence_alarms": f"WITH {_STREAM}, {_PERSISTENCE} SELECT * FROM persistent",
    "change_points": f"WITH RECURSIVE {_STREAM}, {_POINTS} SELECT * FROM points",
    "signal_clusters": f"WITH RECURSIVE {_STREAM}, {_CLUSTERS} SELECT venue, onset, source, direction, cluster FROM clusters",
    "attributed_points": f"""WITH RECURSIVE {_STREAM}, {_POINTS}, {_FACTS}, {_causes_sql("points")}
      SELECT p.venue, p.onset, p.direction, severity, coalesce(causes, '{causes.NOTHING}') AS causes FROM points p LEFT JOIN reasons USING (venue, onset, direction)""",
    "briefing": f"WITH RECURSIVE {_BRIEFING} SELECT * FROM briefing",
    "briefing_envelope": f"""WITH RECURSIVE {_BRIEFING} SELECT (SELECT m FROM latest) AS as_of, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'continuing') AS n_continuing,
      count(*) FILTER (status = 'resolved') AS n_resolved, md5(string_agg(item_key, ',' ORDER BY item_key) FILTER (status <> 'resolved')) AS run_hash FROM briefing""",
}
