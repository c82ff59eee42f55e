"""Rules of detectors, briefings, sources and limits, case by case."""

import datetime
import random
import time
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.ordered import flag_in_order
from quillon.operators import layers, refresh, retrieval, signals
from quillon.sources import readers
from quillon.sources.store import Store

D = datetime.date
FIRST = D(2026, 1, 1)


def stream(spark, z, venue="v"):
    rows = [(venue, FIRST + datetime.timedelta(days=i), 500.0 + 100 * float(x), 500.0, 100.0, float(x)) for i, x in enumerate(z)]
    return spark.createDataFrame(rows, "venue string, date date, actual double, expected double, scale double, z double")


def day(i):
    return FIRST + datetime.timedelta(days=i)


def test_deviation_bounds(spark):
    got = [(r.status, r.direction, r.severity) for r in signals.deviations(stream(spark, [0.0, 1.0, -1.0, 1.01, 2.0, -2.01])).orderBy("date").collect()]
    assert got == [("normal", "down", None), ("normal", "up", None), ("normal", "down", None), ("deviation", "up", "medium"), ("deviation", "up", "medium"), ("deviation", "down", "high")]


def test_persistence_fires_on_full_windows_only(spark):
    z = [2, 2, 2, 2, 0, 0, 0, 0, 0, 0, 0]
    got = [(r.alarm, r.onset, r["count"]) for r in signals.persistence(stream(spark, z)).orderBy("alarm").collect()]
    assert got == [(day(6), day(0), 4)]  # no alarm before day 6, though four breaches stand on day 3; a quiet day can alarm
    z = [0] * 7 + [-2] * 5
    got = [(r.alarm, r.onset, r.direction, r["count"]) for r in signals.persistence(stream(spark, z)).orderBy("alarm").collect()]
    assert got == [(day(10), day(7), "down", 4), (day(11), day(7), "down", 5)]


def plain_points(z):
    """Alarms merged by onset, one row after the other."""
    up = down = 0.0
    fu = fd = 0
    seen = []
    for t, x in enumerate(z):
        fu, fd = (t if up == 0 else fu), (t if down == 0 else fd)
        up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
        if up > 5 or down > 5:
            seen.append((fu if up > 5 else fd, t, "up" if up > 5 else "down", None, "cusum"))
            up = down = 0.0
    for t in range(6, len(z)):
        for d, hit in (("up", lambda x: x > 1), ("down", lambda x: x < -1)):
            places = [k for k in range(t - 6, t + 1) if hit(z[k])]
            if len(places) >= 4:
                seen.append((places[0], t, d, len(places), "persistence"))
    points = {}
    for onset, alarm, d, n, by in seen:
        p = points.setdefault(onset, {"alarm": alarm, "direction": d, "count": n, "by": by})
        p["by"] = p["by"] if p["by"] == by else "both"
        p["alarm"] = min(p["alarm"], alarm)
        p["count"] = n if p["count"] is None else p["count"]
    out = {}
    for onset, p in points.items():
        mag = float(np.mean(z[onset : p["alarm"] + 1]))
        n = p["count"] or 0
        out[day(onset)] = (day(p["alarm"]), p["by"], p["direction"], p["count"], "high" if abs(mag) > 1.5 or n >= 6 else "medium" if abs(mag) > 0.8 or n >= 4 else "low", round(mag, 3))
    return out


def test_change_points_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 0.6, 160)
    z[60:90] += 1.4
    z[120:] -= 2
    z = np.round(z, 6)
    df = stream(spark, z)
    spans = spark.createDataFrame([("v", day(159), False)], "venue string, last_active date, is_closed boolean")
    got = {r.onset: (r.alarm, r.detector, r.direction, r["count"], r.severity, r.magnitude) for r in signals.change_points(df, spans).collect()}
    want = plain_points(z.tolist())
    assert got == want and {w[1] for w in want.values()} >= {"both", "persistence"} and len({w[4] for w in want.values()}) > 1
    # few days: nothing, but for an event-only venue, which persistence alone watches
    short = stream(spark, z[60:90])
    assert signals.change_points(short, spans).count() == 0
    assert {r.detector for r in signals.change_points(short, spans, event_only=("v",)).collect()} == {"persistence"}
    # after a closure later falls are left out
    closed = spark.createDataFrame([("v", day(121), True)], "venue string, last_active date, is_closed boolean")
    left = signals.change_points(df, closed).collect()
    falls = sorted(r.onset for r in left if r.direction == "down" and r.onset >= day(114))
    assert len(falls) == 1 and [r.is_closure for r in left if r.onset == falls[0]] == [True]


def test_trading_series_shows_a_closure(spark):
    rows = [("open", day(i), 5.0 if 2 <= i <= 9 else 0.0) for i in range(10)] + [("shut", day(i), 5.0 if 1 <= i <= 4 else 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "venue string, date date, value double")
    got = {}
    for r in layers.trading_series(df).orderBy("date").collect():
        got.setdefault(r.venue, []).append((r.date, r.value))
    assert got["open"] == [(day(i), 5.0) for i in range(2, 10)]
    assert got["shut"] == [(day(i), 5.0 if i <= 4 else 0.0) for i in range(1, 10)]
    assert [r.date for r in layers.trading_series(df, event_only=("shut",)).where("venue = 'shut'").orderBy("date").collect()][-1] == day(4)


def test_briefing_heads(spark):
    schema = "venue string, source string, onset date, direction string, severity string"
    items = lambda rows, **more: signals.briefing_items(signals.clusters(spark.createDataFrame(rows, schema)), "2026-01-20", **more).collect()
    one = items([("v", "stock", day(12), "down", "high"), ("v", "deviation", day(10), "down", "medium")])
    assert [(r.source, r.onset, r.n_evidence, r.caveats, r.item_key) for r in one] == [("deviation", day(10), 1, ["action: reorder"], "v:down:2026-01-11:deviation")]
    assert items([("v", "stock", day(12), "down", "low"), ("v", "checklist", day(13), "down", "high")])[0].source == "stock"
    assert items([("v", "sop", day(12), "na", "high"), ("v", "checklist", day(13), "na", "low")])[0].source == "sop"
    sparse = items([("v", "deviation", day(19), "up", "high")], event_only=("v",))[0]
    assert sparse.trust == 0.5 and sparse.caveats == ["small-sample"] and sparse.score == round(0.6 * 1.5 * 1.25 * 0.5, 6)
    assert items([("v", "deviation", day(18), "up", "high"), ("v", "deviation", day(19), "up", "high")], event_only=("v",))[0].trust == 1.0


def test_export_adapter(spark, tmp_path):
    head = "\t".join([*readers.EXPORT_COLUMNS, "Extra"])
    line = lambda place, n: "\t".join(["2025-07-01", "18:05:00", "Beer", "Pale", "Pint", "2", f"£{n}.00", "£12.00", "-£2.00", "£1.67", f"T{n}", place, "POS", "x"])
    (tmp_path / "x.tsv").write_text("\n".join([head, line("Beer Hall", 10), line("Nowhere", 11), line('"BEER  hall"', 12)]), encoding="utf-16")
    source = readers.adapter("export", spark, path=str(tmp_path / "x.tsv"), venues={"beer hall": "hall"}, vat_inclusive=("hall",))
    rows = source.transactions().orderBy("net_sales").collect()
    assert [(r.venue, r.net_sales) for r in rows] == [("hall", 10.0), ("hall", 12.0)] and rows[0].net_sales_exvat == pytest.approx(10 / 1.2)
    assert source.latest_date() == "2025-07-01" and source.transactions("2025-07-01").count() == 0


def test_pointer_moves_by_rename(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in (1, 2, 3):
        store.replace("t", spark.range(n))
        assert store.read("t").count() == n
        assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("_current")] == ["_current"]


def test_schedules_beyond_a_month(spark):
    t = F.lit("2025-01-31 10:30:00").cast("timestamp")
    row = spark.range(1).select(refresh.next_run(t, "UTC", F.lit("monthly"), F.lit(9), F.lit(31)).cast("string").alias("a"), refresh.next_run(t, "UTC", F.lit("monthly"), F.lit(9), F.lit(1)).cast("string").alias("b")).first()
    assert (row.a, row.b) == ("2025-02-01 10:00:00", "2025-02-01 09:00:00")
    due = spark.createDataFrame([(1, "daily", 9, 0, datetime.datetime(2025, 1, 31, 9), True), (2, "daily", 9, 0, datetime.datetime(2025, 2, 3, 9), True)], "schedule_id int, kind string, hour int, day int, next_run_at timestamp, active boolean")
    claimed = refresh.claim_due(due, "2025-01-31 10:30:00")
    got = {r.schedule_id: str(r.next_run_at) for r in refresh.advanced(due, claimed, "2025-01-31 10:30:00", "UTC").collect()}
    assert got == {1: "2025-02-01 09:00:00", 2: "2025-02-03 09:00:00"}


def test_flags_in_order_stream_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, rng.randrange(9)) for i in range(30_000)] + [(None, 1, 3), (None, 2, 3)]
    df = spark.createDataFrame(rows, "k string, i int, x int")
    got = flag_in_order(df, ["k"], ["i"], ["x"], lambda s, x: ((s or 0) + x, ((s or 0) + x) % 2 == 0), "even")
    sums, want = {}, {}
    for k, i, x in rows:
        sums[k] = sums.get(k, 0) + x
        want[k, i] = sums[k] % 2 == 0
    assert {(r.k, r.i): r.even for r in got.collect()} == want


def test_guards_and_retagging(spark):
    at = lambda h: datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=h)
    issued = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(20)), ("b", at(0))], "issuer string, at timestamp")
    asked = spark.createDataFrame([("a", at(2)), ("a", at(24)), ("a", at(25)), ("b", at(2)), ("c", at(2))], "issuer string, at timestamp")
    got = {(r.issuer, r["at"]): r.allowed for r in refresh.issuer_guard(issued, asked, 2).collect()}
    assert got == {("a", at(2)): False, ("a", at(24)): False, ("a", at(25)): True, ("b", at(2)): True, ("c", at(2)): True}
    tagged = spark.createDataFrame([("x", 0.2), ("x", 0.9), ("y", 0.2), ("z", 0.1)], "item_id string, similarity double")
    queue = spark.createDataFrame([("z", "pending", 1)], "item_id string, status string, attempts int")
    assert [r.item_id for r in refresh.retag_candidates(tagged, queue, least=0.5).collect()] == ["y"]


def test_recall_paths_are_united(spark):
    schema = "id int, similarity double, bm25_rank int"
    a, b = spark.createDataFrame([(1, 0.9, None), (2, 0.2, None)], schema), spark.createDataFrame([(1, 0.95, None), (3, None, 1)], schema)
    got = [(r.id, r.similarity, r.bm25_rank, r.path, r.weak) for r in retrieval.find([a, b], limit=500).collect()]
    assert got == [(1, 0.95, None, 1, False), (3, None, 1, 1, False)]
    assert retrieval.find([a], limit=0).count() == 1 and retrieval.find([a.where("id = 2")], limit=5).count() == 0


def test_next_runs_where_clocks_change(spark):
    zone, now = "Europe/London", datetime.datetime(2024, 3, 29, 22, 17)
    kinds = ["daily", "weekly", "monthly"]
    asked = [(i, kinds[i % 3], i % 24, i % 33) for i in range(1056)]
    local = [(k, (now.replace(minute=0, tzinfo=datetime.UTC) + datetime.timedelta(hours=k)).astimezone(zoneinfo.ZoneInfo(zone))) for k in range(1, 769)]
    fits = {"daily": lambda t, d: True, "weekly": lambda t, d: t.weekday() == d, "monthly": lambda t, d: t.day == d}
    want = {i: now.replace(minute=0) + datetime.timedelta(hours=next((k for k, t in local if t.hour == h and fits[kind](t, d)), 24)) for i, kind, h, d in asked}
    at = F.lit(str(now)).cast("timestamp")
    df = spark.createDataFrame(asked, "id int, kind string, hour int, day int").select("id", refresh.next_run(at, zone, F.col("kind"), F.col("hour"), F.col("day")).cast("timestamp_ntz").alias("t"))
    assert {r.id: r.t for r in df.collect()} == want


def test_next_runs_of_many_schedules_are_few_steps_each(spark):
    """All hours of a month were looked at for every schedule: 768 steps each."""
    at = F.lit("2024-03-30 10:30:00").cast("timestamp")
    once = lambda n: spark.range(n).select(F.max(refresh.next_run(at, "Europe/London", F.lit("weekly"), (F.col("id") % 24).cast("int"), (F.col("id") % 7).cast("int")))).collect()
    once(10)
    began = time.time()
    once(20_000)
    assert time.time() - began < 15


def test_a_stock_table_of_one_file_is_dealt_by_product(spark, sf_dir):
    from quillon.plans.inventory import QUERIES, _panel

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stock_id" in plan(_panel(spark, sf_dir))
    assert plan(QUERIES["product_master"](spark, sf_dir)).count("Exchange hashpartitioning") == 1
