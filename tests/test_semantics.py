"""Properties and edge cases of the operators."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions import cleaning, conventions
from quillon.operators import features, forecast, layers, metrics, pos, refresh, retrieval, signals, smoothing, tabular
from quillon.sources import readers
from quillon.sources.store import Store, append_run, merged
from quillon.streaming import streams

D = datetime.date


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


def series(spark, values, venue="v", start=D(2025, 1, 6)):
    return spark.createDataFrame([(venue, start + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)], "venue string, date date, value double")


def test_rounding_and_weekdays(spark):
    assert one(spark, conventions.round_up_half(F.col("a"), 0), a=-2.5) == -2.0
    assert one(spark, conventions.round_half_even(F.col("a"), 0), a=2.5) == 2.0
    assert one(spark, conventions.dow_sunday(F.col("d")), d=D(2026, 5, 17)) == 0
    assert one(spark, conventions.dow_monday(F.col("d")), d=D(2026, 5, 17)) == 6
    assert one(spark, conventions.week_start(F.col("t")), t=datetime.datetime(2026, 5, 17, 12)) == D(2026, 5, 11)


@pytest.mark.parametrize(("given", "want"), [("£5.00", 5.0), ("-£5", -5.0), ("(£5)", -5.0), ("1,234.5", 1234.5), ("x", None), ("", None)])
def test_currency(spark, given, want):
    assert one(spark, cleaning.parse_currency(F.col("a")), a=given) == want


def test_cleaning(spark):
    assert one(spark, cleaning.canonical_product(F.col("a")), a="Hop & Co: Session IPA") == "hop co session ipa"
    assert one(spark, cleaning.canonical_venue(F.col("a"), {"beer hall": "hall"}), a=' "Beer   HALL" ') == "hall"
    assert one(spark, cleaning.clean_string(F.col("a")), a='""') is None
    assert one(spark, cleaning.keg_litres(F.col("a")), a="Keg 30L") == 30
    assert one(spark, cleaning.pints_per_keg(F.lit(None).cast("int"), F.col("a")), a="cask") == 88.0
    assert one(spark, cleaning.first_tag(F.col("a"), [("bar", "b"), ("kitchen", "k")], "estate"), a="The kitchen bar") == "b"
    assert one(spark, cleaning.substantive(F.col("a")), a="why?") is True
    assert one(spark, cleaning.substantive(F.col("a")), a="ok then") is False
    assert one(spark, cleaning.money(F.col("a"), F.lit("JPY")), a=500) == 500.0
    assert one(spark, cleaning.date_in(F.col("a")), a="stock_2025-11-03.xlsx") == D(2025, 11, 3)
    assert one(spark, cleaning.parse_when(F.lit("2025-07-01"), F.col("a"), "Europe/London"), a="") == datetime.datetime(2025, 6, 30, 23)
    assert one(spark, cleaning.sanitise(F.col("a"), 9), a="one  two three") == "one two"


def test_perfect_forecast_and_short_series(spark):
    df = spark.createDataFrame([("v", 1.0, 1.0, 2.0), ("v", 0.0, 0.0, 2.0)], "venue string, y double, yhat double, scale double")
    r = metrics.error_metrics(df, ["venue"]).first()
    assert (r.mae, r.rmse, r.smape, r.mase) == (0, 0, 0, 0)
    assert metrics.mase_scale(series(spark, range(7)), ["venue"]).first().scale is None


def test_interval_metrics(spark):
    rows = [("v", float(y), 0.0, 10.0, 0.9) for y in (1, 5, 9, 12)]
    r = metrics.interval_metrics(spark.createDataFrame(rows, "venue string, y double, lo double, hi double, level double"), ["venue"]).first()
    assert r.coverage == 0.75 and r.winkler > r.width


def test_conformal_quantile(spark):
    scores = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None)], "g string, score double")
    got = {r.g: (r.n, r.q) for r in metrics.conformal_quantiles(scores, ["g"], 0.8).collect()}
    assert got == {"a": (10, 9.0)}
    assert one(spark, conventions.order_statistic(F.col("a"), 0.8), a=[float(i) for i in range(1, 11)]) == 9.0
    assert one(spark, conventions.order_statistic(F.filter(F.col("a"), lambda x: x > 9), 0.8), a=[1.0]) is None


def test_calendar_and_lags(spark):
    days = spark.createDataFrame([("v", D(2025, 1, 1), 1.0), ("v", D(2025, 1, 4), 2.0)], "venue string, date date, value double")
    got = [r.value for r in layers.dense_calendar(days, ["venue"], ["value"]).orderBy("date").collect()]
    assert got == [1.0, 0.0, 0.0, 2.0]
    rows = features.history_features(series(spark, range(60)), ["venue"]).orderBy("date").collect()
    assert rows[10].lag_7 == 3.0 and rows[5].roll_mean_28 is None and rows[40].roll_median_28 == 25.5


def test_folds_do_not_leak(spark):
    folds = features.rolling_origin(series(spark, range(200)))
    assert features.assert_no_leakage(folds).where("leaks or leaks is null").count() == 0
    assert folds.select("fold").distinct().count() == 6


def test_smoothing_beats_naive_on_a_season():
    y = np.array([200 + 400 * (i % 7 == 4) + 300 * (i % 7 == 5) + 50 * (i % 7 >= 2) for i in range(84)], dtype=float)
    rising = y + 2 * np.arange(84)
    for y, model in ((y, smoothing.stl_forecast), (rising, smoothing.smoothing_forecast)):
        naive = np.tile(y[63:70], 2)
        got = model(y[:70], 14)
        assert (got >= 0).all()
        assert np.abs(got - y[70:]).mean() <= np.abs(naive - y[70:]).mean() + 1e-6
    assert len(smoothing.smoothing_forecast(np.zeros(0), 3)) == 3


def test_reconciliation_is_coherent(spark):
    names = [("VENUE", None, 10.0), ("A", "VENUE", 4.0), ("B", "VENUE", 5.0), ("a1", "A", 1.0), ("a2", "A", 2.0), ("b1", "B", 2.0)]
    df = spark.createDataFrame([("v", D(2025, 1, 1), n, p, y, 1.0) for n, p, y in names], "venue string, date date, node string, parent string, yhat double, variance double")
    got = {r.node: r.coherent for r in forecast.reconcile(df).collect()}
    assert abs(got["VENUE"] - got["A"] - got["B"]) < 1e-6 and abs(got["A"] - got["a1"] - got["a2"]) < 1e-6


def stream(spark, z):
    return spark.createDataFrame([("v", D(2026, 1, 1) + datetime.timedelta(days=i), 500.0 + 100 * float(x), 500.0, 100.0, float(x)) for i, x in enumerate(z)], "venue string, date date, actual double, expected double, scale double, z double")


def test_detectors(spark):
    up = signals.cusum(stream(spark, [0] * 40 + [1.5] * 30)).collect()
    assert up and up[0].direction == "up" and up[0].onset >= D(2026, 2, 10)
    quiet = np.random.default_rng(0).normal(0, 0.3, 300)
    assert signals.cusum(stream(spark, quiet)).count() == 0
    held = signals.persistence(stream(spark, [0] * 20 + [2] * 10)).orderBy("alarm").collect()
    assert held[0].onset == D(2026, 1, 21)
    assert signals.persistence(stream(spark, [0] * 20 + [3] + [0] * 20)).count() == 0
    lengths = {r.date: r for r in signals.run_lengths(stream(spark, [0] * 30 + [6] * 10)).collect()}
    assert lengths[D(2026, 2, 4)].p_change > lengths[D(2026, 1, 29)].p_change


def test_run_lengths_beyond_400(spark):
    calm = np.random.default_rng(1).normal(0, 1, 500)
    rows = signals.run_lengths(stream(spark, calm)).orderBy("date").collect()
    assert len(rows) == 500 and rows[-1].run >= 480 and rows[-1].run - rows[-51].run == 50


def test_clusters_and_briefing(spark):
    rows = [("hall", "change_point", D(2025, 12, 27), "down", "high"), ("hall", "deviation", D(2025, 12, 24), "down", "medium"), ("hall", "deviation", D(2025, 12, 25), "down", "medium"), ("hall", "deviation", D(2025, 12, 26), "down", "medium"), ("hall", "stock", D(2025, 12, 29), "down", "high")]
    df = spark.createDataFrame(rows, "venue string, source string, onset date, direction string, severity string")
    items = signals.briefing_items(signals.clusters(df), "2025-12-29").collect()
    assert len(items) == 1 and items[0].n_evidence == 4 and items[0].source == "change_point" and items[0].status == "new"
    prior = spark.createDataFrame([(items[0].item_key, 1.0), ("gone", 0.8)], "item_key string, score double")
    again = {r.item_key: r for r in signals.briefing_items(signals.clusters(df), "2025-12-29", prior).collect()}
    assert again[items[0].item_key].status == "continuing" and again["gone"].status == "resolved" and again["gone"].score == 0.4


def test_attribution_window(spark):
    points = spark.createDataFrame([("v", D(2025, 7, 3), "up")], "venue string, onset date, direction string")
    causes = spark.createDataFrame([(None, D(2025, 7, 1), "price", "rise"), ("w", D(2025, 7, 3), "event", "other"), ("v", D(2025, 7, 20), "event", "far"), ("v", D(2025, 7, 8), "event", "near")], "venue string, date date, kind string, label string")
    assert signals.attribute(points, causes).first().causes == ["price:rise", "event:near"]


def test_cover_and_checklist(spark):
    stock = spark.createDataFrame([("a", 1.0, 88.0), ("b", 1.0, 88.0)], "product string, kegs double, pints_per_keg double")
    got = {r["product"]: r for r in signals.days_of_cover(stock, spark.createDataFrame([("a", 44.0)], "product string, daily_pints double")).collect()}
    assert got["a"].days == 2.0 and got["a"].reorder and got["a"].order_kegs == 5 and got["b"].days is None
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# Opening", "1. Unlock the safe", "2. Wipe tables", "3. If wet, lay mats", "4. Sunday only: polish", "5. Sign off"])], "file string, line_no int, line string")
    steps = readers.parse_checklist(lines)
    assert [(r.number, r.weight, r.section) for r in steps.orderBy("number").collect()] == [(1, 5, "Opening"), (2, 1, "Opening"), (3, 0, "Opening"), (4, 1, "Opening"), (5, 1, "Opening")]
    r = signals.checklist(steps, steps.where("number = 2").select("number")).first()
    assert (r.n_steps, r.n_missed, r.n_critical, r.unsigned, r.skipped, r.severity) == (4, 3, 1, 1, False, "medium")


def test_stock_sheet(spark):
    rows = [("f", 1, "DRAUGHT", None, None), ("f", 2, "Kegs", None, None), ("f", 3, "Pale 30L", 1.0, 10.0), ("f", 4, "pale 30l", 2.0, 20.0), ("f", 5, "Total draught", 3.0, None)]
    got = readers.parse_stock_sheet(spark.createDataFrame(rows, "file string, row_no int, a string, qty double, unit_price double")).collect()
    assert [(r.l1, r.l2, r["product"], r.qty, r.unit_price) for r in got] == [("DRAUGHT", "Kegs", "Pale 30L", 3.0, 15.0)]


def test_export(spark, tmp_path):
    head = "\t".join(readers.EXPORT_COLUMNS)
    body = "\t".join(["2025-07-01", "18:05:00", "Beer", "Pale", "Pint", "2", "£10.00", "£12.00", "-£2.00", "£1.67", "T1", "Beer Hall", "POS"])
    bad = "\t".join(["2025-07-01", "", "Beer", "Pale", "Pint", "1", "x", "", "", "", "", "Nowhere", ""])
    p = tmp_path / "x.tsv"
    p.write_text("\n".join([head, body, bad]), encoding="utf-16")
    got = readers.normalise_export(readers.read_export(spark, str(p)), {"beer hall": "hall"}, vat_inclusive=("hall",)).orderBy("venue").collect()
    assert got[0].drop_reason == "unknown venue" and got[0].net_sales is None
    assert got[1].drop_reason is None and got[1].net_sales_exvat == pytest.approx(10 / 1.2) and got[1].ts == datetime.datetime(2025, 7, 1, 17, 5)
    with pytest.raises(ValueError, match="missing"):
        features.require_columns(spark.range(1), ["Date"])


def test_upload_formats(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\ny")
    (tmp_path / "a.pdf").write_bytes(b"abc")
    assert readers.read_upload(spark, str(tmp_path / "a.md")).first().text == "# x\ny"
    assert readers.read_upload(spark, str(tmp_path / "a.pdf")).first().length == 3
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_upload(spark, "a.exe")
    with pytest.raises(ValueError, match="unknown source"):
        readers.adapter("nowhere", spark)


def test_tabular(spark):
    data = [("Pinot Noir", "25", "£9.50"), ("Sauvignon", "17", "8"), ("Cabernet", "15", "10"), ("Gamay", "10", "7"), ("Merlot", "", "1,000")]
    rows = tabular.to_rows(spark.createDataFrame(data, "name string, qty string, price string"), "d", [F.col("name")])
    types = {r.name: r.inferred for r in tabular.infer_types(rows).collect()}
    assert types == {"name": "string", "qty": "number", "price": "number"}
    got, limit = tabular.run(rows, types, tabular.Query(group_by="name", aggregate=("sum", "qty"), limit=3))
    assert [(r.key, r.value) for r in got.collect()][:3] == [("Pinot Noir", 25.0), ("Sauvignon", 17.0), ("Cabernet", 15.0)] and limit == 3
    got, _ = tabular.run(rows, types, tabular.Query(where=[("PRICE", "gte", "£1000")]))
    assert [r.data["name"] for r in got.collect()] == ["Merlot"]
    with pytest.raises(tabular.TabularError):
        tabular.run(rows, types, tabular.Query(aggregate=("sum", "name")))
    with pytest.raises(tabular.TabularError):
        tabular.run(rows, types, tabular.Query(where=[("nope", "eq", "1")]))


def test_retrieval_helpers(spark):
    v = spark.createDataFrame([(1, 1, None), (2, 2, 5)], "rank int, id int, section int")
    x = spark.createDataFrame([(1, 1, None)], "rank int, id int, section int")
    got = {r.id: (r.vec_rank, r.bm25_rank, r.score) for r in retrieval.fuse(v, x, ["id", "section"]).collect()}
    assert got == {1: (1, 1, round(2 / 61, 9)), 2: (2, None, round(1 / 62, 9))}
    assert [t for t, _ in retrieval.split_at_headings("intro\n# A\nx\n---\ny\nLOUD WORDS\nz")] == ["", "A", "", "LOUD WORDS"]
    docs = spark.createDataFrame([(1, "ab " * 4000), (2, ""), (3, None)], "doc_id int, text string")
    c = retrieval.chunks(docs).orderBy("chunk").collect()
    assert {r.doc_id for r in c} == {1} and all(len(r.text) <= 4096 for r in c) and c[-1].start + len(c[-1].text) == 12000
    hits = spark.createDataFrame([("q", i, c) for i, c in enumerate([30_000, 10, 23_000, 5])], "q string, place int, cost long")
    assert [r.kept for r in retrieval.within_budget(hits, ["q"], ["place"], "cost").orderBy("place").collect()] == [True, False, False, False]
    long = retrieval.heading_sections(spark.createDataFrame([(1, "# A\n" + "x" * 20_000)], "doc_id int, text string")).first()
    assert long.truncated and long.text == "x" * 20_000  # the whole body stays; its chunks stand for it


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "venue string, key string, yhat double"
    assert store.read("f", schema).count() == 0
    store.upsert("f", spark.createDataFrame([("v", None, 1.0)], schema), ["venue", "key"])
    store.upsert("f", spark.createDataFrame([("v", None, 2.0), ("v", "k", 3.0)], schema), ["venue", "key"])
    assert sorted(r.yhat for r in store.read("f").collect()) == [2.0, 3.0]
    store.append("f", spark.createDataFrame([("w", None, 4.0)], schema))
    assert store.read("f").count() == 3
    append_run(store, spark.createDataFrame([], "item_key string, score double"), "2025-01-01")
    assert store.read("briefing_runs").first().item_key == "__none__"
    assert merged(store.read("f"), store.read("f"), ["venue", "key"]).count() == 3


def test_refresh_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("v", D(2025, 1, 1)), ("w", D(2025, 1, 5))], "venue string, date date")
    more = rows.unionByName(spark.createDataFrame([("v", D(2025, 1, 2)), ("w", D(2025, 1, 4))], "venue string, date date"))
    assert refresh.refresh(store, rows, "L1", "2025-01-06 00:00:00") == 2
    assert refresh.refresh(store, more, "L1", "2025-01-06 00:00:00") == 1
    assert refresh.refresh(store, more, "L1", "2025-01-06 00:00:00") == 0
    assert store.read("data_watermark").count() == 2


def test_schedules_and_limits(spark):
    got = one(spark, refresh.next_run(F.col("t").cast("timestamp"), "Europe/London", F.lit("daily"), F.lit(9), F.lit(0)).cast("string"), t="2024-03-30 10:30:00")
    assert got == "2024-03-31 08:00:00"
    hits = spark.createDataFrame([("k", datetime.datetime(2024, 1, 1, 0, m)) for m in range(4)], "key string, at timestamp")
    assert [r.allowed for r in refresh.rate_limited(hits, most=2).orderBy("at").collect()] == [True, True, False, False]
    seen = spark.createDataFrame([("m", datetime.datetime(2024, 1, d, h)) for d, h in ((1, 0), (1, 20), (2, 1), (2, 20))], "message_id string, at timestamp")
    assert refresh.first_sightings(seen).count() == 2
    queue = spark.createDataFrame([("a", "pending", 0), ("b", "failed", 3), ("c", "failed", 1)], "item_id string, status string, attempts int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item_id string")
    assert sorted(r.item_id for r in refresh.enqueue(queue, wanted).collect()) == ["c", "d"]
    decisions = refresh.should_refit("auto", spark.createDataFrame([("v", D(2025, 1, 1)), ("w", D(2025, 1, 6))], "venue string, fit_date date"), spark.createDataFrame([("w", D(2025, 1, 7))], "venue string, onset date"), "2025-01-08")
    assert all(r.refit for r in decisions.collect())


def test_pos_edges(spark):
    empty = spark.createDataFrame([], "gross_cents long")
    assert pos.refund_summary(empty, empty).first().rate is None
    rows, more = pos.list_with_cap(spark.range(7), [F.col("id")], 5)
    assert rows.count() == 5 and more
    s = spark.createDataFrame([(1, Row(a=1, is_deleted=True), Row(a=2, is_deleted=False)), (2, None, Row(a=3, is_deleted=False))], "shift_id int, published struct<a:int,is_deleted:boolean>, draft struct<a:int,is_deleted:boolean>")
    assert [r.shift_id for r in pos.published_shift(s).collect()] == [2]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("m1", datetime.datetime(2024, 1, 1)), ("m1", datetime.datetime(2024, 1, 1, 1)), ("m2", datetime.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "message_id string, at timestamp")
    df.write.parquet(str(src))
    q = streams.first_messages(streams.event_stream(spark, str(src), df.schema)).writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
    days = spark.createDataFrame([("v", D(2025, 1, 1)), ("v", D(2025, 1, 2))], "venue string, date date")
    days.write.parquet(str(tmp_path / "days"))
    store = Store(spark, str(tmp_path / "store"))
    q = streams.append_new_days(streams.event_stream(spark, str(tmp_path / "days"), days.schema), store, lambda s, b: refresh.refresh(s, b, "L1", "2025-01-03 00:00:00"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert store.read("line_items").count() == 2
    events = spark.createDataFrame([("hall", "down", datetime.datetime(2024, 1, d)) for d in (1, 5, 20)], "venue string, direction string, onset timestamp")
    events.write.parquet(str(tmp_path / "sig"))
    q = streams.sessions(streams.event_stream(spark, str(tmp_path / "sig"), events.schema)).writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]


def test_empty_tables(spark):
    none = series(spark, [])
    assert layers.dense_calendar(none, ["venue"], ["value"]).count() == 0
    assert signals.residual_stream(none).count() == 0
    assert features.rolling_origin(none).count() == 0
    assert forecast.seasonal_naive(features.rolling_origin(none)).count() == 0
    assert isinstance(pd.DataFrame(layers.active_span(none).collect()), pd.DataFrame)


def test_inbox_and_stock(spark):
    from quillon.operators import inbox, inventory

    calls = [[("search", True, 1), ("escalate", False, 2), ("escalate", True, 9), ("escalate", True, 3)]]
    df = spark.createDataFrame([tuple(calls)], "calls array<struct<tool:string,ok:boolean,target:long>>")
    assert df.select(inbox.escalation(F.col("calls"), F.lit(9)).alias("x")).first().x == 3
    people = spark.createDataFrame([(1, "Ann Bell", "bar manager"), (2, "Bob", "chef")], "user_id int, name string, role string")
    assert [r.user_id for r in inbox.person(people, "the manager").collect()] == [1]
    stock = spark.createDataFrame([("Gin", 2), ("Rum", 5), ("rum", 1)], "name string, current int")
    assert sorted(r.current for r in inventory.update_one(stock, "gin", -9).collect()) == [0, 1, 5]
    assert sorted(r.current for r in inventory.update_one(stock, "rum", -9).collect()) == [1, 2, 5]
    rows = spark.createDataFrame([('{"tags": ["a", "b"], "t": "xyz"}',), ("bad",)], "meta string")
    assert inbox.metadata_filter(rows, "meta", "$.tags", holds="b").count() == 1 and inbox.metadata_filter(rows, "meta", "$.t", contains="y").count() == 1
    note = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "n")], "created_at timestamp, text string")
    assert [r.source for r in inbox.thread(note, note).collect()] == ["note", "reply"]


def test_studies(spark):
    from quillon.operators import studies

    rows = spark.createDataFrame([(float(i), float(i % 5), 2.0 * i + 3 * (i % 5)) for i in range(60)], "a double, b double, y double")
    got = studies.incremental_fit(rows, "y", ["a"], ["b"])
    assert got["r2"] > 0.999 and got["p_b"] < 1e-6
    base = spark.createDataFrame([("v", 1.0, 0.9), ("w", 1.0, 0.9)], "venue string, mase double, coverage double")
    trial = spark.createDataFrame([("v", 0.9, 0.88), ("w", 0.9, 0.8)], "venue string, mase double, coverage double")
    assert {r.venue: r.adopt for r in studies.adopt_features(base, trial).collect()} == {"v": True, "w": False}
    scored = spark.createDataFrame([(i, float(i), float(i), 1.0) for i in range(30)], "row_id long, y double, x double, c double")
    rise = {r.feature: r.rise for r in studies.permutation_importance(scored, lambda d: d.withColumn("yhat", F.col("x")), ["x", "c"]).collect()}
    assert rise["x"] > 0 and rise["c"] == 0


def test_windows():
    from quillon.functions.windows import resolve

    now = datetime.datetime(2024, 3, 1)
    assert resolve(now, hours=24) == (datetime.datetime(2024, 2, 29), now, False)
    assert resolve(now, since="2024-01-01", until="2024-03-01", most_hours=24) == (datetime.datetime(2024, 2, 29), now, True)
    assert resolve(now, hours=48, most_hours=24, forward=True) == (now, datetime.datetime(2024, 3, 2), True)
    for bad in ({}, {"hours": 1, "since": "2024-01-01"}, {"hours": 0}, {"since": "2024-03-02", "until": "2024-03-01"}):
        with pytest.raises(ValueError):
            resolve(now, **bad)


def test_best_section(spark):
    hits = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    matched = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.2)], "id int, section_id int, dist double")
    sections = spark.createDataFrame([(1, 10, 0), (2, 21, 1), (2, 20, 0)], "id int, section_id int, position int")
    assert {r.id: r.section_id for r in retrieval.best_section(hits, matched, sections).collect()} == {1: 11, 2: 20, 3: None}


def test_cost_summary_reasons(spark):
    lines = "variation_id long, quantity long, gross_cents long"
    costs = spark.createDataFrame([(1, 40)], "variation_id long, unit_cost long")
    some = spark.createDataFrame([(1, 2, 300), (2, 1, 100)], lines)
    row = pos.cogs_summary(some, costs).first()
    assert (row["gross"], row["cogs"], row["coverage"], row["margin"], row["n_uncosted"], row["ask_percent"], row["no_data"]) == (400, 80, 50.0, 80.0, 1, False, None)
    assert pos.cogs_summary(some, costs.where("false")).first()["no_data"] == "no-known-costs"
    empty = pos.cogs_summary(some.where("false"), costs).first()
    assert (empty["gross"], empty["coverage"], empty["margin"], empty["no_data"]) == (0, 0.0, None, "no-completed-orders")
    unit = pos.item_unit_costs(spark.createDataFrame([(1, 3, 100), (1, 1, 103), (2, 5, 0), (3, 0, 9)], "variation_id long, quantity long, unit_cents long"))
    assert [tuple(r) for r in unit.collect()] == [(1, 100)]


def test_cost_from_percent(spark):
    rows = spark.createDataFrame([(1000.0, 30.0), (0.25, 10.0), (-1.0, 30.0), (5.0, 100.5), (None, 30.0)], "g double, p double")
    got = [tuple(r) for r in rows.select(*pos.cogs_from_percent(F.col("g"), F.col("p"))).collect()]
    assert got[0] == (300.0, 70.0) and got[1] == (0.03, 90.0) and got[2] == (None, None) and got[3] == (None, None) and got[4][0] is None


def test_loyalty_and_bookings(spark):
    programs = spark.createDataFrame([("b", "ACTIVE", "stars", 2), ("a", "INACTIVE", None, 1)], "program_id string, status string, points_name string, position int")
    accounts = spark.createDataFrame([(5,), (None,), (7,)], "balance long")
    assert tuple(pos.loyalty_summary(programs, accounts).first()) == ("a", "INACTIVE", "points", 3, 12)
    assert tuple(pos.loyalty_summary(programs.where("false"), accounts).first()) == (None, "NO_PROGRAM", None, 0, 0)
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = spark.createDataFrame([(1, "ACCEPTED", at(2)), (1, "CANCELLED_BY_CUSTOMER", at(1, 1)), (1, None, at(8)), (1, "PENDING", at(9)), (1, "PENDING", at(1))], "location_id int, status string, start_at timestamp_ntz")
    assert tuple(pos.booking_summary(rows, "2024-01-01 00:30:00").first()) == (1, 3, 1, 0, 1, at(1, 1))
    assert pos.booking_summary(rows, "2024-01-01", 0).first()["n_upcoming"] == 2  # at least one hour


def test_rota_counts_drafts_only_when_asked(spark):
    version = "struct<member_id:int,job:string,location_id:int,start_at:timestamp_ntz,end_at:timestamp_ntz,is_deleted:boolean>"
    one = lambda h, gone=False, member=1: f"named_struct('member_id', {member}, 'job', 'bar', 'location_id', 1, 'start_at', timestamp_ntz'2024-01-01 10:00:00', 'end_at', timestamp_ntz'2024-01-01 {h}:00:00', 'is_deleted', {gone})"
    null = f"cast(null as {version})"
    cells = [(one(12), one(13)), (one(11), null), (one(12), one(12, True)), (null, one("09")), (null, one(11, member=2))]
    rows = spark.sql(" UNION ALL ".join(f"SELECT {i} AS shift_id, {d} AS draft, {p} AS published" for i, (d, p) in enumerate(cells)))
    wages = spark.createDataFrame([(1, None, 1001)], "member_id int, job string, rate_cents long")
    assert tuple(pos.scheduled_labour(rows, wages, "2024-01-01", "2024-01-02").first()) == (1, 2, 4.0, 3003, 50.0, 1)
    assert tuple(pos.scheduled_labour(rows, wages, "2024-01-01", "2024-01-02", drafts=True).first()) == (1, 3, 5.0, 4004, 66.67, 1)


def test_inputs_of_a_recursive_day_are_those_of_history(spark):
    for n in (5, 8, 40):
        values = [float((i * 37) % 11) for i in range(n)]
        days = [("v", datetime.date(2024, 1, 1) + datetime.timedelta(i), x) for i, x in enumerate([*values, None])]
        want = features.history_features(spark.createDataFrame(days, "venue string, date date, value double"), ["venue"]).orderBy(F.desc("date")).first()
        got = spark.createDataFrame([(values[-28:],)], "past array<double>").select(*(c.alias(k) for k, c in forecast._recent(F.col("past")).items())).first()
        assert all(got[k] == want[k] for k in ("lag_7", "lag_14", "roll_mean_28", "roll_median_28"))


def test_other_is_clipped_on_each_day(spark):
    rows = [("v", "c", "a", "2024-01-01", 50.0), ("v", "c", "b", "2024-01-01", -9.0), ("v", "c", "b", "2024-01-03", 4.0), ("v", "d", "x", "2024-01-02", 1.0)]
    days = spark.createDataFrame(rows, "venue string, category string, item string, date string, revenue double").selectExpr("venue", "category", "item", "to_date(date) AS date", "revenue")
    got = {(r["node"], r["date"].day): r["value"] for r in layers.node_series(days, k=1).collect()}
    assert [got[("ITEM::c::OTHER", d)] for d in (1, 2, 3)] == [0.0, 0.0, 4.0]
    assert [got[("VENUE", d)] for d in (1, 2, 3)] == [41.0, 1.0, 4.0] and len(got) == 3 * 6


def test_standby_band_of_a_closed_venue(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)  # noqa: E731, a Monday
    series = spark.createDataFrame([("v", day(i), float(i % 7 * 10)) for i in range(28)], "venue string, date date, value double")
    scores = spark.createDataFrame([("v", day(i), float(i)) for i in range(28)], "venue string, date date, score double")
    closed = spark.createDataFrame([("v",)], "venue string")
    rows = forecast.standby_band(series, scores, closed).orderBy("date").collect()
    assert [r["date"] for r in rows] == [day(28 + i) for i in range(28)]
    assert (rows[0]["yhat"], rows[0]["lo"], rows[0]["hi"]) == (0.0, 0.0, 22.0)  # Mondays and Tuesdays: the greatest of eight scores
    assert (rows[3]["yhat"], rows[3]["lo"], rows[3]["hi"]) == (30.0, 4.0, 56.0)  # the rest: the nineteenth of twenty
