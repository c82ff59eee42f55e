"""Parted tables: what a change reads and writes."""

import datetime
import shutil

from pyspark.sql import functions as F

from quillon.sources.partitioned import PartedTable, append_selection, refresh_marked, write_change_points
from quillon.sources.store import Store

SCHEMA = "venue string, date date, units long"


def day(m, d):
    return datetime.date(2024, m, d)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    return store, PartedTable(store, "days", F.date_format("date", "yyyy-MM"))


def test_upsert_writes_touched_parts_only(spark, tmp_path):
    store, t = made(spark, tmp_path)
    first = [("a", day(1, 1), 1), ("a", day(2, 1), 2), (None, day(2, 1), 3), ("b", day(3, 1), 4), ("c", None, 5)]
    assert t.upsert(spark.createDataFrame(first, SCHEMA), ["venue", "date"]) == ["2024-01", "2024-02", "2024-03", "none"]
    before = {p: t.folders(p) for p in t.parts()}
    (tmp_path / "store/days" / before["2024-03"][0]).rename(tmp_path / "aside")  # were it read, the job would fail
    assert t.upsert(spark.createDataFrame([(None, day(2, 1), 30), ("d", day(4, 1), 6)], SCHEMA), ["venue", "date"]) == ["2024-02", "2024-04"]
    (tmp_path / "aside").rename(tmp_path / "store/days" / before["2024-03"][0])
    assert [p for p in before if t.folders(p) != before[p]] == ["2024-02"]
    want = [("a", day(1, 1), 1), ("a", day(2, 1), 2), (None, day(2, 1), 30), ("b", day(3, 1), 4), ("c", None, 5), ("d", day(4, 1), 6)]
    assert {tuple(r) for r in t.read().collect()} == set(want)
    assert rows(t.read(["2024-01"])) == want[:1] and t.read(["2030-01"]).count() == 0
    assert t.upsert(spark.createDataFrame([], SCHEMA), ["venue", "date"]) == []
    assert t.vacuum() >= 1 and t.read().count() == 6


def test_refresh_reads_marks_not_rows(spark, tmp_path):
    store, t = made(spark, tmp_path)
    load = lambda *r: refresh_marked(store, t, spark.createDataFrame(list(r), SCHEMA), "L1", "2024-05-01")
    a, b = [("a", day(1, 1), 1), ("a", day(1, 2), 2), ("b", day(1, 1), 3)], [("a", day(1, 2), 9), ("a", day(2, 3), 4), ("b", day(1, 1), 9), ("c", day(1, 1), 5)]
    assert load(*a) == 3
    held = tmp_path / "store/days"
    shutil.move(str(held / t.folders("2024-01")[0]), str(tmp_path / "aside"))  # rows held are not there, and not missed
    assert load(*b) == 2 and load(*b) == 0 and load() == 0
    shutil.move(str(tmp_path / "aside"), str(held / t.folders("2024-01")[0]))
    assert rows(t.read()) == sorted([*a, b[1], b[3]])
    marks = {r.venue: r.last_date for r in store.read("data_watermark").collect()}
    assert marks == {"a": day(2, 3), "b": day(1, 1), "c": day(1, 1)}


def test_sinks_of_change_points_and_selections(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    points = lambda sev: spark.createDataFrame([("a", "L1", None, day(1, 5), sev)], "venue string, layer string, key string, onset date, severity string")
    assert write_change_points(store, points("low")) == ["2024-01"] and write_change_points(store, points("high")) == ["2024-01"]
    held = PartedTable(store, "change_points", F.date_format("onset", "yyyy-MM")).read().collect()
    assert [(r.venue, r.key, r.severity) for r in held] == [("a", None, "high")]
    for k in (1, 2):
        append_selection(store, spark.createDataFrame([("a", "naive", 0.9)], "venue string, rung string, mase double"), f"2024-01-0{k}", F.col("mase") < 1)
    assert store.read("ladder_selection").where("adopted").count() == 2
