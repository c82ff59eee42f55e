"""Keyed state of streams against the batch rules: several micro-batches, disorder, and restarts."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions.limits import MICRO, Sightings, Throttle
from quillon.operators.refresh import rate_limited
from quillon.streaming import stateful

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user long, at timestamp, tag string"


def hits(n, seed=0):
    draw = random.Random(seed)
    at = sorted(draw.randrange(0, 6 * 3600) for _ in range(n))
    return [(draw.choice([1, 1, 2, 3]), START + datetime.timedelta(seconds=t), str(i)) for i, t in enumerate(at)]


def run(spark, stream, sink, check):
    query = stream.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    query.awaitTermination()


def plain(rows, make):
    out, held = {}, {}
    for user, at, tag in sorted(rows, key=lambda r: (r[1], r[2])):
        out[tag] = held.setdefault(user, make()).decide(int((at - START).total_seconds() * MICRO))
    return out


@pytest.mark.parametrize("which", ["throttled", "first_sightings"])
def test_batches_disorder_and_restart_like_batch(spark, tmp_path, which):
    stateful.use_keyed_state(spark)
    rows = hits(160)
    end = [(9, START + datetime.timedelta(days=9), "end")]  # moves the watermark past the rest
    lots = [rows[i : i + 40] for i in range(0, 160, 40)]
    lots[1][0], lots[2][0] = lots[2][0], lots[1][0]  # out of order within the lateness
    source = tmp_path / "in"
    for k, lot in enumerate([*lots, end]):
        spark.createDataFrame(lot, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.02)
        if k in (1, 4):  # the first run ends here; the second one goes on from its checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
            made = stateful.throttled(stream, "user", most=3, seconds=1800, late="4 hours") if which == "throttled" else stateful.first_sightings(stream, "user", hours=1, late="4 hours")
            run(spark, made, tmp_path / "out", tmp_path / "check")
    got = {r.tag: tuple(r)[3:] for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.tag != "end"}
    assert got == plain(rows, (lambda: Throttle(3, 1800)) if which == "throttled" else (lambda: Sightings(3600)))
    if which == "throttled":
        batch = rate_limited(spark.createDataFrame(rows, SCHEMA).select(F.col("user").alias("key"), "at", "tag"), most=3, seconds=1800)
        assert {r.tag: r.allowed for r in batch.collect()} == {k: v[0] for k, v in got.items()}


def test_at_once_in_order(spark, tmp_path):
    stateful.use_keyed_state(spark)
    rows = hits(80, 3)
    for k in range(0, 80, 40):
        spark.createDataFrame(rows[k : k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(spark, stateful.throttled(stream, "user", most=2, seconds=3600, wait=False), tmp_path / "out", tmp_path / "check")
    assert {r.tag: tuple(r)[3:] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == plain(rows, lambda: Throttle(2, 3600))


def test_rules():
    t = Throttle(2, 10)
    assert [t.decide(x * MICRO) for x in (0, 1, 2, 3, 8, 9, 10)] == [(True, 1, False), (True, 2, False), (False, 2, True), (False, 2, False), (False, 2, True), (False, 2, False), (True, 2, False)]
    again = Throttle(2, 10)
    again.recall(t.memory())
    assert again.decide(10 * MICRO + 1) == (False, 2, False)
    s = Sightings(5)
    assert [s.decide(x * MICRO)[0] for x in (0, 4, 5, 9, 10)] == [True, False, True, False, True]
