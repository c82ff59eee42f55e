"""The paged source against the tables that it pages over."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from quillon.sources import paged
from quillon.sources.views import table

COLUMNS = ["order_id", "location_id", "state", "created_at", "total_cents"]


class Flaky(paged.ParquetOrders):
    """Fails every second request, once."""

    def __init__(self, options):
        super().__init__(options)
        self.asked, self.failed = 0, set()

    def fetch(self, asked, cursor, limit):
        self.asked += 1
        if self.asked % 2 and cursor not in self.failed:
            self.failed.add(cursor)
            raise paged.Transient("try again")
        return super().fetch(asked, cursor, limit)


@pytest.fixture
def source(spark, sf_dir):
    paged.register(spark)
    return lambda **options: spark.read.format("paged_orders").options(path=f"{sf_dir}/orders.parquet", **options).load()


def plain(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CANCELED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 5).alias("location_id"), state.alias("state"),
        F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_all_rows_in_pages(spark, sf_dir, source):
    got = source(page_rows=37, slices=5)
    assert rows(got) == rows(plain(spark, sf_dir))
    assert got.rdd.getNumPartitions() == 5 and got.groupBy(F.spark_partition_id(), "page").count().agg(F.max("count")).first()[0] == 37
    assert not got.where("truncated").count()


def test_filters_reach_the_client(spark, sf_dir, source):
    since = datetime.datetime(1997, 3, 1)
    where = (F.col("created_at") >= since) & (F.col("created_at") < F.lit(datetime.datetime(1998, 1, 1)).cast("timestamp_ntz")) & F.col("location_id").isin(1, 3) & (F.col("state") == "COMPLETED") & (F.col("total_cents") % 2 == 0)
    got = source().where(where)
    assert rows(got) == rows(plain(spark, sf_dir).where(where))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Filter") <= plan.count("PushedFilters") + 2 and "location_id" in plan.split("PushedFilters")[-1]
    reader = paged.PagedReader({"path": f"{sf_dir}/orders.parquet", "slices": "3"})
    left = list(reader.pushFilters([paged.GreaterThan(("created_at",), since), paged.In(("location_id",), (1, 3)), paged.EqualTo(("location_id",), 3), paged.EqualTo(("order_id",), 5)]))
    assert [f.attribute for f in left] == [("order_id",)]
    assert {p.asked.locations for p in reader.partitions()} == {(3,)} and min(p.asked.since for p in reader.partitions()) == paged.micros(since) + 1


def test_a_failed_page_is_asked_again(spark, sf_dir, source):
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])
    spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    options = {"path": f"{sf_dir}/orders.parquet", "client": "test_paged:Flaky", "page_rows": "100", "wait_seconds": "0"}
    asked = paged.Asked(0, 2**50, None, None)
    once = [r[0] for r in paged._read(options, asked)]
    assert sorted(once) == sorted(r.order_id for r in plain(spark, sf_dir).collect()) and len(once) == len(set(once))


def test_page_limit_says_so(spark, sf_dir, source):
    got = source(page_rows=10, max_pages=2, slices=4)
    assert got.count() == 80 and got.where("truncated").agg(F.min("page"), F.count("*")).first() == (2, 40)


def test_stream_goes_on_from_its_offset(spark, sf_dir, tmp_path):
    paged.register(spark)
    cut = datetime.datetime(1998, 1, 1)
    held = table(spark, sf_dir, "orders")
    for k, part in enumerate((held.where(F.col("o_orderdate") < cut), held.where(F.col("o_orderdate") >= cut), None)):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "orders"))
        stream = spark.readStream.format("paged_orders").options(path=str(tmp_path / "orders"), slices=3).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
        want = plain(spark, sf_dir).where(F.col("created_at") < cut) if k == 0 else plain(spark, sf_dir)
        assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)


def test_no_rows(spark, sf_dir, tmp_path):
    paged.register(spark)
    table(spark, sf_dir, "orders").where("false").write.parquet(str(tmp_path / "orders"))
    assert spark.read.format("paged_orders").options(path=str(tmp_path / "orders")).load().collect() == []


def test_a_page_costs_what_it_holds(spark, sf_dir):
    """Every page turned all rows of its slice into Python values."""
    client = paged.ParquetOrders({"path": f"{sf_dir}/orders.parquet"})
    asked, cursor, got, began = paged.Asked(*client.span(), (1, 3), None), None, [], time.time()
    while True:
        page = client.fetch(asked, cursor, 2)
        got += page.rows
        cursor = page.cursor
        if cursor is None:
            break
    assert sorted(got) == rows(plain(spark, sf_dir).where("location_id in (1, 3)")) and got == sorted(got, key=lambda r: (r[3], r[0]))
    assert time.time() - began < 5
