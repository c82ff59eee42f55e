"""Signals of one day and source are tied in the order of clusters: they stay together, however many there are."""

from pyspark.sql import functions as F

from quillon.operators.signals import briefing_items, clusters


def test_tied_signals_stay_in_one_cluster(spark):
    many = spark.range(20000).select(F.lit("A").alias("venue"), F.lit("stock").alias("source"), F.lit("2001-08-01").cast("date").alias("onset"), F.lit("down").alias("direction"), F.lit("high").alias("severity"))
    one = many.limit(1).withColumns({"source": F.lit("deviation"), "onset": F.lit("2001-07-08").cast("date")})
    found = briefing_items(clusters(many.unionByName(one).repartition(8)), "2001-08-02")
    assert {(r.source, r.n_evidence, tuple(r.caveats)) for r in found.collect()} == {("stock", 19999, ()), ("deviation", 0, ())}
