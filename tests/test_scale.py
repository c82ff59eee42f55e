"""Plans and memory that must not grow with the tables."""

import pyarrow as pa

from quillon.operators import features, forecast, retrieval
from quillon.operators.vector_index import PIECE_ROWS, _sliced
from quillon.plans.layers import l3_daily, series_of
from quillon.plans.signals import QUERIES
from quillon.sources.store import kept


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_orders_and_parts_are_not_broadcast(spark, sf_dir):
    """Their files may be small while their rows, which the driver would hold, are millions."""
    assert plan(l3_daily(spark, sf_dir)).count("SortMergeJoin") == 3


def test_lines_are_joined_once_for_the_nodes(spark, sf_dir):
    assert "lineitem" not in plan(QUERIES["node_quantiles"](spark, sf_dir))
    assert "lineitem" not in plan(QUERIES["node_coverage"](spark, sf_dir))


def test_lines_are_joined_once_for_the_folds(spark, sf_dir):
    joined = plan(features.rolling_origin(series_of(spark, sf_dir)))
    assert joined.count("lineitem.parquet") == 1 and joined.count("SortMergeJoin") == 3


def test_pooled_trees_have_as_many_tasks_as_their_rows_need(spark, sf_dir, monkeypatch):
    """Not as many as a shuffle has partitions, which grow with the tables: trees are hundreds of jobs."""
    from pyspark.ml.regression import GBTRegressor

    folds, seen, fit = kept(features.rolling_origin(series_of(spark, sf_dir)).where("fold = 0"), "folds"), [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    of = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(of)
    spark.conf.set(of, "32")
    try:
        wide = {tuple(r) for r in forecast.boosted_trees(folds, trees=2).collect()}
        spark.conf.set(of, usual)
        monkeypatch.setattr(forecast, "PIECE", folds.where("role = 'train'").count() // 3 + 1)
        cut = {tuple(r) for r in forecast.boosted_trees(folds, trees=2).collect()}
    finally:
        spark.conf.set(of, usual)
    assert seen == [1, 3] and len(wide) == folds.where("role = 'test'").count()
    near = lambda rows: sorted((r[0], r[2], round(r[4], 3)) for r in rows)
    assert near(wide) == near(cut)


def test_vectors_are_handled_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["id"])
    pieces = list(_sliced(iter([batch, batch.slice(0, 0)]), PIECE_ROWS))
    assert [p.num_rows for p in pieces] == [1024, 1024, 452] and [x for p in pieces for x in p.column(0).to_pylist()] == list(range(2500))


def test_near_pending_over_more_rows_than_are_compared_at_once(spark):
    """The best of all pieces counts, and the least id among equals that lie in different pieces."""
    assert retrieval.COMPARED < 600
    rows = [(i, 1, [1.0, 0.0] if i in (7, 1500) else [float(i % 5), 5.0]) for i in range(2000)]
    held = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").coalesce(1)
    new = spark.createDataFrame([(5000, 1, [2.0, 0.0])], held.schema)
    assert [tuple(r) for r in retrieval.near_pending(new, held).collect()] == [(5000, 7, 1.0, True)]


def test_sections_are_cut_text_by_text(spark):
    docs = spark.createDataFrame([(i, "# A\nx\n# B\n" + "y" * 60_000) if i % 7 else (i, None) for i in range(60)], "doc_id long, text string").coalesce(1)
    found = retrieval.heading_sections(docs)
    assert "MapInArrow" in plan(found)
    assert found.count() == 2 * 51 and found.where("section = 1 and title = 'B' and truncated and length(text) = 60000").count() == 51
