"""The vector index against exact scans."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import vector_index as vi
from quillon.plans.retrieval import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, dim=8, groups=12, seed=0):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(groups, dim))
    return [(i, (centre[i % groups] + 0.3 * draw.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def plain(rows, queries, k):
    ids, v = np.array([r[0] for r in rows]), vi._unit(np.array([r[1] for r in rows], dtype=np.float64))
    out = []
    for q, w in queries:
        sim = np.round(vi._unit(np.array([w], dtype=np.float64)) @ v.T, 6)[0]
        best = sorted(((-s, int(i)) for s, i in zip(sim, ids, strict=True) if i != q))[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted((r["query"], r.id, r.similarity, r["rank"]) for r in df.collect())


def test_all_cells_are_exact_and_few_cells_reach_the_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vi, "QUERY_ROWS", 8)
    rows = clustered(600) + [(10_000 + i, clustered(1)[0][1]) for i in range(200)]  # a third of a cell are copies
    odd = [(20_000, None), (20_001, [0.0] * 8), (20_002, [1.0]), (20_003, [float("nan")] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    index = vi.VectorIndex.build(frame, str(tmp_path / "index"))
    assert sum(r["count"] for r in index.vectors().groupBy("cell").count().collect()) == len(rows)
    assert index.vectors().groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 100
    queries = [r for r in rows if r[0] % 20 == 0]
    asked = spark.createDataFrame(queries + odd, SCHEMA)
    want = plain(rows, queries, 5)
    assert found(index.search(asked, 5, probes=len(index.centre))) == want
    probes = index.probes_for(0.95)
    assert probes < len(index.centre)
    got = {x[:2] for x in found(index.search(asked, 5))}
    assert len(got & {x[:2] for x in want}) >= 0.9 * len(want)
    assert found(vi.exact(frame, queries[:3], 5)) == [x for x in want if x[0] in {q[0] for q in queries[:3]}]


def test_a_search_reads_the_probed_cells_only(spark, tmp_path):
    index = vi.VectorIndex.build(spark.createDataFrame(clustered(300), SCHEMA), str(tmp_path / "index"), cells=10)
    few = index.nearest(clustered(1)[0][1], 5, probes=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert {f.split("cell=")[1].split("/")[0] for f in index.vectors().where(F.col("cell").isin(1, 2)).inputFiles()} <= {str(i) for i in range(10)}
    assert [r.id for r in few.orderBy("rank").collect()][0] == 0


def test_an_upsert_writes_the_touched_cells_only(spark, tmp_path):
    rows = clustered(300)
    index = vi.VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), cells=10)
    files = lambda: {(d.split("cell=")[1], f) for d, _, fs in os.walk(tmp_path / "index/cells") for f in fs if f.endswith(".parquet")}
    before = files()
    moved, added = (5, rows[6][1]), (900, rows[7][1])
    cells = index.upsert(spark.createDataFrame([moved, added, (8, [0.0] * 8)], SCHEMA))
    assert 0 < len(cells) <= 6 and {c for c, _ in before ^ files()} <= {str(c) for c in cells} and before & files()
    held = {r.id: r.v for r in index.vectors().collect()}
    assert len(held) == 300 and held[5] == pytest.approx(rows[6][1]) and 900 in held and 8 not in held
    assert index.upsert(spark.createDataFrame([], SCHEMA)) == []
    now = [r for r in rows if r[0] not in (5, 8)] + [moved, added]
    assert found(index.search(spark.createDataFrame(now[:20], SCHEMA), 3, probes=10)) == plain(now, now[:20], 3)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = vi.VectorIndex.build(none, str(tmp_path / "index"), dim=8)
    assert index.search(spark.createDataFrame(clustered(2), SCHEMA), 3).collect() == [] and index.nearest([1.0] * 8, 3).collect() == []


def test_recall_of_the_query(spark, sf_dir):
    got = QUERIES["vector_index_recall"](spark, sf_dir).collect()
    assert got and sum(r.found for r in got) >= 0.9 * sum(r.neighbours for r in got)
