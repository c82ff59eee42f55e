"""An index for nearest neighbours by cosine: vectors lie in cells by their nearest centroid, and a search reads few cells.

Centroids are fitted to a bounded sample; every vector is indexed. A cell's vectors are written to a folder of its own
(`cell=<n>`), so that a search for one vector reads only the folders of the cells it probes. Large cells are cut into blocks,
so that one cell, however many copies it holds, is spread over tasks. How many cells must be probed for a wanted recall is
measured when the index is built: the nearest neighbours of a sample of vectors are found exactly, over all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the samples that fit centroids and measure recall, of the number of cells, and rows of a block.
FIT_ROWS, MEASURE_ROWS, MOST_CELLS, BLOCK_ROWS = 65_536, 256, 2_048, 32_768

#: Query vectors that meet a block at once.
QUERY_ROWS = 1_024

#: Vectors that a task handles at once, rows of (query, cell) that it makes at once, and queries that are ranked at once.
PIECE_ROWS, PROBED_ROWS, RANKED_ROWS = 1_024, 16_384, 64

#: Neighbours for which recall is measured.
MEASURED_K = 10


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


def usable(vec: Column, dim: int) -> Column:
    """Vectors that have a direction: of the right width, every number finite, not all 0. Others are in no index and are never found."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) == dim) & ~F.exists(vec, odd) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _few(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows: those with the least hashes of their id; few more than these are sorted."""
    n, h = rows.count(), F.xxhash64("id")
    share = min(1.0, (1.5 * most + 64) / max(n, 1))
    near = rows if share >= 1 else rows.where(F.shiftrightunsigned(h, 32) < int(share * (1 << 32)))
    return near.orderBy(F.shiftrightunsigned(h, 32), "id").limit(most)


def fit_centroids(sample: np.ndarray, cells: int, *, turns: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of about `cells` groups by k-means on the sphere; equal vectors of the sample count once. A cell that loses all its vectors takes the one farthest from its centroid."""
    rows = np.unique(_unit(sample), axis=0)
    cells = min(cells, len(rows))
    centre = rows[np.random.default_rng(seed).choice(len(rows), cells, replace=False)].copy()
    for _ in range(turns):
        near = np.concatenate([(part @ centre.T).argmax(axis=1) for part in np.array_split(rows, max(1, len(rows) * cells >> 22))])
        total = np.zeros_like(centre)
        np.add.at(total, near, rows)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        if len(empty):
            total[empty] = rows[np.argsort((rows * centre[near]).sum(axis=1), kind="stable")[: len(empty)]]
        moved = _unit(total)
        if np.allclose(moved, centre, atol=1e-6):
            break
        centre = moved
    return centre


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so that what is made of a piece stays small."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _cells_of(vectors: np.ndarray, centre: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest cells of each unit vector, nearest first; of equally near ones the lesser number."""
    return np.argsort(-np.round(vectors @ centre.T, 12), axis=1, kind="stable")[:, :most]


def _top(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest similarities and their ids; ties to the lesser id. ids must ascend."""
    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sim, order, axis=1), ids[order]


def exact(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, similarity, rank): the k nearest vectors to each of a bounded list of queries, by a scan of all vectors.

    A task returns at most k rows for each query. A query's own row (of the same id) isn't its neighbour.
    """
    spark = vectors.sparkSession
    if not queries:
        return spark.createDataFrame([], "query long, id long, similarity double, rank int")
    names, wanted = np.array([q[0] for q in queries], dtype=np.int64), _unit(np.array([q[1] for q in queries], dtype=np.float64))
    dim = wanted.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for batch in _sliced(batches, PIECE_ROWS):
            if batch.num_rows:
                ids, rows = np.asarray(batch.column(0)), _unit(_matrix(batch.column(1), dim))
                sim = np.round(wanted @ rows.T, 6)
                sim[names[:, None] == ids[None, :]] = -np.inf
                sim, of = np.hstack([best, sim]), np.hstack([who, np.broadcast_to(ids, sim.shape)])
                order = np.lexsort((of, -sim), axis=1)[:, :k]
                best, who = np.take_along_axis(sim, order, axis=1), np.take_along_axis(of, order, axis=1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(who[q, j]), pa.array(best[q, j])], names=["query", "id", "similarity"])

    lean = vectors.where(usable(F.col(vec_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return _ranked(lean.mapInArrow(scan, "query long, id long, similarity double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class VectorIndex:
    """Vectors by cells under a folder that all executors share. Ids are whole numbers, each of one vector."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.dim, self.needed = about["dim"], np.array(about["needed"])
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        self.centre = np.array([r.centroid for r in rows], dtype=np.float64).reshape(-1, self.dim)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> VectorIndex:
        """Index all usable vectors. cells: the square root of their number, MOST_CELLS at most, unless given. An empty table makes an index that finds nothing."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        if dim is None:
            first = vectors.where(F.size(vec_col) > 0).select(F.size(vec_col)).first()
            dim = first[0] if first else 1
        lean = vectors.where(usable(F.col(vec_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
        n = lean.count()
        sample = np.array([r.v for r in _few(lean, FIT_ROWS).select("v").collect()], dtype=np.float64).reshape(-1, dim)
        centre = fit_centroids(sample, cells or min(MOST_CELLS, max(1, round(n**0.5)))) if n else np.zeros((0, dim))
        kind = "cell int, centroid array<double>"
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], kind).coalesce(1).write.parquet(f"{path}/centroids")
        _write_cells(_assigned(lean, centre, dim), f"{path}/cells", "overwrite")
        needed = _probes_needed(spark, path, lean, centre, dim) if n else []
        spark.createDataFrame([(json.dumps({"dim": dim, "needed": needed}),)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        """(id, v, block, cell): all indexed vectors; a filter on cell reads only the folders of these cells."""
        schema = "id long, v array<float>, block int, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells") if len(self.centre) else self.spark.createDataFrame([], schema)

    def probes_for(self, recall: float) -> int:
        """The least number of cells whose probing found this share of all neighbours of the measured vectors."""
        if not len(self.needed):
            return max(1, len(self.centre))
        return int(np.sort(self.needed)[min(len(self.needed) - 1, max(0, int(np.ceil(recall * len(self.needed))) - 1))])

    def nearest(self, query: list[float], k: int, *, probes: int | None = None, recall: float = 0.95) -> DataFrame:
        """(id, similarity, rank) of the k indexed vectors most like one, among the cells probed; their similarity is exact."""
        wanted = _unit(np.array([query], dtype=np.float64))
        cells = _cells_of(wanted, self.centre, probes or self.probes_for(recall))[0].tolist() if len(self.centre) else []
        held = self.vectors().where(F.col("cell").isin(cells)) if cells else self.vectors()
        return exact(held, [(-1, query)], k, id_col="id", vec_col="v").select("id", "similarity", "rank")

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query, id, similarity, rank): the k nearest of the probed cells' vectors, for every usable row of queries.

        A query goes to the blocks of its cells, QUERY_ROWS at most together; where more queries probe one cell, its blocks are
        copied for each further lot. Each meeting of a block and a lot is a task's group of bounded size, and returns k rows for a
        query. A query's own row (of the same id) isn't its neighbour. Queries with the same id share one list.
        """
        dim, centre, most = self.dim, self.centre, probes or self.probes_for(recall)
        lean = queries.where(usable(F.col(vec_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).cast("array<float>").alias("w"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches, max(1, PROBED_ROWS // max(1, most))):  # a query is copied for each cell it probes
                found = _cells_of(_unit(_matrix(batch.column(1), dim)), centre, most)
                rows = np.repeat(np.arange(batch.num_rows), found.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(found.ravel().astype(np.int32))], names=["q", "w", "cell"])

        asked = lean.mapInArrow(probe, "q long, w array<float>, cell int")
        # a row for each cell: how many blocks it has, and how many lots of queries probe it
        blocks = self.vectors().groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
        lots = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("lots"))
        plan = F.broadcast(blocks.join(lots, "cell"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = asked.join(plan, "cell").withColumn("lot", F.pmod(F.xxhash64("q"), F.col("lots")).cast("int"))
        left = left.select("q", "w", "cell", "lot", F.explode(upto("blocks")).alias("block"))
        right = self.vectors().join(plan, "cell").select("id", "v", "cell", "block", F.explode(upto("lots")).alias("lot"))
        keys = ["cell", "block", "lot"]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            out = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
            if not a.num_rows or not b.num_rows:
                return out.empty_table()
            b = b.sort_by("id")
            names, ids = np.asarray(a["q"].combine_chunks()), np.asarray(b["id"].combine_chunks())
            held = _unit(_matrix(b["v"].combine_chunks(), dim))
            wanted = _unit(_matrix(a["w"].combine_chunks(), dim))
            got = []
            for at in range(0, len(names), RANKED_ROWS):
                sim = np.round(wanted[at : at + RANKED_ROWS] @ held.T, 6)
                sim[names[at : at + RANKED_ROWS, None] == ids[None, :]] = -np.inf
                best, who = _top(sim, ids, k)
                i, j = np.nonzero(np.isfinite(best))
                got.append((names[at + i], who[i, j], best[i, j]))
            return pa.table([np.concatenate(x) for x in zip(*got, strict=True)], schema=out)

        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, id long, similarity double")
        return _ranked(met, k)

    def upsert(self, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> list[int]:
        """Put vectors in the place of those with the same ids; returns the cells written again. Centroids and the measured recall stay.

        Only the cells that hold an id of these, or get one, are read in full and written; of vectors with one id the least counts.
        A vector without a direction removes its id.
        """
        ok = usable(F.col(vec_col), self.dim)
        given = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(ok, F.col(vec_col).cast("array<float>")).alias("v"))
        new = given.groupBy("id").agg(F.min("v").alias("v"))
        dealt = _assigned(new.where("v is not null"), self.centre, self.dim)
        old = self.vectors().join(new.select("id"), "id", "left_semi").select("cell")
        cells = sorted(r.cell for r in dealt.select("cell").unionByName(old).distinct().collect())  # at most MOST_CELLS numbers
        if not cells:
            return []
        kept = self.vectors().where(F.col("cell").isin(cells)).join(new.select("id"), "id", "left_anti").select("id", "v", "cell")
        staged = f"{self.path}/staged"
        _write_cells(kept.unionByName(dealt), staged, "overwrite")
        # the cells were read from where they are now written, so they are written beside first
        left = self.spark.read.schema("id long, v array<float>, block int, cell int").parquet(staged)
        full = {r.cell for r in left.select("cell").distinct().collect()}
        left.repartition(max(1, len(full)), "cell", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/cells")
        for cell in set(cells) - full:  # cells that lost their last vector
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cells/cell={cell}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.spark.catalog.refreshByPath(f"{self.path}/cells")
        return cells


def _assigned(lean: DataFrame, centre: np.ndarray, dim: int) -> DataFrame:
    """(id, v) with the nearest cell. Nothing is shuffled."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, PIECE_ROWS):
            cell = _cells_of(_unit(_matrix(batch.column(1), dim)), centre, 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return lean.mapInArrow(assign, "id long, v array<float>, cell int")


def _write_cells(rows: DataFrame, path: str, mode: str) -> None:
    """Write (id, v, cell) by cell; a cell of more than BLOCK_ROWS is cut into blocks, and a block is one file."""
    blocks = rows.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt.select("id", "v", "block", "cell").repartition("cell", "block").write.mode(mode).partitionBy("cell").parquet(path)


def _probes_needed(spark: SparkSession, path: str, lean: DataFrame, centre: np.ndarray, dim: int) -> list[int]:
    """For each true neighbour of each measured vector the place of its cell in the order in which the vector's cells are probed."""
    sample = [(r.id, r.v) for r in _few(lean, MEASURE_ROWS).collect()]
    ids = {q: i for i, (q, _) in enumerate(sample)}
    order = _cells_of(_unit(np.array([v for _, v in sample], dtype=np.float64)), centre, len(centre))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(1, len(centre) + 1), order.shape), axis=1)
    cells = spark.read.schema(T.StructType([T.StructField("id", T.LongType()), T.StructField("cell", T.IntegerType())])).parquet(f"{path}/cells")
    true = F.broadcast(exact(lean, sample, MEASURED_K, id_col="id", vec_col="v"))  # MEASURED_K rows for each measured vector
    return [int(place[ids[r["query"]], r.cell]) for r in cells.join(true, "id").select("query", "cell").collect()]
