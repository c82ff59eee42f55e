"""What the operators of this subpackage share: tables, shared scratch storage and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python at once; texts can be long, so batches are small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: a batch holds at most BATCH_ROWS rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder; on a cluster, whose machines share none, that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths made within the innermost `workspace`, if any.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes the scratch tables made within it when it ends, except those named by a call of what it yields.

    Those pass to the workspace around it; without one they stay, for the result is read from them.
    """
    made: list[str] = []
    kept: set[str] = set()
    _OPEN.append(made)
    try:
        yield lambda *tables: kept.update(t.scratch_path for t in tables)
    finally:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(p for p in made if p in kept)
        discard(spark, *(p for p in made if p not in kept))


def materialise(df: DataFrame, label: str, compression: str = "zstd", *, rows: int | None = None, rows_per_file: int = 250_000) -> DataFrame:
    """Write df to the shared scratch folder and read it again: lineage is cut, and a lost executor costs no recomputation.

    rows: a bound of its rows, where known; a small table is then written to few files, however many shuffle partitions there are.
    """
    path = scratch(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_per_file)))
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # what `workspace` keeps it by
    return out


def hashed_share(hash_column: Column, wanted: int, of: int) -> Column:
    """Keeps the rows with the least hashes: about one and a half times `wanted` of `of` rows, or all, so that an exact top of `wanted` has few to sort."""
    share = min(1.0, (1.5 * wanted + 64) / max(of, 1))
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(hash_column, 32) < int(share * (1 << 32))
