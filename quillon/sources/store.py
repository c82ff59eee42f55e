"""Tables that are kept: null-safe upserts, appends, state and reports. A version is written beside the one in use, then the pointer moves."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder once and read from there: plans that use it several times don't grow, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Parquet tables under a folder that all executors share. Each table's _current file names the folders in use, one in a line."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _parts(self, name: str) -> list[str]:
        fs, p = self._fs(self._pointer(name))
        if not fs.exists(p):
            return []
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return bool(self._parts(name))

    def read(self, name: str, schema=None) -> DataFrame:
        parts = self._parts(name)
        if not parts:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(f"{self.root}/{name}/{p}" for p in parts))

    def _put(self, name: str, text: str) -> None:
        """Replace the pointer: the new one is written beside the old one and takes its place by a rename."""
        fs, new = self._fs(f"{self._pointer(name)}-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._fs(self._pointer(name))[1], over)

    def _write(self, name: str, df: DataFrame, kept: list[str]) -> None:
        part = self.new_version()
        df.write.parquet(f"{self.root}/{name}/{part}")
        self._put(name, "\n".join([*kept, part]))

    @staticmethod
    def new_version() -> str:
        return f"v-{uuid.uuid4().hex}"

    def read_note(self, name: str) -> str:
        """What a parted table keeps in place of a list of folders; empty where there is nothing."""
        return " ".join(self._parts(name))

    def write_note(self, name: str, text: str) -> None:
        self._put(name, text)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def folders_of(self, path: str, column: str) -> list[str]:
        """The values of a column by which a folder is parted."""
        return sorted(n.split("=", 1)[1] for n in self._names(path) if n.startswith(f"{column}="))

    def versions(self, name: str) -> list[str]:
        return sorted(n for n in self._names(f"{self.root}/{name}") if n.startswith("v-"))

    def delete(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        fs.delete(p, True)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a new version, then move the pointer: readers see the old or the new one, never a part."""
        self._write(name, df, [])

    def append(self, name: str, df: DataFrame) -> None:
        """A further folder beside those there; what is held isn't written again. Columns by name and type."""
        kept = self._parts(name)
        if kept:
            held = self.read(name)
            df = df.select(*(F.col(c).cast(held.schema[c].dataType) if c in df.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns))
        self._write(name, df, kept)

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """Rows of df take the place of those with equal keys; null keys are equal to null."""
        if not self.exists(name):
            self.replace(name, df)
            return
        self.replace(name, merged(self.read(name), df, keys))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys are in new (null-safe), and new."""
    hit = new.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return old.join(hit, on, "left_anti").unionByName(new)


def read_bands(forecasts: DataFrame, bands: DataFrame, key: str | None = None) -> DataFrame:
    """Forecasts with their bands on venue, layer, key (null-safe), date and model; a key selects its node only."""
    f, b = forecasts.alias("f"), bands.alias("b")
    on = (F.col("f.venue") == F.col("b.venue")) & (F.col("f.layer") == F.col("b.layer")) & F.col("f.key").eqNullSafe(F.col("b.key")) & (F.col("f.target_date") == F.col("b.target_date")) & (F.col("f.model") == F.col("b.model"))
    out = f.join(b, on).select("f.*", "b.level", "b.lo", "b.hi")
    return out if key is None else out.where(F.col("key") == key)


def append_run(store: Store, items: DataFrame, run_at: str) -> None:
    """Briefing items of a run; a run without any leaves one marker row, so that it can be told from no run."""
    rows = items.withColumn("run_at", F.lit(run_at))
    if items.isEmpty():
        marker = store.spark.createDataFrame([("__none__", run_at)], "item_key string, run_at string")
        rows = rows.unionByName(marker, allowMissingColumns=True)
    store.append("briefing_runs", rows)


def checked_vectors(df: DataFrame, column: str, width: int) -> DataFrame:
    """df; reading a vector of another width fails the job."""
    ok = F.assert_true(F.size(column) == width, f"{column} must have {width} numbers")
    return df.withColumn(column, F.when(ok.isNull(), F.col(column)))


def write_with_manifest(df: DataFrame, path: str, manifest: DataFrame, *, partition_by: str | None = None) -> None:
    """Line items as Parquet, and the manifest's few rows as JSON beside them."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_manifest")


def markdown_report(title: str, df: DataFrame, most: int = 200) -> str:
    """A table of at most `most` rows as markdown."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def json_report(df: DataFrame, most: int = 200) -> str:
    return json.dumps([json.loads(r) for r in df.limit(most).toJSON().collect()])
