"""Kept tables that are written by parts: an upsert or append writes the parts that its rows belong to, and no others."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.store import Store, merged

#: The column by which rows are parted, in files only.
PART = "_part"


class PartedTable:
    """A table of a store, parted by an expression of its columns (a month, a range of keys).

    The table's state names for each part the folders that make it up, in one small file that is replaced as a whole; readers
    see the state before a change or after it. What no state names any more stays until `vacuum`.
    """

    def __init__(self, store: Store, name: str, by: Column):
        self.store, self.name, self.by = store, name, by

    def _state(self) -> dict[str, list[str]]:
        return json.loads(self.store.read_note(self.name) or "{}")

    def parts(self) -> list[str]:
        return sorted(self._state())

    def folders(self, part: str) -> list[str]:
        return self._state().get(part, [])

    def read(self, parts: list[str] | None = None, schema=None) -> DataFrame:
        """All rows, or those of some parts: other parts' folders are not listed."""
        state = self._state()
        held = [f for p, folders in sorted(state.items()) if parts is None or p in parts for f in folders]
        if held:
            return self.store.spark.read.parquet(*(f"{self.store.root}/{self.name}/{f}" for f in held))
        if schema is None and state:
            schema = self.read(sorted(state)[:1]).schema
        if schema is None:
            raise FileNotFoundError(self.name)
        return self.store.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by part under a new folder; returns the folder of each part. What is given is computed once."""
        version = self.store.new_version()
        root = f"{self.store.root}/{self.name}/{version}"
        rows.withColumn(PART, F.coalesce(self.by.cast("string"), F.lit("none"))).repartition(PART).write.partitionBy(PART).parquet(root)
        return {p: f"{version}/{PART}={p}" for p in self.store.folders_of(root, PART)}

    def upsert(self, rows: DataFrame, keys: list[str]) -> list[str]:
        """Rows take the place of those with equal keys (null-safe); returns the parts that were written.

        The keys must decide the part: by is an expression of key columns. Of the table, the touched parts alone are read.
        """
        staged = self._staged(rows)
        touched = sorted(staged)
        new = self._from(staged, rows)
        state = self._state()
        old = [p for p in touched if p in state]
        made = self._write(merged(self.read(old), new, keys)) if old else staged
        self.store.write_note(self.name, json.dumps(state | {p: [made[p]] for p in touched}))
        return touched

    def append(self, rows: DataFrame) -> tuple[list[str], DataFrame]:
        """Further folders for the parts that rows belong to; returns these parts, and the rows as written."""
        staged, state = self._staged(rows), self._state()
        self.store.write_note(self.name, json.dumps(state | {p: [*state.get(p, []), f] for p, f in staged.items()}))
        return sorted(staged), self._from(staged, rows)

    def _staged(self, rows: DataFrame) -> dict[str, str]:
        return self._write(rows)

    def _from(self, staged: dict[str, str], like: DataFrame) -> DataFrame:
        """The rows just written, read from their files."""
        if not staged:
            return self.store.spark.createDataFrame([], like.schema)
        return self.store.spark.read.schema(like.schema).parquet(*(f"{self.store.root}/{self.name}/{f}" for f in staged.values()))

    def vacuum(self) -> int:
        """Delete folders that the state no longer names; only when no reader is left that began before. Returns how many."""
        used = {f.split("/")[0] for folders in self._state().values() for f in folders}
        gone = [v for v in self.store.versions(self.name) if v not in used]
        for v in gone:
            self.store.delete(f"{self.name}/{v}")
        return len(gone)


def refresh_marked(store: Store, table: PartedTable, incoming: DataFrame, layer: str, at: str) -> int:
    """Append the rows later than their own venue's mark, then move the marks; returns how many. A second run adds none.

    Marks are read from the watermark table, a row for each venue and layer; rows held are never read. What is accepted is
    written first, and counted, with the new marks, from what was written.
    """
    spark = store.spark
    kind = "venue string, layer string, last_date date, updated_at timestamp"
    marks = store.read("data_watermark", kind).where(F.col("layer") == layer).select("venue", F.col("last_date").alias("_mark"))
    fresh = incoming.join(F.broadcast(marks), "venue", "left").where("_mark is null or date > _mark").drop("_mark")
    _, added = table.append(fresh.select(*incoming.columns))
    new = added.groupBy("venue").agg(F.max("date").alias("last_date"), F.count("*").alias("n")).collect()  # a row for each venue
    if new:
        rows = [(r.venue, layer, r.last_date) for r in new]
        moved = spark.createDataFrame(rows, "venue string, layer string, last_date date").withColumn("updated_at", F.lit(at).cast("timestamp"))
        store.upsert("data_watermark", moved, ["venue", "layer"])
    return sum(r.n for r in new)


def write_change_points(store: Store, points: DataFrame) -> list[str]:
    """Change-points by venue, layer, key and onset, parted by the onset's month."""
    return PartedTable(store, "change_points", F.date_format("onset", "yyyy-MM")).upsert(points, ["venue", "layer", "key", "onset"])


def append_selection(store: Store, chosen: DataFrame, at: str, adopted: Column) -> None:
    """One audit row for each venue of a refit: what was chosen, when, and whether it was adopted."""
    store.append("ladder_selection", chosen.withColumns({"selected_at": F.lit(at).cast("timestamp"), "adopted": adopted}))
