"""Decisions that depend on the rows before: each key's rows are streamed in order, and only a small state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flag_in_order(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable[..., tuple[Any, bool]], flag: str) -> DataFrame:
    """rows with a boolean column: step(state, *inputs) gives (state, flag) for each row of a key in order; the state begins as None.

    Rows are shuffled by key and sorted on disk where they don't fit in memory; no key's rows are gathered, so that one key
    may hold any share of them. Null keys are a key.
    """
    names = rows.columns
    keyed = rows.withColumn("_key", F.to_json(F.struct(*keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ["_key", *inputs]]
            out = []
            for key, *values in zip(*columns, strict=True):
                if key != at:
                    at, state = key, None
                state, ok = step(state, *values)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.bool_())], names=[*names, flag])

    schema = T.StructType([*rows.schema.fields, T.StructField(flag, T.BooleanType())])
    return keyed.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(run, schema)
