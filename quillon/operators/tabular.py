"""Filter, group, aggregate and sort over schemaless tables: rows are maps from header to text cell."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.cleaning import stripped_number

FILTERS = ("eq", "gt", "lt", "gte", "lte", "contains")
AGGREGATES = ("count", "sum", "avg", "min", "max")
DEFAULT_LIMIT, MAX_LIMIT, ROW_CAP = 100, 1000, 50_000


class TabularError(ValueError):
    """A query that the table can't answer; reason is "invalid-input" or "not-found"."""

    def __init__(self, reason: str, detail: str):
        super().__init__(f"{reason}: {detail}")
        self.reason = reason


def to_rows(df: DataFrame, doc_id: str, order: list[Column]) -> DataFrame:
    """(doc_id, row_index, data): a table's rows as text cells, in order, at most ROW_CAP (the form's own limit; `over_cap` tells whether there are more).

    Rows are numbered in one task only after the cap, which bounds it.
    """
    capped = df.orderBy(*order).limit(ROW_CAP)
    index = F.row_number().over(Window.orderBy(*order)) - 1
    cells = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))))
    return capped.select(F.lit(doc_id).alias("doc_id"), index.alias("row_index"), cells.alias("data"))


def over_cap(df: DataFrame) -> bool:
    """Whether a table has more rows than `to_rows` keeps; counts no further than that."""
    return df.limit(ROW_CAP + 1).count() > ROW_CAP


def infer_types(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, name, inferred): number or date where at least `share` of the cells that aren't blank are such, else string."""
    cells = rows.select("doc_id", F.explode("data").alias("name", "cell"))
    filled = F.trim(F.coalesce("cell", F.lit(""))) != ""
    number = filled & stripped_number(F.col("cell")).isNotNull()
    date = filled & F.coalesce(F.try_to_date(F.substring("cell", 1, 10), "yyyy-MM-dd"), F.try_to_date("cell", "dd/MM/yyyy")).isNotNull()
    votes = cells.groupBy("doc_id", "name").agg(F.count_if(filled).alias("n"), F.count_if(number).alias("numbers"), F.count_if(date).alias("dates"))
    enough = lambda c: (F.col("n") > 0) & (F.col(c) >= share * F.col("n"))
    return votes.select("doc_id", "name", F.when(enough("numbers"), "number").when(enough("dates"), "date").otherwise("string").alias("inferred"))


def resolve(asked: str, known: dict[str, str]) -> str:
    """The column that a name means, whatever its case, spaces and underscores."""
    fold = lambda s: re.sub(r"[\s_]+", " ", s.strip().lower())
    for name in known:
        if name == asked:
            return name
    for name in known:
        if fold(name) == fold(asked):
            return name
    raise TabularError("not-found", f"no column {asked!r}; there are {', '.join(sorted(known))}")


@dataclass
class Query:
    where: list[tuple[str, str, str]] = field(default_factory=list)
    group_by: str | None = None
    aggregate: tuple[str, str] | None = None
    sort: tuple[str, bool] | None = None
    limit: int = DEFAULT_LIMIT


def _cell(name: str) -> Column:
    return F.element_at("data", F.lit(name))


def _condition(name: str, op: str, value: str, kind: str) -> Column:
    if op not in FILTERS:
        raise TabularError("invalid-input", f"unknown filter {op!r}")
    cell = _cell(name)
    if op == "contains":
        return F.lower(cell).contains(value.lower())
    number = stripped_number(F.lit(value))
    left, right = (stripped_number(cell), number) if kind == "number" else (cell, F.lit(value))
    return {"eq": left == right, "gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[op]


def run(rows: DataFrame, types: dict[str, str], query: Query) -> tuple[DataFrame, int]:
    """The result, with one row more than the limit where more exist, and the limit. types: inferred kinds by column.

    Enumeration gives (row_index, data); grouping (key, value) or (key, n); aggregation alone (value).
    """
    limit = max(1, min(query.limit, MAX_LIMIT))
    kept = rows
    for name, op, value in query.where:
        name = resolve(name, types)
        kept = kept.where(_condition(name, op, value, types[name]))
    measure = F.count("*")
    if query.aggregate:
        how, of = query.aggregate
        if how not in AGGREGATES:
            raise TabularError("invalid-input", f"unknown aggregate {how!r}")
        if how != "count":
            of = resolve(of, types)
            if types[of] != "number":
                raise TabularError("invalid-input", f"{of!r} is not a column of numbers")
            measure = F.round(getattr(F, how)(stripped_number(_cell(of))), 6)
    if query.group_by:
        key = resolve(query.group_by, types)
        out = kept.groupBy(_cell(key).alias("key")).agg(measure.alias("value"), F.min("row_index").alias("first_row"))
        name, descending = query.sort or ("_aggregate", True)
        by = F.col("value") if name == "_aggregate" else F.col("key")
        return out.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), F.asc_nulls_last("key")).select("key", "value").limit(limit + 1), limit
    if query.aggregate:
        return kept.agg(measure.alias("value")), limit
    name, descending = query.sort or ("_row_index", False)
    if name == "_row_index":
        by = F.col("row_index")
    else:
        name = resolve(name, types)
        by = stripped_number(_cell(name)) if types[name] == "number" else _cell(name)
    return kept.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "row_index").select("row_index", "data").limit(limit + 1), limit


def widen(tables: list[DataFrame], first: int = 10) -> DataFrame | None:
    """The first of at most `first` tables' results that has a row; None if none has."""
    for t in tables[:first]:
        if not t.isEmpty():
            return t
    return None
