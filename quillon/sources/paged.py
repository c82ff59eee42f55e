"""A Spark data source over an interface that hands out rows page by page.

A client answers one question: the next page of a time window (and of some locations), after a cursor. The source cuts the
window into slices, one task each, and pages through every slice; filters on time, location and state reach the client.
A page counts when all of it has arrived: a failed request is asked again with the same cursor, so that nothing is repeated. A
slice that reaches the page limit says so in the column `truncated` of its last page. As a stream the source goes on from
the time up to which it has read.
"""

from __future__ import annotations

import datetime
import importlib
import time
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

#: Rows of a page, and how often a failed request is made again (fixed values).
PAGE_ROWS, ATTEMPTS = 500, 3

EPOCH, MICRO = datetime.datetime(1970, 1, 1), datetime.timedelta(microseconds=1)


def micros(at: datetime.datetime) -> int:
    return (at.replace(tzinfo=None) - EPOCH) // MICRO


class Transient(Exception):
    """A request that may succeed when it is made again."""


class Asked(NamedTuple):
    """A window of time in microseconds, the end excluded, and values that a row's location and state must have (None: any)."""

    since: int
    until: int
    locations: tuple[int, ...] | None
    states: tuple[str, ...] | None


class Page(NamedTuple):
    rows: list[tuple]
    cursor: Any  # None: no more


class PageClient(Protocol):
    """What a service offers. A client is made in every task from the source's options."""

    def __init__(self, options: dict[str, str]): ...

    def span(self) -> tuple[int, int] | None:
        """The first time of any row and the time after the last; None without rows."""

    def fetch(self, asked: Asked, cursor: Any, limit: int) -> Page:
        """The rows after the cursor (None: from the beginning) in order of time, at most limit."""


class ParquetOrders:
    """Orders in Parquet files at the option `path`, handed out like a service would: by time, then id. The cursor is the last row's."""

    def __init__(self, options: dict[str, str]):
        self.path, self.held = options["path"], None

    def _rows(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet")

    def span(self) -> tuple[int, int] | None:
        ends = [(pc.min_max(b.column(0)).as_py()) for b in self._rows().to_batches(columns=["o_orderdate"]) if b.num_rows]
        ends = [e for e in ends if e["min"] is not None]
        return (micros(min(e["min"] for e in ends)), micros(max(e["max"] for e in ends)) + 1) if ends else None

    def _load(self, asked: Asked) -> pa.Table:
        """The rows that answer one question, ordered: a slice is read once for all its pages, and of it only what is asked for is held."""
        if self.held is None or self.held[0] != asked:
            at = ds.field("o_orderdate")
            kept = (at >= pa.scalar(EPOCH + asked.since * MICRO, pa.timestamp("us"))) & (at < pa.scalar(EPOCH + asked.until * MICRO, pa.timestamp("us")))
            columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
            parts = [self._asked_for(pa.Table.from_batches([b]), asked) for b in self._rows().to_batches(columns=columns, filter=kept) if b.num_rows]
            rows = pa.concat_tables(parts) if parts else self._asked_for(self._rows().schema.empty_table().select(columns), asked)
            self.held = asked, rows.sort_by([("at", "ascending"), ("key", "ascending")]).combine_chunks()
        return self.held[1]

    @staticmethod
    def _asked_for(t: pa.Table, asked: Asked) -> pa.Table:
        location = pa.array(t["o_custkey"].to_numpy() % 5, pa.int64())
        status = t["o_orderstatus"]
        state = pc.if_else(pc.fill_null(pc.equal(status, "F"), False), "COMPLETED", pc.if_else(pc.fill_null(pc.equal(status, "O"), False), "OPEN", "CANCELED"))
        total = pa.array(np.rint(t["o_totalprice"].to_numpy() * 100).astype(np.int64))
        rows = pa.table({"key": t["o_orderkey"], "location": location, "state": state, "at": t["o_orderdate"], "total": total})
        for name, values in (("location", asked.locations), ("state", asked.states)):
            if values is not None:
                rows = rows.filter(pc.is_in(rows[name], pa.array(values, rows[name].type)))
        return rows

    @staticmethod
    def _after(rows: pa.Table, cursor: Any) -> int:
        """The place of the first row after the cursor, by bisection: a page costs what it holds, wherever it stands."""
        place = lambda i: (rows["at"][i].as_py(), rows["key"][i].as_py())
        return 0 if cursor is None else bisect_right(range(rows.num_rows), cursor, key=place)

    def fetch(self, asked: Asked, cursor: Any, limit: int) -> Page:
        rows = self._load(asked)
        first = self._after(rows, cursor)
        page = rows.slice(first, limit)
        found = list(zip(*(c.to_pylist() for c in page.columns), strict=True))
        return Page(found, (found[-1][3], found[-1][0]) if found and first + limit < rows.num_rows else None)


class Slice(InputPartition):
    def __init__(self, asked: Asked):
        super().__init__(asked)
        self.asked = asked


def _client(options: dict[str, str]) -> PageClient:
    module, _, name = options.get("client", f"{__name__}:ParquetOrders").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def _read(options: dict[str, str], asked: Asked) -> Iterator[tuple]:
    """All pages of a slice; a row is followed by the number of its page and whether pages were left out after it."""
    client, limit, most = _client(options), int(options.get("page_rows", PAGE_ROWS)), int(options.get("max_pages", 0))
    cursor, page = None, 0
    while True:
        for attempt in range(ATTEMPTS):
            try:
                got = client.fetch(asked, cursor, limit)
                break
            except Transient:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(float(options.get("wait_seconds", 0.1)) * 2**attempt)
        page += 1
        cut = bool(most) and page >= most and got.cursor is not None
        for row in got.rows:
            yield (*row, page, cut)
        cursor = got.cursor
        if cursor is None or cut:
            return


def _slices(since: int, until: int, n: int, locations, states) -> list[Slice]:
    n = max(1, min(n, until - since))
    edges = [since + (until - since) * i // n for i in range(n + 1)]
    return [Slice(Asked(a, b, locations, states)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.since: int | None = None
        self.until: int | None = None
        self.locations: tuple[int, ...] | None = None
        self.states: tuple[str, ...] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of time and equality of location and state; gives back the others, which Spark applies."""
        both = lambda old, new: tuple(new) if old is None else tuple(x for x in old if x in new)
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("created_at",):
                t = micros(f.value) + isinstance(f, GreaterThan)
                self.since = t if self.since is None else max(self.since, t)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("created_at",):
                t = micros(f.value) + isinstance(f, LessThanOrEqual)
                self.until = t if self.until is None else min(self.until, t)
            elif isinstance(f, (EqualTo, In)) and f.attribute in (("location_id",), ("state",)):
                values = (f.value,) if isinstance(f, EqualTo) else f.value
                if f.attribute == ("state",):
                    self.states = both(self.states, values)
                else:
                    self.locations = both(self.locations, values)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        span = _client(self.options).span()
        if span is None:
            return [Slice(Asked(0, 0, (), ()))]
        since, until = max(span[0], self.since or span[0]), min(span[1], self.until if self.until is not None else span[1])
        found = _slices(since, until, int(self.options.get("slices", 8)), self.locations, self.states) if until > since else []
        return found or [Slice(Asked(0, 0, (), ()))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(self.options, partition.asked)


class PagedStream(DataSourceStreamReader):
    """Offsets are times up to which all rows have been read. A row that arrives later with an earlier time is not seen."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": int(self.options.get("since", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        span = _client(self.options).span()
        return {"until": max(span[1] if span else 0, int(self.options.get("since", 0)))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        span = _client(self.options).span()
        since = max(start["until"], span[0]) if span else start["until"]
        return _slices(since, end["until"], int(self.options.get("slices", 8)), None, None) if end["until"] > since else []

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(self.options, partition.asked)


class PagedOrders(DataSource):
    """Options: client (module:class, else ParquetOrders) and what it needs, slices, page_rows, max_pages (of a slice; 0: all), wait_seconds."""

    @classmethod
    def name(cls) -> str:
        return "paged_orders"

    def schema(self) -> str:
        return "order_id bigint, location_id bigint, state string, created_at timestamp_ntz, total_cents bigint, page int, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("paged_orders")` known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedOrders)
