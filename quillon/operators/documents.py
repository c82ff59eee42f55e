"""Rows from nested JSON documents: each kind of document is a table of paths and types, read through VARIANT.

A document is parsed once; what is malformed, missing or of another type is null, and never fails a job. Lists within a
document become rows of their own. Money is kept in whole minor units.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapper:
    """Columns by name: path and type. If items is given, that list's elements are rows, and `each` are paths within an element."""

    columns: dict[str, tuple[str, str]]
    items: str | None = None
    each: dict[str, tuple[str, str]] = field(default_factory=dict)


_ID, _PLACE, _AT = ("$.id", "bigint"), ("$.location_id", "bigint"), ("$.created_at", "timestamp_ntz")

#: The documents of the point-of-sale interface (fixed values).
MAPPERS: dict[str, Mapper] = {
    "order": Mapper({"order_id": _ID, "location_id": _PLACE, "state": ("$.state", "string"), "created_at": _AT, "total": ("$.total_money.amount", "bigint"), "currency": ("$.total_money.currency", "string")}),
    "line": Mapper(
        {"order_id": _ID, "state": ("$.state", "string")}, "$.line_items",
        {"line": ("$.uid", "int"), "variation_id": ("$.catalog_object_id", "bigint"), "quantity": ("$.quantity", "bigint"), "gross": ("$.gross_sales_money.amount", "bigint"), "modifier": ("$.modifiers[0].name", "string")},
    ),
    "payment": Mapper({"payment_id": _ID, "location_id": _PLACE, "status": ("$.status", "string"), "source_type": ("$.source_type", "string"), "amount": ("$.amount_money.amount", "bigint"), "tip": ("$.tip_money.amount", "bigint")}),
    "refund": Mapper({"refund_id": _ID, "payment_id": ("$.payment_id", "bigint"), "status": ("$.status", "string"), "amount": ("$.amount_money.amount", "bigint"), "reason": ("$.reason", "string")}),
    "shift": Mapper({"shift_id": _ID, "member_id": ("$.team_member_id", "bigint"), "start_at": ("$.start_at", "timestamp_ntz"), "end_at": ("$.end_at", "timestamp_ntz"), "job": ("$.wage.title", "string"), "rate": ("$.wage.hourly_rate.amount", "bigint")}),
    "invoice": Mapper({"invoice_id": _ID, "status": ("$.status", "string"), "due": ("$.payment_requests[0].computed_amount_money.amount", "bigint"), "paid": ("$.payment_requests[0].total_completed_amount_money.amount", "bigint"), "due_date": ("$.payment_requests[0].due_date", "date")}),
    "booking": Mapper(
        {"booking_id": _ID, "status": ("$.status", "string"), "start_at": ("$.start_at", "timestamp_ntz")}, "$.appointment_segments",
        {"minutes": ("$.duration_minutes", "int"), "member_id": ("$.team_member_id", "bigint")},
    ),
    "tool_call": Mapper({"message_id": _ID}, "$.calls", {"tool": ("$.name", "string"), "failed": ("$.error", "boolean")}),
}


def _read(of: str, columns: dict[str, tuple[str, str]]) -> list[Column]:
    return [F.try_variant_get(of, path, kind).alias(name) for name, (path, kind) in columns.items()]


def rows_of(docs: DataFrame, mapper: str | Mapper, column: str = "document") -> DataFrame:
    """The rows that a mapper finds in a column of JSON texts. A text that is no JSON gives a row of nulls, or none where a list is asked for."""
    m = MAPPERS[mapper] if isinstance(mapper, str) else mapper
    parsed = docs.select(F.try_parse_json(column).alias("_d"))
    if m.items is None:
        return parsed.select(*_read("_d", m.columns))
    each = parsed.select("_d", F.explode(F.try_variant_get("_d", m.items, "array<variant>")).alias("_e"))
    return each.select(*_read("_d", m.columns), *_read("_e", m.each))


def has_value(document: Column, path: str) -> Column:
    """Whether a document holds something other than JSON null at a path."""
    found = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def list_holds(document: Column, path: str, value: str) -> Column:
    """Whether the list of texts at a path holds a value; false where there is no such list."""
    return F.coalesce(F.array_contains(F.try_variant_get(F.try_parse_json(document), path, "array<string>"), value), F.lit(False))
