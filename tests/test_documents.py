"""Mappers of nested JSON: whole, partial and malformed documents."""

import datetime
import json

from pyspark.sql import functions as F

from quillon.operators import documents as d


def rows(spark, mapper, *docs):
    frame = spark.createDataFrame([(x if x is None or isinstance(x, str) else json.dumps(x),) for x in docs], "document string")
    return [tuple(r) for r in d.rows_of(frame, mapper).collect()]


def test_flat_documents(spark):
    whole = {"id": 7, "location_id": 2, "state": "OPEN", "created_at": "2024-05-01 10:00:00", "total_money": {"amount": 1250, "currency": "GBP"}, "more": [1]}
    none = (None,) * 6
    got = rows(spark, "order", whole, {"id": "7", "total_money": {"amount": "much"}}, {"id": {"x": 1}, "total_money": 5}, "{broken", None, "", "[]")
    assert got == [(7, 2, "OPEN", datetime.datetime(2024, 5, 1, 10), 1250, "GBP"), (7, *none[1:]), none, none, none, none, none]


def test_lists_become_rows(spark):
    lines = [{"uid": 1, "catalog_object_id": 9, "quantity": "3", "gross_sales_money": {"amount": 5}, "modifiers": [{"name": "ice"}]}, {"uid": 2, "modifiers": []}, None]
    got = rows(spark, "line", {"id": 1, "state": "OPEN", "line_items": lines}, {"id": 2, "line_items": []}, {"id": 3}, {"id": 4, "line_items": "none"}, "broken", None)
    assert got == [(1, "OPEN", 1, 9, 3, 5, "ice"), (1, "OPEN", 2, None, None, None, None), (1, "OPEN", None, None, None, None, None)]


def test_every_mapper_reads_an_empty_document(spark):
    for name, m in d.MAPPERS.items():
        assert rows(spark, name, {}) == ([] if m.items else [(None,) * len(m.columns)])


def test_predicates(spark):
    docs = [('{"a": {"b": 1}}',), ('{"a": {"b": null}}',), ("{}",), ("x",), (None,), ('{"a": {"b": ["u", "v"]}}',)]
    got = spark.createDataFrame(docs, "j string").select(d.has_value(F.col("j"), "$.a.b"), d.list_holds(F.col("j"), "$.a.b", "v")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False), (False, False), (True, True)]
