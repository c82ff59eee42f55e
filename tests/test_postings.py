"""Positional postings and cover density against plain versions."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators.postings import TextIndex, cover_density, postings

WORD = re.compile(r"[^\W_]+")


def plain_score(fields, terms, weights=(1.0, 0.4, 0.2, 0.1)):
    """Every stretch between two query terms is tried; covers are those that hold all terms and no shorter one that does."""
    said = [(w, x) for text, x in zip(fields, weights, strict=False) for w in WORD.findall((text or "").lower())]
    at = [i for i, (w, _) in enumerate(said) if w in terms]
    holds = lambda a, b: {said[i][0] for i in range(a, b + 1)} >= terms
    spans = [(a, b) for a, b in itertools.combinations_with_replacement(at, 2) if holds(a, b)]
    covers = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    score = 0.0
    for a, b in covers:
        inside = [said[i][1] for i in at if a <= i <= b]
        score += len(inside) / sum(1 / w for w in inside) / (1 + (b - a + 1) - len(inside))
    return (round(score, 9), len(covers)) if covers else None


DOCS = [
    (1, "Stock count", "count the kegs", "The kegs of stock are counted: stock, kegs, count."), (2, None, None, "count kegs"), (3, "kegs", "", "nothing else"),
    (4, "Count", None, "a b c d kegs a b count a kegs kegs count"), (5, "", "", ""), (6, "count kegs", "count kegs", "count count kegs kegs"),
    (7, "KEGS-COUNT", "été 9pm", "x " * 3000 + "kegs " + "y " * 3000 + "count"),
]
SCHEMA = "id long, title string, summary string, text string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return TextIndex.build(spark.createDataFrame(DOCS, SCHEMA), str(tmp_path_factory.mktemp("postings")), ["title", "summary", "text"], id_col="id", folders=8)


@pytest.mark.parametrize("query", ["count kegs", "Kegs", "kegs, COUNT stock", "count count", "été 9pm"])
def test_like_plain(index, query):
    terms = set(WORD.findall(query.lower()))
    want = {i: s for i, *fields in DOCS if (s := plain_score(fields, terms))}
    got = {r.doc: (r.score, r.covers) for r in index.search(query).collect()}
    assert got == want


def test_no_terms_and_unknown_terms(index):
    assert index.search("").collect() == index.search(" ?! ").collect() == index.search("kegs unheardof").collect() == []
    assert [r.doc for r in index.search("count kegs", limit=2).collect()] == [6, 7]


def test_lists_are_read_by_term(index):
    lists = index.lists(["kegs", "count"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(term" in plan
    places = {(r.term, r.doc): [p.pos for p in r.places] for r in lists.collect()}
    assert places["kegs", 4] == [6, 11, 12] and places["count", 4] == [1, 9, 13]


def test_a_frequent_term_is_dealt_over_tasks(spark):
    docs = spark.range(4000).select(F.col("id"), F.lit("the").alias("title"))
    spread = postings(docs, ["title"], id_col="id").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 4000


def test_density_of_one_entry(spark):
    rows = spark.createDataFrame([([(1, 0, 2.5)],), ([],)], "e array<struct<pos:int,t:int,inv:double>>")
    assert [(r.m.score, r.m.covers) for r in rows.select(cover_density(F.col("e"), 1).alias("m")).collect()] == [(0.4, 1), (0.0, 0)]


def test_words_are_cut_into_terms_before_the_shuffle(spark):
    """One row for each term of a document meets the shuffle, by keys that need no sample of the words."""
    docs = spark.createDataFrame(DOCS, SCHEMA)
    found = postings(docs, ["title", "summary", "text"], id_col="id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Aggregate" not in plan and "hashpartitioning(folder" in plan
    want = {(w, i) for i, *fields in DOCS for text in fields for w in WORD.findall((text or "").lower())}
    rows = found.collect()
    assert {(r.term, r.doc) for r in rows} == want and len(rows) == len(want)
    assert all([p.pos for p in r.places] == sorted(p.pos for p in r.places) for r in rows)
