"""Lexical search over a positional inverted index, ranked by cover density.

The index holds a row for each term of each document: where the term stands, and how much its field weighs there. Rows lie in
folders by a hash of the term and, within them, sorted by term and document, so that a search reads the lists of its own
terms and no text. A document must hold all terms. Its score is the sum over all covers: shortest stretches that hold every
term. A cover counts the harmonic mean of the weights of the query terms in it, divided by one more than the number of other
words in it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.retrieval import tokens_of

#: Folders of the index, and the weights of fields of the first, second, third and last rank (fixed values).
FOLDERS = 64
WEIGHTS = (1.0, 0.4, 0.2, 0.1)

#: Tasks that share a folder, each with its own documents.
SPREAD = 8

_SCHEMA = "term string, doc bigint, places array<struct<pos:int,weight:double>>, folder int"


def folder_of(term: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def postings(docs: DataFrame, fields: list[str], *, id_col: str, weights: tuple[float, ...] = WEIGHTS, folders: int = FOLDERS) -> DataFrame:
    """(term, doc, places, folder): places (pos, weight) of every term in every document, in order.

    Fields follow each other in the order given, with one run of positions from 1; each has its weight. Terms are lower-cased
    runs of letters and digits; null fields are empty. A document's words are sorted and cut into terms within its row. There
    is one shuffle, of a row for each term of a document, by folder and a hash of the document, so that a frequent term's list
    is spread over tasks. Rows with one id have a row each for a term.
    """
    parts = [_weighed(F.col(f), w) for f, w in zip(fields, weights, strict=False)]
    said = F.transform(F.concat(*parts), lambda x, i: F.struct(x["term"].alias("term"), (i + 1).alias("pos"), x["weight"].alias("weight")))
    each = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.explode(_let(F.sort_array(said), _by_term)).alias("x"))
    rows = each.select("x.term", "doc", "x.places", folder_of(F.col("x.term"), folders).alias("folder"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "folder", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_term(said: Column) -> Column:
    """(term, places) of words (term, pos, weight) in order: a run of one term begins where the word before is another."""
    n = F.size(said)
    begins = F.filter(F.transform(said, lambda x, i: F.when((i == 0) | (F.get(said, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
    places = lambda run: F.transform(run, lambda x: F.struct(x["pos"].alias("pos"), x["weight"].alias("weight")))

    def cut(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), n)
        return F.transform(at, lambda i, k: F.struct(F.get(said, i)["term"].alias("term"), places(F.slice(said, i + 1, end(k) - i)).alias("places")))

    return _let(begins, cut)


def _weighed(field: Column, weight: float) -> Column:
    return F.transform(tokens_of(F.coalesce(field, F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))


class TextIndex:
    """Postings under a folder that all executors share. Ids are whole numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folders = json.loads(spark.read.text(f"{self.path}/about").first()[0])["folders"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, fields: list[str], *, id_col: str, weights: tuple[float, ...] = WEIGHTS, folders: int = FOLDERS) -> TextIndex:
        spark, path = docs.sparkSession, path.rstrip("/")
        found = postings(docs, fields, id_col=id_col, weights=weights, folders=folders)
        found.sortWithinPartitions("folder", "term", "doc").write.partitionBy("folder").parquet(f"{path}/postings")
        spark.createDataFrame([(json.dumps({"folders": folders}),)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path)

    def lists(self, terms: list[str]) -> DataFrame:
        """(term, doc, places) of some terms: only the folders of these are listed, and only row groups that may hold them are read."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(folder_of(F.col("term"), self.folders)).distinct().collect()
        held = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/postings")
        return held.where(F.col("folder").isin([r[0] for r in wanted]) & F.col("term").isin(terms)).select("term", "doc", "places")

    def search(self, query: str, *, limit: int | None = None) -> DataFrame:
        """(doc, score, covers) of the documents that hold every term of the query, or the first `limit` of them by score, then doc. A query without terms finds none.

        Lists of the other terms meet only those documents that the rarest term has, before anything is gathered for a document.
        """
        terms = sorted({r.t for r in self.spark.createDataFrame([(query,)], "q string").select(F.explode(tokens_of(F.col("q"))).alias("t")).collect()})
        none = self.spark.createDataFrame([], "doc bigint, score double, covers int")
        if not terms:
            return none
        held = self.lists(terms)
        counts = dict(held.groupBy("term").agg(F.count("*")).collect())  # a row for each term of the query
        if len(counts) < len(terms):
            return none
        rarest = min(terms, key=lambda t: (counts[t], t))
        if len(terms) > 1:
            held = held.join(held.where(F.col("term") == rarest).select("doc"), "doc", "left_semi")
        number = F.create_map(*(F.lit(x) for i, t in enumerate(terms) for x in (t, i)))
        entries = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), F.col("t").alias("t"), (1 / p["weight"]).alias("inv")))
        rows = held.withColumn("t", F.element_at(number, F.col("term"))).select("doc", "t", entries.alias("e"))
        met = rows.groupBy("doc").agg(F.collect_list("e").alias("e"), F.collect_set("t").alias("t")).where(F.size("t") == len(terms))
        found = met.select("doc", cover_density(F.array_sort(F.flatten("e")), len(terms)).alias("m")).select("doc", F.round("m.score", 9).alias("score"), "m.covers")
        order = [F.desc("score"), F.asc("doc")]
        if limit is not None:
            found = found.orderBy(*order).limit(limit)
        return found


def cover_density(entries: Column, n_terms: int) -> Column:
    """(score, covers) of a document's entries (pos, t, inv): query terms where they stand, by position; inv is one over the weight.

    One pass: of every term the last entry is held. Where all terms have been met, the earliest of these begins the shortest
    stretch that ends here; it is a cover unless an earlier end had the same beginning.
    """
    seen = lambda i, pos, inv: F.struct(i.cast("int").alias("i"), pos.cast("int").alias("pos"), inv.cast("double").alias("inv"))
    unseen = seen(F.lit(-1), F.lit(0), F.lit(0.0))
    start = F.struct(
        F.array(*(unseen for _ in range(n_terms))).alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("inv"), F.lit(-1).alias("first"),
        F.lit(0.0).alias("score"), F.lit(0).alias("covers"),
    )

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda one, j: F.when(j == x["t"], seen(s["n"], x["pos"], s["inv"])).otherwise(one))

        def with_first(held: Column) -> Column:
            a = held["a"]
            fresh = (a["i"] >= 0) & (a["i"] != s["first"])
            others = (x["pos"] - a["pos"]) - (s["n"] - a["i"])
            worth = (s["n"] - a["i"] + 1) / (s["inv"] + x["inv"] - a["inv"]) / (1 + others)
            return F.struct(
                held["last"].alias("last"), (s["n"] + 1).alias("n"), (s["inv"] + x["inv"]).alias("inv"), a["i"].alias("first"),
                (s["score"] + F.when(fresh, worth).otherwise(0.0)).alias("score"), (s["covers"] + fresh.cast("int")).alias("covers"),
            )

        return let(last, lambda held: let(F.struct(held.alias("last"), F.array_min(held).alias("a")), with_first))

    return F.aggregate(entries, start, step, lambda s: F.struct(s["score"].alias("score"), s["covers"].alias("covers")))
