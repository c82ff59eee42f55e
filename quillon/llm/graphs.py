"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, workspace

#: A key with more than one in so many of all rows is hot. There are fewer such keys than this, so they can be broadcast.
HOT_NODES = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined to groups by key. groups has one row a key and in n how many rows have it; total bounds the rows.

    Hot keys' groups are broadcast, so that a shuffle never brings more than total / HOT_NODES rows of one key into a task.
    """
    most = max(total // HOT_NODES, 1)
    names = [c for c in groups.columns if c not in (key, n)]
    hot = groups.where(F.col(n) > most).select(key, F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(groups.where(F.col(n) <= most).select(key, *names), key)
    return marked.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in names)).unionByName(cold.select(*rows.columns, *names))


def with_groups(rows: DataFrame, key: str, total: int, **aggregates: Column) -> DataFrame:
    """rows with aggregates over all rows of the same key; partial aggregation and join_groups keep hot keys apart."""
    groups = rows.groupBy(key).agg(F.count("*").alias("_n"), *(c.alias(name) for name, c in aggregates.items()))
    return join_groups(rows, groups, key, total, "_n")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that can be reached.

    Each step joins every node to the least of its neighbours. A step's links are written to the shared folder, and those
    before them deleted; it ends when a turn changes nothing.
    """
    with workspace(edges.sparkSession) as keep:
        links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        digest = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        state = links.agg(*digest).first()
        while True:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # large star: greater neighbours move to the least one, the node itself included
            large = with_groups(both, "u", 2 * state[0], m=F.min("v")).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            # small star: the lesser neighbours and the node itself move to the least one
            small = with_groups(large, "u", state[0], m=F.min("v")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            links = materialise(small, "links", rows=2 * state[0])
            now = links.agg(*digest).first()
            if now == state:
                break
            state = now
        keep(links)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
