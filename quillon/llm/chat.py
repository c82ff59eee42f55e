"""Chat formatting: cumulative snapshots are collapsed to maximal conversations, which are then rendered.

Chat logs often hold a conversation once for every turn, each time one turn longer. Every turn gets a hash of all turns so
far; a conversation whose last hash is met inside a longer one is a snapshot and goes. Of equal conversations the one with
the least id stays. Prefix hashes are computed by blocks: rows are dealt by range, hashed within a block, and the blocks'
totals are carried on, so that a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table

#: Turns that are rendered into one row.
SEGMENT_TURNS = 256


def _content(role: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(role, F.lit("")), role.isNull(), F.coalesce(text, F.lit("")), text.isNull())


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, i, p, q, last): a and b are hashes of a turn, i its place from 1, p and q hashes of all turns up to it."""
    spark = turns.sparkSession
    lean = turns.select("conv_id", "turn", _content(F.col("role"), F.col("text"), 1).alias("a"), _content(F.col("role"), F.col("text"), 2).alias("b")).distinct()
    order = [F.col("turn").asc_nulls_last(), "a", "b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = materialise(lean.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    in_block = Window.partitionBy("conv_id", "part").orderBy(*order)
    blocks = Window.partitionBy("conv_id").orderBy("part")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.lead("part").over(blocks).isNull().alias("ends")
    )
    placed = dealt.withColumn("k", F.row_number().over(in_block)).join(counts, ["conv_id", "part"])
    placed = placed.withColumn("i", F.col("k") + F.col("skip"))
    one = lambda seed: F.xxhash64(F.lit(seed), "a", "b", "i")
    hashed = materialise(placed.select("conv_id", "part", "turn", "a", "b", "i", one(3).alias("x"), one(4).alias("y"), ((F.col("k") == F.col("n")) & F.col("ends")).alias("last")), "placed")
    carried = hashed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
        "conv_id", "part", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("cx"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("cy")
    )
    so_far = Window.partitionBy("conv_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inner = hashed.withColumn("px", F.bit_xor("x").over(so_far)).withColumn("py", F.bit_xor("y").over(so_far)).join(carried, ["conv_id", "part"])
    return inner.select("conv_id", "turn", "a", "b", "i", F.col("px").bitwiseXOR(F.col("cx")).alias("p"), F.col("py").bitwiseXOR(F.col("cy")).alias("q"), "last")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with; n_copies counts equal ones, itself included."""
    finals = prefixes.where("last").groupBy("i", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where(~F.col("last")).select("i", "p", "q").distinct()
    return finals.join(inner, ["i", "p", "q"], "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"), "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn in the form <|im_start|>role, text, <|im_end|>. "<|" of a text is written "< |", so that it can't end its turn."""
    inert = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), inert(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), inert(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def collapse_and_render(turns: DataFrame, *, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, n_turns, n_copies, segment, text): maximal conversations, rendered in rows of at most segment_turns turns.

    Turns are ordered by turn (nulls last); of the same number, by content. A row repeated within its conversation counts
    once. Rows without conv_id belong to no conversation and are left out. Null roles are "unknown", null texts empty, but
    differ from those words for the comparison. Other columns are ignored.
    """
    known = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    prefixes = materialise(prefix_hashes(known), "prefixes")
    kept = materialise(maximal(prefixes), "maximal")
    # a kept conversation meets its turns segment by segment, so that a long one is spread over tasks
    segment = lambda i: ((i - 1) / segment_turns).cast("long")
    spread = kept.select("*", F.explode(F.sequence(F.lit(0).cast("long"), segment(F.col("n_turns")))).alias("segment"))
    places = prefixes.withColumn("segment", segment(F.col("i"))).join(spread, ["conv_id", "segment"]).select("conv_id", "turn", "a", "b", "i", "segment", "n_turns", "n_copies")
    texts = known.withColumn("a", _content(F.col("role"), F.col("text"), 1)).withColumn("b", _content(F.col("role"), F.col("text"), 2)).distinct()
    same = (texts["conv_id"] == places["conv_id"]) & texts["turn"].eqNullSafe(places["turn"]) & (texts["a"] == places["a"]) & (texts["b"] == places["b"])
    rows = texts.join(places, same).select(places["conv_id"], "n_turns", "n_copies", "segment", "i", rendered_turn(F.col("role"), F.col("text")).alias("t"))
    grouped = rows.groupBy("conv_id", "n_turns", "n_copies", "segment").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("held"))
    return grouped.select("conv_id", "n_turns", "n_copies", "segment", F.array_join(F.transform("held", lambda x: x["t"]), "").alias("text"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


QUERIES = {"op2_chat_snapshots": op2_chat_snapshots}
ORACLES = {
    "op2_chat_snapshots": """WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
      prefixes AS (SELECT conv_id, list({'r': role, 't': text}) OVER w AS said, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      whole AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM prefixes WHERE i = n GROUP BY said),
      kept AS (SELECT * FROM whole WHERE said NOT IN (SELECT said FROM prefixes WHERE i < n))
      SELECT conv_id, n_turns, n_copies, CAST(0 AS BIGINT) AS segment,
        array_to_string(list_transform(said, lambda x: '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS text FROM kept""",
}
