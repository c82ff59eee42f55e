"""A prefix trie of conversations, summed up from its leaves.

Every conversation is a path from a textless root, one node for each turn; equal beginnings share their nodes. Nodes are
found by a hash of all turns up to them, so no text is shuffled. Totals of subtrees travel upwards as messages: whatever has
no unfinished child sends its totals to its parent and takes one from the parent's counter, until only the root is left. What
is peeled at once is a run of nodes: of all conversations through a node the longest one names its run, so that a run goes
from its top straight down to a leaf, and a node with one child never ends one. A round takes whole runs, not single
nodes, so there are as many rounds as runs nest in each other (under the square root of twice the number of nodes, and at most
one more than there are forks on a path), however long conversations are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table, workspace
from quillon.llm.graphs import join_groups
from quillon.llm.ranges import deal, running
from quillon.llm.resample import CRC32_SQL

#: Ids in one packed piece of a node's list of ends.
PIECE_IDS = 4096

#: A conversation takes the beginning of the first one of its group, up to this many turns less one.
GROUP, MOST_BORROWED = 5, 9


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the beginning of another: unsigned crc32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED).cast("int")


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, bytes): each conversation's turns numbered from 1; a and b are two hashes of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lean = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    dealt = deal(materialise(lean, "lean"), ["conv_id", F.col("turn").asc_nulls_first(), "a", "b"], "turns")
    return materialise(running(dealt, "conv_id", {"i": (F.lit(1), "count")}).select("conv_id", "i", "a", "b", "bytes"), "placed")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, len, a, b, bytes) for every turn of every rebuilt conversation, and (conv_id, len) for every conversation.

    A conversation begins with the first h turns of the one whose id is conv_id - conv_id % 5 (all it has, if fewer; none if it
    doesn't exist), and goes on with its own turns after its first h.
    """
    placed = _placed(turns)
    h = borrowed_turns(F.col("conv_id"))
    sizes = placed.groupBy("conv_id").agg(F.max("i").alias("n"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of"))
    m = F.least(F.col("h"), F.coalesce("of", F.lit(0)))
    known = convs.join(bases, "base", "left").select("conv_id", "base", "h", m.alias("m"), (m + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    known = materialise(known, "convs")
    # own turns: their conversation can hold any share of all rows, so its row goes to them, not they to it
    total = placed.count()
    own = join_groups(placed.where(F.col("i") > h), known.join(sizes, "conv_id").drop("base"), "conv_id", total)
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "len", "a", "b", "bytes")
    first = placed.where(F.col("i") < MOST_BORROWED).withColumnRenamed("conv_id", "base")
    taken = known.where("m > 0").join(first, "base").where("i <= m").select("conv_id", F.col("i").alias("d"), "len", "a", "b", "bytes")
    return materialise(own.unionByName(taken), "rebuilt"), known.select("conv_id", "len")


def _prefixes(rows: DataFrame) -> DataFrame:
    """rows with p and q, hashes of all turns of the conversation up to each, and up_p and up_q, those of the turns before."""
    one = lambda seed: F.xxhash64(F.lit(seed), "a", "b", "d")
    dealt = deal(rows.withColumns({"x": one(3), "y": one(4)}), ["conv_id", "d"], "dealt")
    hashed = running(dealt, "conv_id", {"p": (F.col("x"), "xor"), "q": (F.col("y"), "xor")})
    return hashed.select("conv_id", "d", "len", "bytes", "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("up_p"), F.col("q").bitwiseXOR(F.col("y")).alias("up_q"))


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(at, up, depth, conv_id, run, height, n_convs, own, n_children) for every node, the root included.

    at and up name the node and its parent, conv_id is the least member, run the longest (of equal ones the least), height its
    turns, own what sharing this node saves.
    """
    longest = F.max(F.struct("len", (-F.col("conv_id")).alias("_minus")))
    members = lambda rows, *by: rows.groupBy(*by).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), longest.alias("_l")
    )
    at, up = F.struct(F.col("d").alias("d"), "p", "q"), F.struct((F.col("d") - 1).alias("d"), F.col("up_p").alias("p"), F.col("up_q").alias("q"))
    inner = members(prefixes, "d", "p", "q", "up_p", "up_q", "bytes").select(at.alias("at"), up.alias("up"), F.col("d").cast("long").alias("depth"), "conv_id", "n_convs", "_l", "bytes")
    zero = F.lit(0).cast("long")
    top = members(convs).where("conv_id is not null").select(
        F.struct(zero.alias("d"), zero.alias("p"), zero.alias("q")).alias("at"), F.lit(None).cast(inner.schema["up"].dataType).alias("up"),
        zero.alias("depth"), "conv_id", "n_convs", "_l", zero.alias("bytes"),
    )
    found = materialise(inner.unionByName(top), "nodes")
    kids = found.where("up is not null").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    met = found.join(kids, "at", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "own": (F.col("n_convs") - 1) * F.col("bytes"),
        "run": -F.col("_l._minus"), "height": F.col("_l.len").cast("long"),
    })
    return materialise(met.drop("_l", "bytes"), "counted")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id and parent_run (null for the root); parents with many children are broadcast."""
    parents = nodes.where("n_children > 0").select(F.col("at").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("parent_run"), F.col("n_children").alias("n"))
    below = join_groups(nodes.where("up is not null"), parents, "up", nodes.count())
    none = F.lit(None).cast("long")
    return below.unionByName(nodes.where("up is null").withColumns({"parent_conv_id": none, "parent_run": none}).select(*below.columns))


def peel(runs: DataFrame) -> DataFrame:
    """(run, parent, at, leaves, saved): the totals of every run's whole subtree, given runs as (run, parent, at, waiting, leaves, saved).

    waiting counts the runs that hang from a run, leaves and saved are its own; parent is null for the root's run only. In
    each round the runs that wait for nothing send their totals to the runs that they hang from. A run is written again only
    when a message has reached it or it still waits, so what is handled shrinks from round to round.
    """
    pending, done = runs, []
    while True:
        ready = pending.where("waiting = 0").drop("waiting")
        done.append(ready)
        told = ready.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(
            F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")
        )
        rest = pending.where("waiting > 0").join(told, "run", "left")
        rest = rest.select(
            "run", "parent", "at", (F.col("waiting") - F.coalesce("_n", F.lit(0))).alias("waiting"),
            *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")),
        )
        pending = materialise(rest, "pending")
        if pending.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(at, ends_sha256) for the nodes at which conversations end.

    Ids are packed into pieces in the tasks; a node whose ids make one piece is hashed where it stands. Longer lists stream
    through one task for each node in order, piece by piece, for SHA-256 is sequential; only the hash's state is held.
    """
    zero = F.lit(0).cast("long")
    last = prefixes.where("d = len").select(F.struct(F.col("d").alias("d"), "p", "q").alias("at"), "conv_id")
    none = convs.where("len = 0").select(F.struct(zero.alias("d"), zero.alias("p"), zero.alias("q")).alias("at"), "conv_id")
    dealt = deal(materialise(last.unionByName(none), "ends"), ["at", "conv_id"], "ends-dealt")
    packed = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = dealt.groupBy("at", "part", F.floor(F.col("place") / PIECE_IDS).alias("piece")).agg(packed.alias("ids"))
    pieces = materialise(pieces, "pieces")
    many = pieces.groupBy("at").agg(F.count("*").alias("_n")).where("_n > 1")
    short = pieces.join(F.broadcast(many), "at", "left_anti") if many.count() < PIECE_IDS else pieces.join(many, "at", "left_anti")
    long = pieces.join(many.select("at"), "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != key:
                    if state is not None:
                        yield out()
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield out()

    sorted_pieces = long.withColumn("key", F.to_json("at")).repartition("key").sortWithinPartitions("key", "part", "piece").select("key", "ids")
    digests = sorted_pieces.mapInArrow(stream, "key string, ends_sha256 string")
    hashed = digests.select(F.from_json("key", last.schema["at"].dataType).alias("at"), "ends_sha256")
    return short.select("at", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256")).unionByName(hashed)


def build(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns are ordered by turn (nulls first); those of the same number by hashes of their content, and repeated rows count as
    turns. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; without any
    conversation there is no node. Ids are whole numbers. Other columns are ignored. Saved tokens are counted in bytes of
    text. See `rebuild` for how conversations are rebuilt before.
    """
    with workspace(turns.sparkSession) as keep:
        rows, convs = rebuild(turns)
        prefixes = materialise(_prefixes(rows), "prefixes")
        nodes = materialise(_with_parents(_nodes(prefixes, convs)), "linked")
        # a run's top is the node whose parent lies on another run (or that has none)
        tops = nodes.where("parent_run is null or parent_run <> run").select("run", F.col("parent_run").alias("parent"), (F.col("depth") - 1).alias("at"))
        hanging = tops.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.count("*").alias("waiting"))
        inner = nodes.groupBy("run").agg(F.sum("own").alias("saved"))
        runs = materialise(
            tops.join(inner, "run").join(hanging, "run", "left").select("run", "parent", "at", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.lit(1).cast("long").alias("leaves"), "saved"), "runs"
        )
        peeled = materialise(peel(runs), "peeled")
        # what hangs from each node of a run, and from it the totals below each node: added up from the run's leaf upwards
        met = peeled.where("parent is not null").groupBy(F.col("parent").alias("run"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        held = nodes.join(met, ["run", "depth"], "left").withColumns({
            "leaves": F.coalesce("leaves", F.lit(0)) + F.when(F.col("depth") == F.col("height"), 1).otherwise(0),
            "saved": F.coalesce("saved", F.lit(0)) + F.col("own"),
        })
        upwards = deal(materialise(held, "held"), ["run", F.col("depth").desc()], "upwards")
        below = running(upwards, "run", {"n_leaves": (F.col("leaves"), "sum"), "saved_tokens": (F.col("saved"), "sum")})
        whole = materialise(below, "below")
        ends = materialise(_ends(prefixes, convs), "digests")
        keep(whole, ends)
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(ends, "at", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {
    "op12_conversation_trie": f"""WITH
    known AS MATERIALIZED (
      SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    hashed AS (SELECT CAST(conv_id AS VARCHAR) AS word FROM known),
    {CRC32_SQL},
    sizes AS (SELECT conv_id, count(*) AS n FROM known GROUP BY conv_id),
    convs AS MATERIALIZED (
      SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base, crc % 9 AS h, least(crc % 9, coalesce(b.n, 0)) AS m
      FROM sizes s JOIN crc ON word = CAST(s.conv_id AS VARCHAR) LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
    rebuilt AS (
      SELECT c.conv_id, i AS d, r, t FROM convs c JOIN known k ON k.conv_id = c.base WHERE i <= h
      UNION ALL SELECT c.conv_id, i - h + m, r, t FROM convs c JOIN known k ON k.conv_id = c.conv_id WHERE i > h),
    paths AS MATERIALIZED (
      SELECT conv_id, d, sha256(CAST(list({{'r': r, 't': t}}) OVER (PARTITION BY conv_id ORDER BY d) AS VARCHAR)) AS said, strlen(t) AS bytes FROM rebuilt
      UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    nodes AS MATERIALIZED (SELECT d, said, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM paths GROUP BY d, said),
    members AS MATERIALIZED (SELECT p.conv_id AS c, d, n.conv_id, own FROM paths p JOIN nodes n USING (d, said)),
    links AS (SELECT n.conv_id, n.d, m.conv_id AS parent FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d = n.d - 1),
    kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM links GROUP BY ALL),
    pairs AS (SELECT DISTINCT a.conv_id, a.d, b.conv_id AS below, b.d AS bd, b.own FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d),
    totals AS (
      SELECT p.conv_id, p.d, sum(own) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
      FROM pairs p LEFT JOIN kids k ON k.conv_id = below AND k.d = bd GROUP BY ALL),
    ends AS (
      SELECT m.conv_id, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
      FROM members m JOIN (SELECT conv_id AS c, max(d) AS d FROM paths GROUP BY conv_id) USING (c, d) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
      CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n JOIN totals USING (conv_id, d) LEFT JOIN links USING (conv_id, d) LEFT JOIN kids USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)""",
}
