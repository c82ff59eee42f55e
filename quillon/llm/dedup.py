"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. Every text gives its set of word shingles (64-bit hashes), the set's fingerprint and a sketch cut into bands.
2. Documents with the same set are one class; only the one with the least id goes on.
3. Each band bucket links its members to its least one. The components of these unproven links are candidate clusters:
   whatever shares a bucket is in one cluster.
4. Clusters are dealt in blocks of bounded size, each together with a few pivots of its cluster. A task counts common
   shingles exactly and returns links that span what its members' true links connect, never all pairs. As pivots are in
   every block, a large group of near copies comes together at a cost in proportion to its size.
5. In clusters of several blocks that are not one component yet, the sets of a bucket are compared block by block, except
   pairs within a component; the largest component's sets are compared with the others only.
6. Components of the proven links give each class its component.

Bands of 5 of 125 places miss a pair at similarity 0.85 with a probability of about 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, small_batches, table, workspace
from quillon.llm.graphs import components, join_groups, with_groups
from quillon.llm.shingles import shingle_sets
from quillon.llm.sketch import bands, sketches

#: Largest table of cluster members that is broadcast (some 60 bytes a row); a larger one is joined by a shuffle.
BROADCAST_MEMBERS = 250_000

#: Most dropped rows (id and hash of the text) that are broadcast.
BROADCAST_GONE = 1_000_000

#: Shingles of a block's sets (on average): long texts make blocks of fewer sets, so that a task holds some 16 MB of them.
BLOCK_SHINGLES = 1 << 21

#: Sets of a cluster of several blocks that stand in each of its blocks (on average).
PIVOTS = 24


def _print_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words: int, rows: int, n_bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (of the set; null if it is empty) and keys (of the bands)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), words)
            keys = bands(sketches(sets, rows * n_bands), rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n_bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.record_batch([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([_print_of(s) for s in sets], pa.binary()), flat], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(text_col)).mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, print binary, keys array<long>")


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, cluster, blocks, n_cluster, text) to the same with shingles in place of the text where the text has the set that node stands for."""
    schema = pa.schema([("node", pa.binary()), ("cluster", pa.binary()), ("blocks", pa.int64()), ("n_cluster", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        sets = shingle_sets(batch.column(4), words)
        same = [i for i, (s, p) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if _print_of(s) == p]
        rows = batch.select([0, 1, 2, 3]).take(pa.array(same, pa.int64()))
        yield pa.record_batch([*rows.columns, pa.array([sets[i].tobytes() for i in same], pa.binary())], schema=schema)


def linked(sets: list[np.ndarray], percent: int, groups: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of all pairs with 100 * common >= percent * union. Only pairs of different groups count.

    Common shingles are counted for all pairs at once, as products of incidence columns, over shingles of two sets or more.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    root = list(range(k))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[code[shared]], owner[shared]
    common = np.zeros((k, k), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = max(1, (1 << 22) // k)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        m = np.zeros((k, width), dtype=np.float32)
        m[row[i:j], column[i:j] - a] = 1
        common += (m @ m.T).astype(np.int64)  # a slice's counts are exact: it has fewer than 2**24 columns
    hit = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    hit &= np.tri(k, dtype=bool).T & ~np.eye(k, dtype=bool)
    hit &= groups[:, None] != groups[None, :]
    out = []
    for x, y in np.argwhere(hit).tolist():
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, rows: int = 5, n_bands: int = 25, block: int = 1024) -> DataFrame:
    """doc_id, text_hash, n_shingles, group_id, component_id (the least doc_id that true links reach) and kept, for every row.

    A-Z are lower-cased and words are runs of characters other than ASCII white space. A text with fewer words than a
    shingle has is one shingle; a text without words, or null, has none and is linked with nothing. Repeated rows are
    returned as often as they come, and all of a kept id are kept. A row without an id is linked with nothing and kept.
    Rows are linked by their texts, never by a common id: those of one id with different texts can lie in different groups.
    group_id names the group (null for a row without words or id), text_hash tells such rows apart.
    """
    with workspace(docs.sparkSession) as keep:
        meta = materialise(signatures(docs, id_col=id_col, text_col=text_col, words=words, rows=rows, n_bands=n_bands), "signatures")
        n_rows = meta.count()
        with_set = meta.where("print is not null and doc_id is not null")
        classes = with_set.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"), F.count("*").alias("n"), F.min("n_shingles").alias("size"))
        classes = materialise(classes, "classes", rows=n_rows, rows_per_file=20_000)
        found = materialise(_linked_classes(docs, classes, id_col=id_col, text_col=text_col, words=words, percent=percent, n_bands=n_bands, block=block), "components", rows=n_rows)
        keep(meta, classes, found)
    return _result(meta, n_rows, classes, found)


def _blocks(n: Column, shingles: Column, block: int) -> Column:
    """How many blocks some sets make: of `block` sets and of BLOCK_SHINGLES shingles, on average, at most."""
    return F.greatest(F.ceil(n / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _linked_classes(docs: DataFrame, classes: DataFrame, *, id_col: str, text_col: str, words: int, percent: int, n_bands: int, block: int) -> DataFrame:
    """(node, component) of the classes (node, doc_id, keys) that are linked with others. A class is known by the fingerprint of its set."""
    n_classes = classes.count()
    entries = classes.select("node", F.explode("keys").alias("key"))
    stars = with_groups(entries, "key", n_bands * n_classes, least=F.min("node")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = materialise(components(stars), "clusters", rows=n_classes)
    n_members = clusters.count()
    sized = clusters.join(classes.select("node", "doc_id", "size"), "node")
    members = with_groups(sized, "component", n_members, blocks=_blocks(F.count("*"), F.sum("size"), block), n_cluster=F.count("*"))
    members = materialise(members.select("node", F.col("component").alias("cluster"), "blocks", "n_cluster", "doc_id"), "members", rows=n_members)
    wanted = F.broadcast(members) if n_members <= BROADCAST_MEMBERS else members
    # the text of a class is that of its least id; rows of that id with another text fall out as their sets differ
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id").select("node", "cluster", "blocks", "n_cluster", "text")
    sets = materialise(texts.mapInArrow(lambda it: _sets_of(it, words), "node binary, cluster binary, blocks long, n_cluster long, shingles binary"), "sets")
    # first each block by itself, beside the pivots of its cluster
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_cluster")) < PIVOTS
    one = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("i", F.explode(F.when((F.col("blocks") > 1) & pivot, every).otherwise(F.array("own"))))
    proven = materialise(_verified(one.select("cluster", "i", F.lit(0).cast("long").alias("j"), F.col("node").alias("side"), "node", "shingles"), percent), "proven")
    found = components(proven)
    # then, in clusters of several blocks that are not one component yet, what shares a band's bucket, but for pairs of one component
    known = members.where("blocks > 1").select("node", "cluster").join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("side"))
    known = materialise(known, "known", rows=n_members)
    split = with_groups(known, "cluster", n_members, x=F.min("side"), y=F.max("side")).where("x <> y").select("node", "side")
    keyed = materialise(classes.select("node", "keys", "size").join(split, "node").select("node", "side", "size", F.explode("keys").alias("key")), "keyed", rows=n_bands * n_members)
    sizes = keyed.groupBy("key", "side").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "side", "size"))
    open_ = sizes.groupBy("key").agg(most.alias("main"), F.sum("n").alias("n_all"), F.sum("size").alias("s_all")).where("main.n < n_all")
    # the bucket's largest component is only compared with the rest: blocks from 0 to r - 1 are the rest, the m blocks after them the largest
    m, r = _blocks(F.col("main.n"), F.col("main.size"), block), _blocks(F.col("n_all") - F.col("main.n"), F.col("s_all") - F.col("main.size"), block)
    open_ = open_.select("key", F.col("main.side").alias("main"), "n_all", m.alias("m"), r.alias("r"))
    is_main = F.col("side") == F.col("main")
    placed = join_groups(keyed, open_, "key", n_bands * n_members, "n_all").withColumn("own", F.when(is_main, F.col("r") + F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.pmod(F.xxhash64("node"), F.col("r"))))
    last = F.when(is_main, F.col("r") - 1).otherwise(F.col("r") + F.col("m") - 1)
    placed = placed.select("node", F.col("key").alias("cluster"), "side", "own", last.alias("last"))
    rest = sets.select("node", "shingles").join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "side", "node", "shingles")
    more = materialise(_verified(rest, percent), "proven")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return found


def _verified(dealt: DataFrame, percent: int) -> DataFrame:
    """Proven links (a, b) that span the components of each task's sets: rows (cluster, i, j, side, node, shingles) with the same first three are one task's work. Sets of the same side aren't compared."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def done(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        once = list({node: (side, s) for side, node, s in held}.items())
        found = linked([np.frombuffer(s, dtype=np.uint64) for _, (_, s) in once], percent, np.unique([side.hex() for _, (side, _) in once], return_inverse=True)[1]) if len(once) > 1 else []
        return pa.record_batch([pa.array([once[x][0] for x, _ in found], pa.binary()), pa.array([once[y][0] for _, y in found], pa.binary())], schema=schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for c, i, j, side, node, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != (c, i, j) and held:
                    yield done(held)
                    held = []
                at = (c, i, j)
                held.append((side, node, s))
        if held:
            yield done(held)

    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(verify, "a binary, b binary")


def _result(meta: DataFrame, n_rows: int, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = classes.select("node", "doc_id", "n").join(found, "node", "left").select(F.col("node").alias("print"), "n", F.coalesce("component", "node").alias("group_id"), "doc_id")
    named = with_groups(named, "group_id", n_rows, component_id=F.min("doc_id")).drop("doc_id")
    lean = meta.select("doc_id", "text_hash", "n_shingles", "print")
    none = F.col("print").isNull() | F.col("doc_id").isNull()
    out = join_groups(lean.where(~none), named, "print", n_rows).unionByName(lean.where(none).withColumns({"group_id": F.lit(None).cast("binary"), "component_id": F.col("doc_id")}))
    return out.select("doc_id", "text_hash", "n_shingles", "group_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each group of near copies: that of the least id, and of several such the one with the least hash of its text.

    Rows are told apart by id and text, not by id alone: a unique text stays, whatever else has its id. Of rows that share
    both, the least in the order of all columns stays. Rows without an id or without words stay.
    """
    key, names = F.col(id_col).cast("long"), docs.columns
    row = [F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")]
    with workspace(docs.sparkSession) as keep:
        found = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **settings), "near-duplicates")
        groups = found.where("kept and group_id is not null").groupBy("group_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
        twice = materialise(groups.where("n > 1"), "twice")
        keep(found, twice)
    marked = docs.withColumns({"_k": key, "_x": F.xxhash64(text_col)})
    on = (F.col("_k") == F.col("_i")) & (F.col("_x") == F.col("_h"))
    gone = found.where(~F.col("kept")).select(*row).distinct()
    # few of them reach the documents where they lie; beyond that bound one shuffle brings both together
    rest = marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone.hint("merge"), on, "left_anti")
    if twice.isEmpty():
        return rest.select(*names)
    linked = found.where("kept and group_id is not null").select("group_id", "doc_id", "text_hash").distinct().join(twice.select("group_id"), "group_id", "left_semi").select(*row)
    once = rest.join(twice.select(*row), on, "left_semi").groupBy("_k", "_x").agg(F.min(F.struct(*names)).alias("m")).select("m.*")
    return rest.join(linked, on, "left_anti").select(*names).unionByName(once)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLES: dict[str, str] = {}
