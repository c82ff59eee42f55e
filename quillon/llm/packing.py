"""Best-fit packing of tokenised documents with certified bin counts.

Documents longer than a sequence are cut so that all pieces but the first are full. The pieces are written once. The
lengths of the short pieces are dealt to partitions of bounded size and the same mix of lengths, and each runs best-fit
decreasing. Dual feasible
functions over a partition's own lengths give a lower bound on the bins that they need: a partition that meets its bound is
certified and settled as it is. Those with gaps exchange documents: their full sequences are settled, the pieces of the
others are dealt anew, to fewer partitions, and packed again, until none is left, one partition holds all of them, or a
round gains next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import materialise, small_batches, table
from quillon.llm.tokens import default_tokenizer, encoder


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of all documents, as a written table: ids as little-endian unsigned 16- or 32-bit numbers (the narrowest that fits the vocabulary), and the crc32 of the 32-bit ones.

    A null text is empty and gives one piece, the end id. Rows with the same or no doc_id are separate documents; piece_key
    is unique. Ids that are whole numbers become longs, others (such as strings) keep their type.
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    key_type = docs.schema[id_col].dataType
    key_type = T.LongType() if isinstance(key_type, T.IntegralType) else key_type
    schema = pa.schema([("piece_key", pa.int64()), ("doc_id", to_arrow_type(key_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.array([end_id], dtype="<u4")
        kind = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, at = enc.encode(batch.column(1))
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.concatenate([ids[a:b], tail])
                first = len(own) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(own), capacity)]):
                    part = own[start : first if not piece else start + capacity]
                    rows.append((key, doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(kind).tobytes()))
                    key += 1
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    made = f"piece_key long, doc_id {key_type.simpleString()}, piece int, start long, length long, ids_crc32 long, ids binary"
    return materialise(docs.select(F.col(id_col).cast(key_type), F.col(text_col)).mapInArrow(cut, made), "pieces")


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions over a histogram of lengths (index: length).

    The families are the rounding functions u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, and the threshold
    functions that count lengths over 1 - e as whole bins and ignore those under e.
    """
    x = np.arange(len(histogram), dtype=np.int64)
    total = int((histogram * x).sum())
    best = -(-total // capacity)
    for k in range(1, 24):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity), so that all is whole
        u = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((histogram * u).sum()) // (k * capacity)))
    count, weight = np.cumsum(histogram), np.cumsum(histogram * x)
    for e in range(1, capacity // 2 + 1):
        large = int(count[-1] - count[capacity - e])
        best = max(best, large + -(-int(weight[capacity - e] - weight[e - 1]) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each length, the longest placed first, each in the fullest bin that still holds it."""
    bin_of, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = bins, capacity
            bins += 1
        bin_of[i], offset[i] = b, capacity - room
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bin_of, offset


#: What the packer of a partition returns: bins counts a sequence in one of its rows; bound is the partition's.
PACKED = "piece_key long, length long, sequence_id long, offset long, filled long, bins long, part long, bound long, certified boolean"


def _packer(turn: int, capacity: int):
    """Packs one partition's pieces and compares its bins with the bound of its own lengths."""

    def pack(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("piece_key", ignore_index=True)
        lengths, part = held["length"].to_numpy(), np.int64(held["part"].iloc[0])
        b, offset = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(b, weights=lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pd.DataFrame({
            "piece_key": held["piece_key"], "length": lengths, "sequence_id": (np.int64(turn) << 58) + (part << 28) + b, "offset": offset, "filled": filled[b],
            "bins": (offset == 0).astype(np.int64), "part": part, "bound": np.int64(bound), "certified": len(filled) == bound,
        })

    return pack


def _dealt(pool: DataFrame, turn: int, n: int) -> DataFrame:
    """pool with part, 0 to n - 1: pieces in the order of their lengths are dealt in turn, so that every partition has the same mix of lengths."""
    if n == 1:
        return pool.withColumn("part", F.lit(0).cast("long"))
    shuffled = F.xxhash64("piece_key", F.lit(turn))
    in_order = pool.repartitionByRange("length", shuffled).sortWithinPartitions("length", shuffled, "piece_key")
    return in_order.withColumn("part", F.pmod(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), F.lit(n)))


def place(parts: DataFrame, *, capacity: int = 1024, items_per_partition: int = 16_384, least_gain: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(piece_key, sequence_id, offset, certified) of each piece (piece_key, length), and the certificates.

    A certificate (turn, part, n_pieces, sequences, bound, certified) says how many sequences a partition used and how many
    any packing of its pieces needs. Certified ones are final; of the others only the last turn's and the full sequences
    are. At most items_per_partition (about) are in memory at once. Full pieces are sequences of their own. Turns end when
    all is settled, all that is left was in one partition, or a turn saved less than least_gain of the sequences with gaps.
    """
    spark = parts.sparkSession
    whole = parts.where(F.col("length") == capacity).select("piece_key", (-F.col("piece_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    settled, certificates = [whole], []
    pool = parts.where(F.col("length") < capacity).select("piece_key", "length")
    left, gapped = pool.count(), None
    for turn in range(31):  # sequence ids have room for so many; the pool shrinks with each turn
        if not left:
            break
        n = max(1, -(-left // items_per_partition))
        dealt = _dealt(pool, turn, n)
        packed = materialise(dealt.groupBy("part").applyInPandas(_packer(turn, capacity), PACKED), "packed")
        certificates.append(packed.groupBy(F.lit(turn).alias("turn"), "part").agg(F.count("*").alias("n_pieces"), F.sum("bins").alias("sequences"), F.max("bound").alias("bound"), F.bool_and("certified").alias("certified")))
        final = F.col("certified") | (F.col("filled") == capacity)
        bins, gaps, left = packed.agg(F.sum("bins"), F.coalesce(F.sum(F.when(~final, F.col("bins"))), F.lit(0)), F.count(F.when(~final, 1))).first()
        placed = packed.select("piece_key", "sequence_id", "offset", "certified")
        if not left or n == 1 or turn == 30 or gapped is not None and gapped - bins < least_gain * gapped:
            settled.append(placed)
            break
        settled.append(placed.where(final))
        pool, gapped = packed.where(~final).select("piece_key", "length"), gaps
    out = reduce(DataFrame.unionByName, settled)
    none = spark.createDataFrame([], "turn int, part long, n_pieces long, sequences long, bound long, certified boolean")
    return out, reduce(DataFrame.unionByName, certificates, none)


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: for each the ids of its pieces one after the other, and the pieces."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    grouped = parts.join(placed, "piece_key").groupBy("sequence_id").agg(held.alias("held"))
    return grouped.select("sequence_id", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("held", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Every piece of every document and its place; certified says that its partition used as few sequences as its pieces allow."""
    parts = pieces(docs)
    placed, _ = place(parts)
    return parts.drop("ids").join(placed, "piece_key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
