"""Token ids as wavelet matrices: one compressed file row per shard, with access, counting and occurrence lookup.

A shard's ids are kept as bit planes from the highest bit down. Each plane is stored in the order that the planes above it
leave (zeros before ones, both in order), so that a token's place on the next plane follows from a rank. A plane is cut into
blocks of 65,536 bits, each compressed by itself together with its rank counts for every 512 bits; the directory says where a
block lies and how many ones stand before it. So access, rank and select inflate one block of each plane for each place that
they follow. Files are Parquet tables with a row per shard, so that they can lie in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import scratch, small_batches, table
from quillon.llm.tokens import default_tokenizer, encoder

MAGIC = b"QWM2"
#: Bits of a block and of a step of its rank counts; blocks that a reader keeps inflated.
BLOCK_BITS, STEP_BITS, KEPT_BLOCKS = 1 << 16, 512, 64
_STEPS, _BYTES = BLOCK_BITS // STEP_BITS, BLOCK_BITS // 8

SHARD_SCHEMA = "shard long, n_docs long, n_tokens long, payload binary"


def _blocks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A plane (packed bits) as rows of counts and bits, a row for each block, and the ones before each block."""
    k = max(1, -(-len(bits) // _BYTES))
    rows = np.zeros((k, _BYTES), dtype=np.uint8)
    rows.reshape(-1)[: len(bits)] = bits
    ones = np.bitwise_count(rows.view(np.uint64)).reshape(k, _STEPS, STEP_BITS // 64).sum(axis=2, dtype=np.int64)
    inner = np.cumsum(ones, axis=1) - ones
    total = ones.sum(axis=1)
    return np.concatenate([inner.astype("<u2").view(np.uint8), rows], axis=1), np.cumsum(total) - total


def build(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray) -> bytes:
    """The file row of a shard. doc_ids: one for each document in order (known: False for null); counts: its ids."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    kind = np.uint16 if bits <= 16 else np.uint32  # the narrower, the less memory is moved
    z = zstandard.ZstdCompressor(level=1)
    zeros, before, frames, now = [], [], [], ids.astype(kind)
    for b in range(bits - 1, -1, -1):
        ones = (now & kind(1 << b)) != 0
        rows, starts = _blocks(np.packbits(ones, bitorder="little"))
        frames += [z.compress(row) for row in rows]
        before.append(starts)
        zeros.append(m := n - int(np.count_nonzero(ones)))
        after = np.empty_like(now)
        np.compress(~ones, now, out=after[:m])
        np.compress(ones, now, out=after[m:])
        now = after
    delta = np.diff(doc_ids.astype(np.int64), prepend=np.int64(0))
    docs = [z.compress(x) for x in (delta.astype("<i8").tobytes(), np.packbits(known).tobytes(), counts.astype("<u4").tobytes())]
    ends = np.cumsum([len(f) for f in (*docs, *frames)])
    head = struct.pack("<QII", n, bits, len(doc_ids)) + np.array(zeros, dtype="<u8").tobytes() + np.concatenate(before).astype("<u8").tobytes() + ends.astype("<u8").tobytes()
    return b"".join([MAGIC, head, *docs, *frames])


class WaveletMatrix:
    """A shard read back. Only the directory is read at once; blocks are inflated when they are needed."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.payload = memoryview(payload)
        self.n, self.bits, self.n_docs = struct.unpack_from("<QII", payload, 4)
        self.blocks = max(1, -(-self.n // BLOCK_BITS))
        at = 20

        def numbers(k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype="<u8", count=k, offset=at).astype(np.int64)
            at += 8 * k
            return out

        self.zeros = numbers(self.bits)
        self.before = numbers(self.bits * self.blocks).reshape(self.bits, self.blocks)
        ends = numbers(3 + self.bits * self.blocks)
        self.places = at + np.append(0, ends)
        self.inflated = 0  # blocks inflated so far
        self._kept: OrderedDict[int, bytes] = OrderedDict()

    def _frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.payload[self.places[i] : self.places[i + 1]])

    @property
    def doc_ids(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._frame(0), dtype="<i8"))

    @property
    def known(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._frame(1), dtype=np.uint8), count=self.n_docs).astype(bool)

    @property
    def counts(self) -> np.ndarray:
        return np.frombuffer(self._frame(2), dtype="<u4").astype(np.int64)

    def _block(self, level: int, k: int) -> bytes:
        key = level * self.blocks + k
        if key in self._kept:
            self._kept.move_to_end(key)
        else:
            self._kept[key] = self._frame(3 + key)
            self.inflated += 1
            if len(self._kept) > KEPT_BLOCKS:
                self._kept.popitem(last=False)
        return self._kept[key]

    def _look(self, level: int, i: int) -> tuple[int, int]:
        """(ones among the first i bits of a plane, bit i): from one block."""
        k, j = divmod(i, BLOCK_BITS)
        if k == self.blocks:  # i is the plane's length, and that fills its blocks
            return self.n - int(self.zeros[level]), 0
        held = self._block(level, k)
        step = j // STEP_BITS
        at = 2 * _STEPS + step * (STEP_BITS // 8)
        part = int.from_bytes(held[at : at + STEP_BITS // 8], "little")
        inner = j % STEP_BITS
        ones = int(self.before[level, k]) + int.from_bytes(held[2 * step : 2 * step + 2], "little") + (part & ((1 << inner) - 1)).bit_count()
        return ones, part >> inner & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones, one = self._look(level, i)
            value = value << 1 | one
            i = int(self.zeros[level]) + ones if one else i - ones
        return value

    def _down(self, token: int, level: int, i: int) -> int:
        ones, _ = self._look(level, i)
        return int(self.zeros[level]) + ones if token >> (self.bits - 1 - level) & 1 else i - ones

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i ids."""
        if token >> self.bits:
            return 0
        a, b = 0, min(max(i, 0), self.n)
        for level in range(self.bits):
            a, b = self._down(token, level, a), self._down(token, level, b)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _places(self, token: int, first: int, last: int) -> np.ndarray:
        """Where the occurrences first to last - 1 of a token stand: their places on the lowest plane are followed up, a plane at a time."""
        a = 0
        for level in range(self.bits):
            a = self._down(token, level, a)
        at = np.arange(a + first, a + last)
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - int(self.zeros[level]) if one else at
            before = self.before[level] if one else np.arange(self.blocks) * BLOCK_BITS - self.before[level]
            block = np.searchsorted(before, want, side="right") - 1
            at = np.empty_like(want)
            for k in np.unique(block).tolist():
                bits = np.unpackbits(np.frombuffer(self._block(level, k), dtype=np.uint8, offset=2 * _STEPS), bitorder="little")
                here = block == k
                at[here] = k * BLOCK_BITS + np.flatnonzero(bits == one)[want[here] - before[k]]
        return at

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self._places(token, k, k + 1)[0])

    def occurrences(self, token: int) -> list[int]:
        return self._places(token, 0, self.count(token)).tolist() if self.count(token) else []

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            plane = b"".join(self._frame(3 + level * self.blocks + k)[2 * _STEPS :] for k in range(self.blocks))
            ones = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            z = int(self.zeros[level])
            above[np.flatnonzero(~ones)] = value[:z]
            above[np.flatnonzero(ones)] = value[z:] | kind(1 << (self.bits - 1 - level))
            value = above
        return value.astype("<u4")


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, shard_bytes: int = 16 << 20) -> None:
    """Encode whole texts (null: empty), end each document with end_id, and write ids in ascending id order, a wavelet matrix per shard.

    Rows are dealt by ranges of ids, about two shards a task, and each task cuts its rows into shards of about shard_bytes
    of text; one longer text makes a longer shard. Nothing is held on the driver. Rows without an id come first. Rows with
    the same id stand together, in the order of hashes of their texts, and can fill many shards; repeated rows are kept.
    Ids must be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is not a whole number")
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
        enc = encoder(tokenizer)
        kind = np.uint16 if max(enc.vocabulary, end_id + 1) <= 1 << 16 else np.uint32
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            ids, counts, names, known = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.record_batch([[shard], [len(counts)], [len(ids)], pa.array([build(ids, names, known, counts)], pa.binary())], schema=out)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            ids, at = enc.encode(texts)
            # each document's ids, and the end id after them
            ids = np.insert(ids.astype(kind), at[1:], kind(end_id))
            at = at + np.arange(len(at))
            known = ~np.asarray(names.is_null())
            names = names.fill_null(0).to_numpy(zero_copy_only=False)
            a = 0
            for b, n in enumerate(batch.column(2).to_pylist()):
                if size and size + n > shard_bytes:
                    if b > a:
                        held.append((ids[at[a] : at[b]], np.diff(at[a : b + 1]), names[a:b], known[a:b]))
                    yield done()
                    shard, held, size, a = shard + 1, [], 0, b
                size += n + 1
            held.append((ids[at[a] :], np.diff(at[a:]), names[a:], known[a:]))
        if held:
            yield done()

    lean = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    order = [F.col("i").asc_nulls_first(), F.xxhash64("t"), F.monotonically_increasing_id()]
    dealt = lean.repartitionByRange(max(1, -(-total // (2 * shard_bytes))), *order).sortWithinPartitions(*order[:2])
    dealt.mapInArrow(pack, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = WaveletMatrix(payload.as_py())
                raw = memoryview(m.decode().tobytes())
                counts, doc_ids, known = m.counts, m.doc_ids, m.known
                ends = np.cumsum(counts)
                for k in range(0, len(ends), 1024):
                    e, c = ends[k : k + 1024], counts[k : k + 1024]
                    texts = [raw[4 * (b - n) : 4 * b] for b, n in zip(e.tolist(), c.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(np.full(len(e), shard)), pa.array(doc_ids[k : k + 1024], mask=~known[k : k + 1024]), pa.array(e - c), pa.array(c), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], schema=schema)

    # ids before a shard: those of all tasks before its own (a row a task is added up in order), and of its own task's shards before it
    part = F.shiftright("shard", 32).alias("part")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy(part).agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(so_far(Window.orderBy("part"))), F.lit(0)).alias("p"))
    inner = shards.select("shard", part, F.coalesce(F.sum("n_tokens").over(so_far(Window.partitionBy(part).orderBy("shard"))), F.lit(0)).alias("q"))
    before = inner.join(parts, "part").select("shard", (F.col("p") + F.col("q")).alias("before"))
    docs = shards.select("shard", "payload").mapInArrow(unpack, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    return docs.join(before, "shard").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op4_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op4_wavelet_token_ids": op4_wavelet_token_ids}
ORACLES: dict[str, str] = {}
