"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of k edits is cut into k + 1 pieces. Whoever holds the item with at most k edits holds one piece
unchanged. An Aho-Corasick automaton finds all pieces of a block of items in a whole document in one pass; around each hit
Myers' bit-parallel algorithm computes the least edit distance of the item to any passage. Case and runs of white space
don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import small_batches, table

#: One edit is allowed for each so many characters of an item; characters of items that are searched for in one pass.
CHARS_PER_EDIT, BLOCK_CHARS = 16, 2_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def piece_places(length: int, k: int) -> list[tuple[int, int]]:
    return [(length * p // (k + 1), length * (p + 1) // (k + 1)) for p in range(k + 1)]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(least distance of pattern to any substring of text, the end of the first best one), or None beyond the limit."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, end = score, j
            if not best:
                break
    return (best, end) if best <= limit else None


class Items:
    """A block of test items, ready for search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, budget(t)) for i, t in items]
        owners: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for a, b in piece_places(len(t), k):
                owners.setdefault(t[a:b], []).append((n, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, who)
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start of the window, end of the match) of every item within its budget."""
        if not self.any or not text:
            return []
        begins: dict[int, list[int]] = {}
        for last, who in self.automaton.iter(text):
            for n, _, b in who:
                begins.setdefault(n, []).append(last + 1 - b)
        out = []
        for n, starts in begins.items():
            item, t, k = self.items[n]
            best = None
            groups: list[list[int]] = []
            for s in sorted(starts):
                if groups and s - groups[-1][1] <= k:
                    groups[-1][1] = s
                else:
                    groups.append([s, s])
            for low, high in groups:
                a, b = max(0, low - k), high + len(t) + k
                window = text[a:b]
                at = window.find(t)
                got = (0, at + len(t)) if at >= 0 else myers(t, window, k if best is None else best[0] - 1)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a, a + got[1])
                    if not got[0]:
                        break
            if best:
                out.append((item, *best))
        return out


_ITEMS: dict[str, Items] = {}


def _ready(items: list[tuple[int, str]], key: str) -> Items:
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(items)
    return _ITEMS[key]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list[tuple[int, str]], str]]:
    """Blocks of normalised items of about BLOCK_CHARS characters, and a name for each.

    Items without text or id match nothing, nor do those of fewer than CHARS_PER_EDIT characters once normalised: a letter
    or a word stands in clean documents too.
    """
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()
        got = sorted({(r.i, t) for r in block if len(t := normalise(r.t)) >= CHARS_PER_EDIT})
        if got:
            yield got, hashlib.sha256(repr(got).encode()).hexdigest()


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_end): every item that a document holds within the item's budget, once, with its least distance.

    match_end is a place in the normalised text. Null and empty texts hold nothing, and items shorter than CHARS_PER_EDIT are
    in nothing. Repeated rows repeat their matches. All
    documents pass each block of items; a block is bounded.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_end", pa.int64())])
    found = None
    for block, key in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block, key=key) -> Iterator[pa.RecordBatch]:
            search = _ready(block, key).search
            for batch in batches:
                rows = [(d, i, x, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x, _, e in search(normalise(t))]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

        one = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, item_id long, distance int, match_end long")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, match_end long")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block, key in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block, key=key) -> Iterator[pa.RecordBatch]:
            search = _ready(block, key).search
            for batch in batches:
                yield batch.filter(pa.array([not search(normalise(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_pigeonhole_decontamination": op8_pigeonhole_decontamination}
ORACLES: dict[str, str] = {}
