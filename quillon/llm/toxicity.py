"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded as the sum of rows of a hashed table: one for the word itself and one for each of its beginnings and ends
of a few lengths, so that a word not met before is known by its stem. Filters over one, two and three words run along the
whole text, the highest value of each is kept (wherever it stands), and a logistic layer scores these values. All labelled
documents count. They are dealt to workers, which each pass their own in steps from one model; the models are averaged, and
the next round begins with the average. A fifth of the documents is set aside: it fixes the slope and intercept that make
scores chances, and for each language the score from which documents are flagged. Language is used for that threshold only,
never for a score.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import hashed_share, small_batches, table
from quillon.llm.language import held_out
from quillon.llm.quality import calibrate
from quillon.llm.shingles import mix, span_hashes, string_buffers

#: Buckets of the embedding table, numbers of a word, words that a filter spans, and filters of each span.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 16, (1, 2, 3), 12

#: Lengths in bytes of the beginnings and ends of a word that have rows of their own.
BEGINNINGS, ENDS = (3, 4, 5, 6, 7, 8, 9), (4, 6)

#: Documents that hold a key before it gets a row: what few hold would only be learned by heart.
LEAST_DOCS = 2

#: Words that are handled at once.
CHUNK = 1 << 15

#: Labelled documents of a worker and most workers, rounds of training, passes over a portion of texts within a round, and its bytes.
WORKER_DOCS, WORKERS, ROUNDS, PASSES, PORTION = 8000, 64, 2, 2, 4 << 20

#: Keys that a task counts before it gives them out, rows of the table that are averaged at once, and steps of a log odd by which
#: documents that were set aside are counted.
COUNTED, BLOCK, STEPS = 1 << 20, 1 << 12, 256

#: Labelled documents up to which their ids are broadcast.
BROADCAST_LABELS = 2_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def cut_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, where words begin and end in them, and where each row's words begin (rows + 1 places).

    Words are runs of letters a to z, digits, and bytes beyond ASCII. Nulls are empty.
    """
    at, raw = string_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(raw)
    inner = _WORD[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begin, end = inner.copy(), inner.copy()
    begin[1:] &= ~inner[:-1] | edge[1:n]
    end[:-1] &= ~inner[1:] | edge[1:n]
    first = np.flatnonzero(begin)
    return raw, first, np.flatnonzero(end) + 1, np.searchsorted(first, at)


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts the number of its spelling, where each row's words begin, and for each spelling its keys.

    Keys are hashes of the word and of its beginnings and ends, in columns; 0 where the word is too short for one.
    """
    raw, first, last, at = cut_words(column)
    if not len(first):
        return np.zeros(0, dtype=np.int64), at, np.zeros((0, 1 + len(BEGINNINGS) + len(ENDS)), dtype=np.uint64)
    whole, where, which = np.unique(span_hashes(raw, first, last), return_index=True, return_inverse=True)
    # the spellings' bytes, one after the other
    size = (last - first)[where]
    stop = np.cumsum(size)
    start = stop - size
    bytes_ = raw[np.repeat(first[where] - start, size) + np.arange(stop[-1])]
    with np.errstate(over="ignore"):
        keys = [mix(whole + np.uint64(1))]
        for k in BEGINNINGS:
            keys.append(np.where(size >= k, mix(span_hashes(bytes_, start, np.minimum(start + k, stop)) + np.uint64(2)), np.uint64(0)))
        for k in ENDS:
            keys.append(np.where(size >= k, mix(span_hashes(bytes_, np.maximum(stop - k, start), stop) + np.uint64(3)), np.uint64(0)))
    return which, at, np.stack(keys, axis=1)


@dataclass
class Vocabulary:
    """Keys that training knows: their buckets in ascending order and, to tell them from others of the same bucket, 16 more bits."""

    bucket: np.ndarray
    mark: np.ndarray
    row: np.ndarray = field(init=False, repr=False)
    marks: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.row, self.marks = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.uint16)
        self.row[self.bucket] = np.arange(1, len(self.bucket) + 1)
        self.marks[self.bucket] = self.mark

    def __getstate__(self):
        return self.bucket, self.mark

    def __setstate__(self, state):
        self.bucket, self.mark = state
        self.__post_init__()

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The table's row of each key; 0 (whose row is zero) for unknown ones."""
        b = (keys % np.uint64(BUCKETS)).astype(np.int64)
        return np.where((keys != 0) & (self.marks[b] == (keys >> np.uint64(48)).astype(np.uint16)), self.row[b], 0)


def columns_of(width: int) -> list[slice]:
    """The columns of a filter bank that hold each word of a span of this width."""
    before = sum(w for w in WIDTHS if w < width)
    return [slice((before + k) * FILTERS, (before + k + 1) * FILTERS) for k in range(width)]


@dataclass
class Model:
    """The classifier. Without labels of both classes it gives everything the same score."""

    words: Vocabulary
    table: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    scale: tuple[float, float]
    thresholds: dict[str, float]
    threshold: float

    def pooled(self, which: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The highest value of every filter in every row; 0 is the least, also of rows without words."""
        n = len(at) - 1
        rows = self.words.rows(keys)
        each = np.zeros((len(keys) + 1, self.bank.shape[1]), dtype=np.float32)  # the last one is a blank
        for k in range(0, len(keys), CHUNK):
            each[k : k + CHUNK][: len(rows[k : k + CHUNK])] = self.table[rows[k : k + CHUNK]].sum(axis=1) @ self.bank
        return np.maximum(np.concatenate(highest(each, which, at, n), axis=1) + self.bias, 0)

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.chances(self.pooled(*word_keys(column)) @ self.out + self.intercept)

    def chances(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def highest(each: np.ndarray, which: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Per width the highest sum over a span that begins in a row; a span that leaves its row meets blanks (the last row of each)."""
    blank, most = len(each) - 1, max(WIDTHS) - 1
    # blanks stand between the rows, so that no span reaches from one row into another
    owner = np.repeat(np.arange(n), np.diff(at))
    spread = np.full(len(which) + n * most, blank, dtype=np.int64)
    spread[np.arange(len(which)) + owner * most] = which
    starts = at[:-1] + np.arange(n) * most
    out = [np.full((n, FILTERS), -np.inf, dtype=np.float32) for _ in WIDTHS]
    full = np.flatnonzero(np.diff(at) > 0)
    for k in range(0, len(spread), CHUNK):
        stop = min(k + CHUNK, len(spread))
        part = each[np.append(spread[k : min(stop + most, len(spread))], np.full(max(stop + most - len(spread), 0), blank))]
        # rows with a word in this chunk
        a, b = np.searchsorted(starts[full] + np.diff(at)[full], k, side="right"), np.searchsorted(starts[full], stop)
        here = full[a:b]
        if not len(here):
            continue
        edges = np.stack([np.maximum(starts[here] - k, 0), np.minimum(starts[here] + np.diff(at)[here], stop) - k], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= stop - k else edges
        for w, best in zip(WIDTHS, out, strict=True):
            value = sum(part[j : j + stop - k, c] for j, c in enumerate(columns_of(w)))
            best[here] = np.maximum(best[here], np.maximum.reduceat(value, edges, axis=0)[::2])
    return [np.where(np.isfinite(x), x, 0) for x in out]


def _vocabulary(which: np.ndarray, at: np.ndarray, keys: np.ndarray, y: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The keys that LEAST_DOCS documents or more hold (of those in one bucket the most frequent), and the log ratio of their shares in either class."""
    flat, number = np.unique(keys, return_inverse=True)
    number = number.reshape(keys.shape)
    held = np.zeros((2, len(flat)))
    for a, b, c in zip(at[:-1], at[1:], y, strict=True):
        held[int(c), np.unique(number[np.unique(which[a:b])])] += 1
    total = held.sum(axis=0)
    known = np.flatnonzero((total >= LEAST_DOCS) & (flat != 0))
    bucket = (flat[known] % np.uint64(BUCKETS)).astype(np.int64)
    order = np.lexsort((flat[known], -total[known], bucket))
    known, bucket = known[order], bucket[order]
    first = np.append(True, bucket[1:] != bucket[:-1]) if len(bucket) else np.zeros(0, dtype=bool)
    known, bucket = known[first], bucket[first]
    clean, toxic = ((held[c, known] + 0.5) / (max((y == c).sum(), 1) + 1) for c in (0, 1))
    return Vocabulary(bucket, (flat[known] >> np.uint64(48)).astype(np.uint16)), np.log(toxic / clean)


@dataclass
class Training:
    """A model with what its steps need: moments of the dense parts, squared gradients of the table's rows so far, and the steps done."""

    model: Model
    top: np.ndarray
    first: list[np.ndarray]
    second: list[np.ndarray]
    seen: np.ndarray
    turn: int = 0

    @classmethod
    def begin(cls, words: Vocabulary, contrast: np.ndarray, toxic: float, clean: float, chance: np.random.Generator) -> Training:
        """Rows of the table begin with how differently the classes use a key in one place and small random numbers in the others."""
        table_ = chance.normal(0, 0.02, (len(contrast) + 1, DIM)).astype(np.float32)
        table_[1:, 0] = np.clip(contrast, -3, 3) / 3
        table_[0] = 0
        bank = chance.normal(0, 0.3 / np.sqrt(DIM), (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        bank[0] = np.abs(bank[0]) + 0.1
        bias, out = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), chance.normal(0.1, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
        top = np.array([np.log((toxic + 1) / (clean + 1))], dtype=np.float32)
        model = Model(words, table_, bank, bias, out, float(top[0]), (1.0, 0.0), {}, 0.5)
        zeros = lambda: [np.zeros_like(x) for x in (bank, bias, out, top)]
        return cls(model, top, zeros(), zeros(), np.full((len(table_), 1), 1e-6, dtype=np.float32))

    def dense(self) -> list[np.ndarray]:
        return [self.model.bank, self.model.bias, self.model.out, self.top]

    def go(self, which: np.ndarray, at: np.ndarray, rows: np.ndarray, y: np.ndarray, chance: np.random.Generator, *, passes: int, batch: int = 32, rate: float = 0.005) -> None:
        """Passes over some documents. Gradients reach the words of the span that won; steps are scaled by the gradients so far (the table) or lately (the rest)."""
        for _ in range(passes):
            order = chance.permutation(len(y))
            for k in range(0, len(order), batch):
                self.turn += 1
                grads = _step(self.model, order[k : k + batch], which, at, rows, y, self.seen, rate * 5, self.top)
                for x, g, m, v in zip(self.dense(), grads, self.first, self.second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.99**self.turn)) + 1e-8)
        self.model.intercept = float(self.top[0])


def fit(texts: list[str], y: np.ndarray, *, epochs: int = 4, batch: int = 32, rate: float = 0.005, seed: int = 1) -> Model:
    """A model of the texts (y: 1 toxic, 0 clean), neither calibrated nor with thresholds."""
    chance = np.random.default_rng(seed)
    which, at, keys = word_keys(pa.array(texts, pa.string()))
    words, contrast = _vocabulary(which, at, keys, y)
    state = Training.begin(words, contrast, y.sum(), len(y) - y.sum(), chance)
    if len(np.unique(y)) == 2:
        state.go(which, at, words.rows(keys), y, chance, passes=epochs, batch=batch, rate=rate)
    return state.model


def _step(model: Model, docs: np.ndarray, which: np.ndarray, at: np.ndarray, rows: np.ndarray, y: np.ndarray, seen: np.ndarray, rate: float, top: np.ndarray) -> list[np.ndarray]:
    """One pass of some documents forth and back. The table is stepped here; gradients of filters, biases, weights and intercept are returned."""
    most, n = max(WIDTHS) - 1, len(docs)
    used, local = np.unique(np.concatenate([which[at[d] : at[d + 1]] for d in docs]), return_inverse=True)
    vector = np.vstack([model.table[rows[used]].sum(axis=1), np.zeros((1, DIM), dtype=np.float32)])
    each = vector @ model.bank
    blank, won, values, k = len(used), [], [], 0
    for d in docs:
        size = at[d + 1] - at[d]
        said = np.append(local[k : k + size], np.full(most + (size == 0), blank))
        k += size
        part = each[said]
        for w in WIDTHS:
            value = sum(part[j : len(said) - most + j, c] for j, c in enumerate(columns_of(w)))
            best = value.argmax(axis=0)
            values.append(value[best, np.arange(FILTERS)])
            won.append(said[best[:, None] + np.arange(w)])
    z = np.array(values).reshape(n, -1) + model.bias
    h = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ model.out + top[0], -30, 30)))
    off = ((p - y[docs]) / n).astype(np.float32)
    back = off[:, None] * model.out * (z > 0)
    bank_grad, word_grad = np.zeros_like(model.bank), np.zeros_like(vector)
    for i, w in enumerate(WIDTHS):
        picked = np.stack(won[i :: len(WIDTHS)])  # document, filter, place in the span
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        for j, c in enumerate(columns_of(w)):
            bank_grad[:, c] = np.einsum("nfd,nf->df", vector[picked[:, :, j]], g)
            np.add.at(word_grad, picked[:, :, j].ravel(), (g[:, :, None] * model.bank[:, c].T[None]).reshape(-1, DIM))
    word_grad[blank] = 0
    moved = np.flatnonzero(np.abs(word_grad[:-1]).sum(axis=1))
    keys = rows[used[moved]]
    spread = np.repeat(word_grad[moved], keys.shape[1], axis=0)
    touched, place = np.unique(keys.ravel(), return_inverse=True)
    grad = np.zeros((len(touched), DIM), dtype=np.float32)
    np.add.at(grad, place.ravel(), spread)
    grad[touched == 0] = 0
    seen[touched] += (grad * grad).mean(axis=1, keepdims=True)
    model.table[touched] -= rate * grad / np.sqrt(seen[touched])
    return [bank_grad, back.sum(axis=0), h.T @ off, np.array([off.sum()], dtype=np.float32)]


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which flagging gives the highest F1 (weighted): halfway, in log odds, to the next lower score; 0.5 without both classes."""
    if len(np.unique(y)) < 2:
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit, all_ = score[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.append(s[1:] != s[:-1], True)  # ties are flagged together
    f1 = np.where(ends, 2 * hit / (all_ + (weight * y).sum()), -1)
    k = int(f1.argmax())
    odds = lambda x: np.log(max(x, 1e-9) / max(1 - x, 1e-9))
    return float(1 / (1 + np.exp(-(odds(s[k]) + odds(s[k + 1])) / 2))) if k + 1 < len(s) else float(s[k])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, lang_col: str, max_toxic: int, max_clean: int, max_bytes: int,
) -> tuple[DataFrame, int, dict[bool, float]]:
    """(_id, toxic, text, lang) of a bounded sample, how many rows it has, and how many labelled documents each drawn one stands for.

    At most max_toxic and max_clean documents of max_bytes of whole texts together: those with the least hashes of their ids, of
    which only ids and lengths come to the driver. Of several labels of a document the mean counts (a half is toxic); of several
    rows with one id the least text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    counts = dict(known.groupBy("toxic").agg(F.count("*")).collect())
    h, chosen = F.xxhash64("_id"), None
    for toxic, most in ((True, max_toxic), (False, max_clean)):
        of = known.where(F.col("toxic") == toxic).where(hashed_share(h, most, counts.get(toxic, 0)))
        of = of.orderBy(F.shiftrightunsigned(h, 32), "_id").limit(most)
        chosen = of if chosen is None else chosen.unionByName(of)
    lean = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = lean.select("_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "_id").groupBy("_id", "toxic").agg(F.max("n").alias("n")).collect()
    total, ids, drawn = 0, [], {True: 0, False: 0}
    for r in sorted(sizes, key=lambda r: _order(r._id)):
        if total + r.n > max_bytes:
            break
        total, drawn[r.toxic] = total + r.n, drawn[r.toxic] + 1
        ids.append((r._id, r.toxic))
    stands = {c: counts.get(c, 0) / max(drawn[c], 1) for c in (True, False)}
    wanted = docs.sparkSession.createDataFrame(ids, known.schema)
    rows = lean.join(F.broadcast(wanted), "_id").groupBy("_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("m")).select("_id", "toxic", "m.*")
    return rows, len(ids), stands


def _order(doc_id) -> tuple[int, str]:
    """A fixed order of ids that has nothing to do with their values."""
    return zlib.crc32(f"sample {doc_id}".encode()), str(doc_id)


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """(_id, toxic, text, lang) of all labelled documents, dealt to workers by id, and how many workers these are.

    Of several labels of a document the mean counts (a half is toxic); of several rows with one id the least text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    n = known.count()
    workers = min(max(-(-n // WORKER_DOCS), 1), WORKERS)
    lean = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    met = lean.join(F.broadcast(known) if n <= BROADCAST_LABELS else known.hint("merge"), "_id").repartition(workers, "_id")
    return met.groupBy("_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("m")).select("_id", "toxic", "m.*"), workers


def vocabulary_of(rows: DataFrame, toxic: int, clean: int) -> tuple[Vocabulary, np.ndarray]:
    """What `_vocabulary` gives, of (toxic, text) rows of any number: tasks count keys, the counts are added by key, then the most frequent of each bucket stays.

    At most BUCKETS keys come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.zeros(0, dtype=np.uint64), np.zeros((2, 0), dtype=np.int64)
        for batch in batches:
            which, at, spelt = word_keys(batch.column(1))
            flat, number = np.unique(np.append(keys, spelt), return_inverse=True)
            sums = np.zeros((2, len(flat)), dtype=np.int64)
            sums[:, number[: len(keys)]] = held
            number = number[len(keys) :].reshape(spelt.shape)
            for a, b, c in zip(at[:-1], at[1:], batch.column(0).to_pylist(), strict=True):
                sums[int(c), np.unique(number[np.unique(which[a:b])])] += 1
            keys, held = flat, sums
            if len(keys) > COUNTED:
                yield counted(keys, held)
                keys, held = keys[:0], held[:, :0]
        yield counted(keys, held)

    def counted(keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        real = keys != 0
        return pa.RecordBatch.from_arrays([pa.array(keys[real].view(np.int64)), pa.array(held[0, real]), pa.array(held[1, real])], names=["key", "clean", "toxic"])

    each = rows.select("toxic", "text").mapInArrow(run, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known = each.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).withColumn("bucket", F.col("key").bitwiseAND(BUCKETS - 1).cast("int"))
    best = known.groupBy("bucket").agg(F.max_by(F.struct("key", "clean", "toxic"), F.struct(F.col("clean") + F.col("toxic"), "key")).alias("b"))
    ratio = F.log((F.col("b.toxic") + 0.5) / (max(toxic, 1) + 1)) - F.log((F.col("b.clean") + 0.5) / (max(clean, 1) + 1))
    got = best.select("bucket", F.shiftrightunsigned("b.key", 48).cast("int").alias("mark"), ratio.cast("float").alias("ratio")).toArrow()
    bucket, mark, contrast = (got.column(c).to_numpy() for c in ("bucket", "mark", "ratio"))
    order = np.argsort(bucket)
    return Vocabulary(bucket[order].astype(np.int64), mark[order].astype(np.uint16)), contrast[order]


def averaged(state: Training, rows: DataFrame, turn: int, passes: int) -> Training:
    """A round: every partition of (toxic, text) rows is a worker that goes on from state with its own rows, portion by portion.

    A row of the table moves by the mean over the workers that moved it; the dense parts become the mean weighted by documents.
    Workers give out the rows that they moved, in blocks, which are added by block: a group holds a block of each worker.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, was = TaskContext.get().partitionId(), shared.value
        own, chance, n = copy.deepcopy(was), np.random.default_rng([turn, worker]), 0
        for texts, y in portions(batches):
            which, at, keys = word_keys(texts)
            own.go(which, at, own.model.words.rows(keys), y, chance, passes=passes)
            n += len(y)
        if not n:
            return
        yield packed(-1, worker, (n, [*own.dense(), *own.first, *own.second], own.turn))
        moved = np.flatnonzero(own.seen[:, 0] != was.seen[:, 0])
        for part in np.split(moved, np.flatnonzero(np.diff(moved // BLOCK)) + 1) if len(moved) else ():
            yield packed(int(part[0] // BLOCK), worker, (part.astype(np.int32), own.model.table[part] - was.model.table[part], own.seen[part] - was.seen[part]))

    def packed(block: int, worker: int, found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([worker], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["block", "worker", "found"])

    def merge(group: pa.Table) -> pa.Table:
        block, given = group.column(0)[0].as_py(), sorted(zip(group.column(1).to_pylist(), group.column(2).to_pylist(), strict=True))
        given = [pickle.loads(g) for _, g in given]
        if block < 0:
            n = sum(g[0] for g in given)
            out = n, [sum(g[0] / n * x.astype(np.float64) for g, x in zip(given, xs, strict=True)).astype(np.float32) for xs in zip(*(g[1] for g in given), strict=True)], max(g[2] for g in given)
        else:
            times, table_, seen = np.zeros((BLOCK, 1), dtype=np.float32), np.zeros((BLOCK, DIM), dtype=np.float32), np.zeros((BLOCK, 1), dtype=np.float32)
            for at, x, v in given:
                k = at - block * BLOCK
                times[k] += 1
                table_[k] += x
                seen[k] += v
            k = np.flatnonzero(times)
            out = (k + block * BLOCK).astype(np.int32), table_[k] / times[k], seen[k] / times[k]
        return pa.table({"block": pa.array([block], pa.int32()), "found": pa.array([pickle.dumps(out)], pa.binary())})

    each = rows.select("toxic", "text").mapInArrow(run, "block int, worker int, found binary")
    for r in each.groupBy("block").applyInArrow(merge, "block int, found binary").toLocalIterator():
        if r.block < 0:
            _, parts, state.turn = pickle.loads(r.found)
            for x, new in zip([*state.dense(), *state.first, *state.second], parts, strict=True):
                x[...] = new
        else:
            at, x, v = pickle.loads(r.found)
            state.model.table[at] += x
            state.seen[at] += v
    state.model.intercept = float(state.top[0])
    shared.destroy()
    return state


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts of PORTION bytes or a little more, and their labels, of batches of (toxic, text)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= PORTION:
            yield _joined(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    return pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in batches]), np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches]).astype(float)


def settle(model: Model, held: DataFrame, stands: dict[bool, float], least_toxic: int) -> Model:
    """The model calibrated, and given its thresholds, by (toxic, text, lang) rows that training didn't see.

    All of them count: by language, label and log odds in steps of 1 / STEPS, so that the driver holds counts and no documents.
    """
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = shared.value.pooled(*word_keys(batch.column(1))) @ shared.value.out + shared.value.intercept
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.rint(np.clip(z, -60, 60) * STEPS).astype(np.int32))], names=["toxic", "lang", "z"])

    counts = held.select("toxic", "text", "lang").mapInArrow(run, "toxic boolean, lang string, z int").groupBy("toxic", "lang", "z").count().orderBy("toxic", "lang", "z").toArrow()
    shared.destroy()
    y, n, z = (counts.column(c).to_numpy().astype(float) for c in ("toxic", "count", "z"))
    z /= STEPS
    a, b = calibrate(z, y, n)
    # toxic and clean documents may have been drawn at different rates: back to the rates of all labelled documents
    model.scale = (a, b + float(np.log(stands[True] / stands[False])))
    score, weight = model.chances(z), n * np.where(y > 0, stands[True], stands[False])
    lang = np.array([g or "" for g in counts.column("lang").to_pylist()])
    model.threshold = best_threshold(score, y, weight)
    for g in sorted(set(lang.tolist()) - {""}):
        of = lang == g
        if (n * y)[of].sum() >= least_toxic and (n * (1 - y))[of].sum() >= least_toxic:
            model.thresholds[g] = best_threshold(score[of], y[of], weight[of])
    return model


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: dict[str, int] | None = None, least_toxic: int = 10, seed: int = 1,
) -> Model:
    """Fit, calibrate and set thresholds on labels (doc_id, toxic): on all labelled documents, or on a sample with the bounds of `labelled_sample`.

    Counts, steps and calibration run in tasks; the driver holds the model, which has at most BUCKETS rows, and counts. A language with
    fewer than least_toxic toxic documents among those set aside gets the threshold of all. Without labels, or with labels of one
    class only, the model gives every text the same score: the share of toxic labels, counted from one.
    """
    small_batches(docs.sparkSession)
    names, stands = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col}, {True: 1.0, False: 1.0}
    if sample is None:
        rows, workers = labelled(docs, labels, **names)
    else:
        rows, n, stands = labelled_sample(docs, labels, **names, **sample)
        workers = min(max(-(-n // WORKER_DOCS), 1), WORKERS)
        rows = rows.repartition(workers, "_id")
    aside = F.crc32(F.concat(F.lit("aside "), F.col("_id").cast("string")).cast("binary")) % 5 == 0
    rows = rows.withColumn("aside", aside).sortWithinPartitions(F.xxhash64("_id"), "_id").persist(StorageLevel.DISK_ONLY)
    try:
        counts = {(r.aside, r.toxic): r["count"] for r in rows.groupBy("aside", "toxic").count().collect()}
        toxic, clean = counts.get((False, True), 0), counts.get((False, False), 0)
        chance, fitted = np.random.default_rng(seed), rows.where("not aside")
        if not toxic or not clean:
            blank = Training.begin(Vocabulary(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16)), np.zeros(0), toxic, clean, chance).model
            all_ = {c: stands[c] * (counts.get((False, c), 0) + counts.get((True, c), 0)) for c in (True, False)}
            blank.intercept, blank.scale = 0.0, (0.0, float(np.log((all_[True] + 1) / (all_[False] + 1))))
            return blank
        state = Training.begin(*vocabulary_of(fitted, toxic, clean), toxic, clean, chance)
        for turn in range(ROUNDS):
            state = averaged(state, fitted, turn, PASSES)
        return settle(state.model, rows.where("aside"), stands, least_toxic)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score (0 to 1: the chance that the whole text is toxic); null and empty texts are scored as texts without words.

    A column of that name is replaced; repeated rows are scored alike. Nothing is shuffled; the model, which has at most BUCKETS
    rows, is broadcast.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(batch.column(at)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, `{name}` double")


def threshold_of(lang: Column, model: Model) -> Column:
    """The score from which a document of this language is flagged; that of all documents for languages without one."""
    out = F.lit(model.threshold)
    for g, t in model.thresholds.items():
        out = F.when(lang == g, F.lit(t)).otherwise(out)
    return out


def flag(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with score, threshold (by language) and toxic (score at or above it). Such columns are replaced."""
    found = score(docs.drop("threshold", "toxic"), model, text_col=text_col)
    limit = threshold_of(F.col(lang_col), model)
    return found.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def op13_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = flag(docs.select("doc_id", "text", "lang"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", F.col("toxic").alias("flagged"))


QUERIES = {"op13_toxicity_cnn": op13_toxicity_cnn}
ORACLES: dict[str, str] = {}
