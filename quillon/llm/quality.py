"""Quality classification by co-training.

Two classifiers see different things: one the text's words and shape, the other the page's metadata (source, language,
length). Both are logistic regressions fitted to a bounded sample of labelled documents, over features weighed by how
differently good and bad documents use them. In each round both score all documents, and each view hands to the other what it
is surest of, while the other is unsure: the surest share of either class by its own calibrated odds, however strong the view is
as a whole. A pseudo-label is the chance that the view gives, and weighs as much as it tells beyond the share of good
documents: labels of a weak view flow, but move little. Each view is
calibrated on labelled documents that it was not fitted to, and the calibrated views are combined to score every document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import hashed_share, materialise, small_batches, table, workspace
from quillon.llm.shingles import string_buffers, word_hashes

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 64
META_BUCKETS = 1 << 12
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), np.frombuffer(x, dtype=np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"))


@dataclass
class Rows:
    """Sparse rows: indices and values one after the other, at: where each row begins (rows + 1 places)."""

    index: np.ndarray
    value: np.ndarray
    at: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.index] * self.value, minlength=len(self.at) - 1)


def _steps(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def text_rows(column: pa.Array) -> Rows:
    """The distinct words of each whole text (hashed, each of weight words ** -1/4, so that one word still counts in a long text) and steps of shares: symbols, capitals, digits, exclamation, repetition and word length."""
    at, raw = string_buffers(column)
    h, word_at = word_hashes(column)
    n = len(at) - 1
    n_words = np.diff(word_at)
    row = np.repeat(np.arange(n), n_words)
    pairs = np.unique((row.astype(np.uint64) << np.uint64(32)) | (h % np.uint64(WORD_BUCKETS)))
    owner, bucket = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    words = np.maximum(n_words, 1)
    total = lambda table: np.diff(np.append(0, np.cumsum(table[raw]))[at])
    shape = [
        _steps(total(_SYMBOL) / words, [0.001, 0.02, 0.1, 0.3, 0.8, 1.5, 2.5]), _steps(total(_UPPER) / np.maximum(np.diff(at), 1), [0.005, 0.03, 0.08, 0.2, 0.5]), _steps(total(_DIGIT) / words, [0.001, 0.05, 0.3, 1]),
        _steps(total(_MARK) / words, [0.001, 0.05, 0.3]), _steps(distinct / words, [0.02, 0.1, 0.3, 0.5, 0.7, 0.9]), _steps(np.diff(at) / words, [3, 5, 7, 9, 12]), _steps(n_words, [1, 5, 20, 50, 200]),
    ]
    k = len(shape)
    index = np.concatenate([bucket, *(WORD_BUCKETS + 8 * i + s for i, s in enumerate(shape))])
    value = np.concatenate([distinct[owner] ** -0.25, np.ones(k * n)])
    order = np.argsort(np.concatenate([owner, np.tile(np.arange(n), k)]), kind="stable")
    return Rows(index[order], value[order], np.append(0, np.cumsum(distinct + k)))


def meta_rows(source: list, lang: list, n_chars: list) -> Rows:
    """Source, language, and length in steps of about a half: hashed to one index each."""
    index = []
    for s, g, n in zip(source, lang, n_chars, strict=True):
        step = -1 if n is None else int(2 * np.log2(max(int(n), 0) + 1))
        index += [zlib.crc32(x.encode()) % META_BUCKETS for x in (f"source={s}", f"lang={g}", f"length={step}")]
    return Rows(np.array(index, dtype=np.int64), np.ones(len(index)), 3 * np.arange(len(source) + 1))


def contrast(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """For each feature how differently good and bad rows use it: the size of the log ratio of its shares, counted from one."""
    of = lambda w: 1 + np.bincount(rows.index, weights=w[rows.owner], minlength=size)
    good, bad = weight * y, weight * (1 - y)
    return np.abs(np.log(of(good) / (good.sum() + 2)) - np.log(of(bad) / (bad.sum() + 2)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int, *, start: np.ndarray | None = None, l2: float = 1e-5, turns: int = 12, inner: int = 15) -> np.ndarray:
    """Weights and, in the last place, the intercept of a logistic regression of y (0 to 1), by Newton steps that conjugate gradients solve.

    Features are scaled by their contrast, so that what tells the classes apart moves first. start: weights to begin from.
    """
    out = np.zeros(size + 1) if start is None else start.copy()
    if not len(y):
        return out
    share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
    if start is None:
        out[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return out
    used, column = np.unique(rows.index, return_inverse=True)
    scale = contrast(rows, y, weight, size)[used]
    value, owner, total = rows.value * scale[column], rows.owner, weight.sum()
    dot = lambda v: np.bincount(owner, weights=v[column] * value, minlength=len(y))
    back = lambda d: np.bincount(column, weights=d[owner] * value, minlength=len(used))
    loss = lambda z, w: (weight * (np.logaddexp(0, z) - y * z)).sum() / total + l2 / 2 * (w @ w)
    w, b = np.divide(out[used], scale, out=np.zeros(len(used)), where=scale > 0), out[-1]
    z = dot(w) + b
    now = loss(z, w)
    for _ in range(turns):
        p = _sigmoid(z)
        d, h = weight * (p - y) / total, weight * p * (1 - p) / total + 1e-8
        # conjugate gradients for the Newton step; the intercept is the last place
        r = -np.append(back(d) + l2 * w, d.sum())
        x, q, rr = np.zeros(len(r)), r.copy(), r @ r
        first = rr
        for _ in range(inner):
            if rr <= max(0.01 * first, 1e-14):
                break
            t = h * (dot(q[:-1]) + q[-1])
            hq = np.append(back(t) + l2 * q[:-1], t.sum())
            alpha = rr / (q @ hq)
            x, r = x + alpha * q, r - alpha * hq
            rr, last = r @ r, rr
            q = r + rr / last * q
        step, along = 1.0, dot(x[:-1]) + x[-1]
        while step > 1e-3 and loss(z + step * along, w + step * x[:-1]) >= now:
            step /= 2
        if step <= 1e-3:
            break
        w, b, z = w + step * x[:-1], b + step * x[-1], z + step * along
        gain, now = now - loss(z, w), loss(z, w)
        if gain < 1e-7:
            break
    out[used], out[-1] = w * scale, b
    return out


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept (Platt) so that sigmoid(slope * z + intercept) is the chance of y; the slope is not negative. weight: how often each row stands."""
    w = np.ones(len(z)) if weight is None else weight
    good, bad = (w * y).sum(), (w * (1 - y)).sum()
    if not good or not bad:
        return 0.0, float(np.log((good + 1) / (bad + 1)))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    centre = z.mean() if weight is None else np.average(z, weights=w)
    spread = (z.std() if weight is None else np.sqrt(np.average((z - centre) ** 2, weights=w))) or 1.0
    x = (z - centre) / spread
    a, b = 0.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = w * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(w * x * (p - target)).sum() + 1e-2 * a, (w * (p - target)).sum()])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    a = max(a, 0.0)
    return a / spread, b - a * centre / spread


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of both views, their calibrations, the log odds of a good document, and per view how far from these odds it is sure (below, above)."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float
    text_sure: tuple[float, float] = (np.inf, np.inf)
    meta_sure: tuple[float, float] = (np.inf, np.inf)

    def logits(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log odds by text, by metadata, and of both together, as if the views were independent given the class."""
        z = [a * (rows.dot(w[:-1]) + w[-1]) + b for rows, w, (a, b) in ((text, self.text, self.text_scale), (meta, self.meta, self.meta_scale))]
        return z[0], z[1], z[0] + z[1] - self.prior

    def sure(self, z: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
        """1 where a view is sure of a good document, -1 of a bad one, else 0."""
        off = z - self.prior
        return np.where(off >= limits[1], 1, np.where(off <= -limits[0], -1, 0))


def surest(z: np.ndarray, prior: float, share: float) -> tuple[float, float]:
    """How far below and above the prior the surest share of documents of each class lies; never at the prior itself."""
    if not len(z):
        return np.inf, np.inf
    off = z - prior
    return max(float(-np.quantile(off, share)), 1e-6), max(float(np.quantile(off, 1 - share)), 1e-6)


def information(chance: np.ndarray, prior: float) -> np.ndarray:
    """What a chance tells beyond the prior log odds, as a share (0 to 1) of what knowing the class would: a ratio of divergences."""
    p, q = np.clip(chance, 1e-9, 1 - 1e-9), 1 / (1 + np.exp(-prior))
    told = p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))
    return np.clip(told / np.where(p >= q, -np.log(q), -np.log(1 - q)), 0, 1)


#: A document's features: indices of text and metadata as little-endian 32-bit numbers. The values follow from them.
VIEWS = "ti binary, mi binary"
_INPUT = ("text", "source", "lang", "n_chars")


def _read(texts: list[bytes], metas: list[bytes]) -> tuple[Rows, Rows]:
    """Both views of packed documents; a word of a text with d distinct ones has the value d ** -1/4, all else 1."""
    out = []
    for packed in (texts, metas):
        sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
        index = np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64)
        at = np.append(0, np.cumsum(sizes))
        out.append(Rows(index, np.ones(len(index)), at))
    words = out[0].index < WORD_BUCKETS
    distinct = np.bincount(out[0].owner[words], minlength=len(texts))
    out[0].value[words] = distinct[out[0].owner[words]] ** -0.25
    return out[0], out[1]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, ti, mi): the features of every row. Null texts count as empty, null metadata as a value of its own."""
    small_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(batch.schema.get_field_index(name)) for name in _INPUT}
            views = text_rows(c["text"]), meta_rows(c["source"].to_pylist(), c["lang"].to_pylist(), c["n_chars"].to_pylist())
            cut = [[raw[4 * a : 4 * b] for a, b in zip(v.at[:-1].tolist(), v.at[1:].tolist(), strict=True)] for v in views for raw in [v.index.astype("<i4").tobytes()]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in cut)], names=["doc_id", "ti", "mi"])

    return lean.mapInArrow(run, f"doc_id long, {VIEWS}")


def labelled_sample(features: DataFrame, labels: DataFrame, bound: int) -> list:
    """Features of at most `bound` labelled documents: those with the least hash of their id. Good is quality without toxicity; of several labels the mean counts, of rows with one id the least features."""
    good = F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(good).alias("good"))
    h = F.xxhash64("doc_id")
    few = marked.where(hashed_share(h, bound, marked.count()))
    chosen = few.select("doc_id", (F.col("good") >= 0.5).alias("good")).orderBy(F.shiftrightunsigned(h, 32), "doc_id").limit(bound)
    return features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("ti", "mi")).alias("m")).select("doc_id", "good", "m.*").collect()


def _sure(features: DataFrame, model: Model, known: frozenset, per_class: int, certain: float = 0.9) -> list:
    """Per view and class the per_class documents of all that this view is surest of, while the other gives either class a chance below `certain`, with the chance that it gives them. Documents in known and rows without an id are left out."""
    schema = f"doc_id long, to_meta boolean, good boolean, certainty double, chance double, tie long, {VIEWS}"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[bool, bool], list] = {(v, g): [] for v in (False, True) for g in (False, True)}
        for batch in batches:
            ids, texts, metas = (c.to_pylist() for c in batch.columns)
            zt, zm, _ = model.logits(*_read(texts, metas))
            for to_meta, z, other, limits in ((True, zt, zm, model.text_sure), (False, zm, zt, model.meta_sure)):
                own = model.sure(z, limits)
                for i in np.flatnonzero((own != 0) & (np.abs(other) < np.log(certain / (1 - certain)))).tolist():
                    if ids[i] is None or ids[i] in known:
                        continue
                    heap, key = heaps[to_meta, bool(own[i] > 0)], (float(abs(z[i] - model.prior)), zlib.crc32(str(ids[i]).encode()))
                    if len(heap) == per_class and heap[0][:2] >= key:
                        continue
                    (heapq.heappushpop if len(heap) == per_class else heapq.heappush)(heap, (*key, ids[i], float(_sigmoid(z[i])), texts[i], metas[i]))
        rows = [(x[2], v, g, x[0], x[3], x[1], *x[4:]) for (v, g), heap in heaps.items() for x in heap]
        if rows:
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "to_meta", "good", "certainty", "chance", "tie", "ti", "mi"])

    # the tasks' best are first reduced by salted groups, so that what reaches the driver doesn't grow with the tasks
    salt = F.pmod(F.xxhash64("tie", "ti"), F.lit(16))
    order = [F.desc("certainty"), F.desc("tie"), "doc_id", "ti", "mi"]
    found = features.mapInArrow(best, schema).withColumn("_r", F.row_number().over(Window.partitionBy("to_meta", "good", salt).orderBy(*order))).where(F.col("_r") <= per_class).drop("_r")
    found = materialise(found, "sure", rows=64 * per_class, rows_per_file=2000)
    out = []
    for v in (False, True):
        for g in (False, True):
            out += found.where((F.col("to_meta") == v) & (F.col("good") == g)).orderBy(*order).limit(per_class).collect()
    return out


def train(docs: DataFrame, labels: DataFrame, *, features: DataFrame | None = None, max_labelled: int = 6000, rounds: int = 3, per_class: int = 200, sure_share: float = 0.05, pseudo_weight: float = 0.5) -> Model:
    """Fit both views. A fifth of the labelled sample calibrates; the rest, and pseudo-labels, train.

    The driver holds max_labelled + rounds * 4 * per_class rows. features: those of docs, where they are already written.
    Each round after the first gives either view up to per_class new pseudo-labels of each class from the other one.
    """
    features = featured(docs) if features is None else features
    sample = sorted(labelled_sample(features, labels, max_labelled), key=lambda r: r.doc_id)
    aside = [zlib.crc32(f"calibrate {r.doc_id}".encode()) % 5 == 0 for r in sample]
    test, own = [r for r, a in zip(sample, aside, strict=True) if a], [r for r, a in zip(sample, aside, strict=True) if not a]
    known = frozenset(r.doc_id for r in sample)
    views_of = lambda rows: _read([r.ti for r in rows], [r.mi for r in rows])
    y_of = lambda rows: np.array([float(r.good) for r in rows])
    y = y_of(sample)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    more: dict[bool, list] = {True: [], False: []}
    weights: list[np.ndarray | None] = [None, None]
    model = None
    for turn in range(rounds):
        if turn:
            new = _sure(features, model, known, per_class)
            if not new:
                break
            known |= {r.doc_id for r in new}
            for r in new:
                more[r.to_meta].append(r)
        scales, sure = [], []
        for v, size in enumerate((WORD_BUCKETS + SHAPE_BUCKETS, META_BUCKETS)):
            extra = more[bool(v)]
            chance = np.array([r.chance for r in extra])
            weight = np.append(np.ones(len(own)), pseudo_weight * information(chance, prior))
            weights[v] = fit(views_of([*own, *extra])[v], np.append(y_of(own), chance), weight, size, start=weights[v])
            z = views_of(test)[v].dot(weights[v][:-1]) + weights[v][-1]
            scales.append(calibrate(z, y_of(test)))
            sure.append(surest(scales[v][0] * z + scales[v][1], prior, sure_share))
        model = Model(weights[0], weights[1], scales[0], scales[1], prior, sure[0], sure[1])
    return model


def score(features: DataFrame, model: Model, *, keep_from: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score (chances of a good document, 0 to 1) and kept, for every row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [_sigmoid(z) for z in model.logits(*_read(batch.column(1).to_pylist(), batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= keep_from)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return features.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def classify(docs: DataFrame, model: Model, *, keep_from: float = 0.5) -> DataFrame:
    """What `score` returns, for every row of docs; repeated rows are scored alike."""
    return score(featured(docs), model, keep_from=keep_from)


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features are written once: every round and the last pass read them."""
    docs = table(spark, sf_dir, "documents")
    with workspace(spark) as keep:
        features = materialise(featured(docs), "features")
        model = train(docs, table(spark, sf_dir, "labels"), features=features)
        keep(features)
    return score(features, model)


QUERIES = {"op5_co_training": op5_co_training}
ORACLES: dict[str, str] = {}
