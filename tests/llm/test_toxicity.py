"""Operator 13: the network against plain loops, and what it finds in documents that training never sees."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.llm.common import table

STEMS = {"en": "zarb", "de": "quolm"}


def corpus(n, seed=0):
    """(id, text, lang, toxic): toxic texts hold two or more words with a stem of their language, each with an end of its own."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["an", "th", "er", "on", "ge", "sch", "li", "ou"]) for _ in range(draw.randint(1, 4)))
    out = []
    for i in range(n):
        lang, toxic = draw.choice(["en", "de"]), draw.random() < 0.3
        said = [word() for _ in range(draw.randint(10, 80))]
        for _ in range(draw.randint(2, 5) if toxic else 0):
            said.insert(draw.randrange(len(said)), STEMS[lang] + word())
        out.append((i, " ".join(said).capitalize() + ".", lang, int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(500)
    return toxicity.fit([r[1] for r in rows], np.array([float(r[3]) for r in rows]))


def test_words_and_keys():
    texts = ["One, two ONE", None, "", "été-Straße x" + "É", "two"]
    raw, first, last, at = toxicity.cut_words(pa.array(texts))
    words = [bytes(raw[a:b]).decode() for a, b in zip(first, last, strict=True)]
    assert words == ["one", "two", "one", "été", "straße", "xé", "two"] and at.tolist() == [0, 3, 3, 3, 6, 7]
    which, _, keys = toxicity.word_keys(pa.array(texts))
    assert which[0] == which[2] and which[1] == which[6] and len(keys) == 5
    a, b = (toxicity.word_keys(pa.array([w]))[2][0] for w in ("idiotic", "idiots"))
    assert a[0] != b[0] and (a[1:4] == b[1:4]).all() and b[6] == 0


def plain_pooled(model, text):
    """Every filter over every span of the text, one by one."""
    which, _, keys = toxicity.word_keys(pa.array([text]))
    said = [model.table[model.words.rows(keys[k])].sum(axis=0) for k in which]
    out = []
    for w in toxicity.WIDTHS:
        spans = [sum(x @ model.bank[:, c] for x, c in zip(said[i : i + w], toxicity.columns_of(w))) for i in range(len(said))]  # noqa: B905
        out.append(np.max(spans, axis=0) if spans else np.zeros(toxicity.FILTERS))
    return np.maximum(np.concatenate(out) + model.bias, 0)


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_pooling_like_plain(model, monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    texts = ["", "zarb", None, "an zarban", " .. ", *(r[1] for r in corpus(12, 3)), "th " * 40 + "zarbon"]
    got = model.pooled(*toxicity.word_keys(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_pooled(model, text), atol=1e-4)


def test_gradients_like_differences(model):
    """A step's gradients of filters and weights against differences of the loss."""
    rows = corpus(6, 9)
    y = np.array([float(r[3]) for r in rows])
    which, at, keys = toxicity.word_keys(pa.array([r[1] for r in rows]))
    numbers = model.words.rows(keys)
    top = np.zeros(1, dtype=np.float32)

    def loss():
        z = model.pooled(which, at, keys).astype(np.float64) @ model.out
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads = toxicity._step(model, np.arange(6), which, at, numbers, y, np.full((len(model.table), 1), 1e30, dtype=np.float32), 0.0, top)
    draw = np.random.default_rng(0)
    for x, g in zip((model.bank, model.bias, model.out), grads, strict=False):
        for _ in range(6):
            at_ = tuple(draw.integers(0, k) for k in x.shape)
            was, step = x[at_], 1e-2
            x[at_] = was + step
            up = loss()
            x[at_] = was - step
            down = loss()
            x[at_] = was
            assert abs((up - down) / (2 * step) - g[at_]) < 2e-3 + 0.1 * abs(g[at_])


def test_thresholds_like_all_cuts():
    draw = np.random.default_rng(2)
    for _ in range(20):
        s, y, w = draw.integers(1, 9, 30) / 10, (draw.random(30) < 0.4).astype(float), draw.choice([1.0, 3.0], 30)
        f1 = lambda t: 2 * (w * y)[s >= t].sum() / (w[s >= t].sum() + (w * y).sum())
        assert f1(toxicity.best_threshold(s, y, w)) == pytest.approx(max(map(f1, s)))
    assert toxicity.best_threshold(np.array([0.2]), np.array([1.0]), np.ones(1)) == 0.5


def test_finds_unseen_words_and_flags_by_language(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, g, 0.5, True, 1.0) for i, t, g, _ in rows] + [(9000, None, None, 0.5, True, 1.0), (9001, "", "en", 0.5, True, 1.0), (9001, "", "en", 0.5, True, 1.0)], "doc_id long, text string, lang string, score double, toxic boolean, threshold double")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if i % 3] + [(None, 1), (1, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.thresholds) <= {"en", "de"} and model.thresholds
    got = {r.doc_id: r for r in toxicity.flag(docs, model).collect()}
    unseen = [r for r in rows if r[0] % 3 == 0]
    assert sum((got[i].score >= 0.3) == bool(x) for i, _, _, x in unseen) >= 0.97 * len(unseen)
    assert all(got[i].toxic == (got[i].score >= model.thresholds.get(g, model.threshold)) for i, _, g, _ in unseen)
    assert got[9000].score == got[9001].score and not got[9000].toxic
    assert toxicity.flag(docs.drop("score", "toxic", "threshold"), model).count() == len(rows) + 3
    # another language's name changes no score
    other = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("xx")), model).collect()}
    assert all(abs(other[i] - got[i].score) < 1e-9 for i in other)


def test_bounds_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} text", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int")
    rows, n, stands = toxicity.labelled_sample(docs, labels, id_col="doc_id", text_col="text", lang_col="lang", max_toxic=5, max_clean=10, max_bytes=70)
    assert rows.count() == n == 7 and stands[False] == pytest.approx(60 / 7)
    for given in (labels, labels.where("false")):
        found = toxicity.score(docs, toxicity.train(docs, given)).select("score").distinct().collect()
        assert len(found) == 1 and 0 < found[0][0] < 1
    none = docs.where("false")
    assert toxicity.score(none, toxicity.train(none, labels)).collect() == []


def test_query(spark, sf_dir):
    got = toxicity.op13_toxicity_cnn(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and any(r.held_out for r in got)
    assert re.fullmatch(r"doc_id held_out score predicted.*", " ".join(got[0].__fields__))


def test_all_labels_count(spark, monkeypatch):
    """Documents beyond any bound are learned from: dealt to several workers, every key is counted and every held document calibrates."""
    rows = corpus(800, 5)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int")
    names = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang"}
    monkeypatch.setattr(toxicity, "WORKER_DOCS", 200)
    dealt, workers = toxicity.labelled(docs, labels, **names)
    assert workers == 4 == dealt.rdd.getNumPartitions() and dealt.count() == 800
    y = np.array([float(r[3]) for r in rows])
    want, ratio = toxicity._vocabulary(*toxicity.word_keys(pa.array([r[1] for r in rows])), y)
    monkeypatch.setattr(toxicity, "COUNTED", 500)
    got, found = toxicity.vocabulary_of(dealt, int(y.sum()), int(len(y) - y.sum()))
    assert (got.bucket == want.bucket).all() and (got.mark != want.mark).mean() < 0.01 and np.allclose(found[got.mark == want.mark], ratio[got.mark == want.mark], atol=1e-5)
    monkeypatch.setattr(toxicity, "PORTION", 5000)
    model = toxicity.train(docs, labels)
    fresh = corpus(300, 6)
    score = model.scores(pa.array([r[1] for r in fresh]))
    assert ((score >= 0.3) == np.array([r[3] == 1 for r in fresh])).mean() >= 0.97 and model.thresholds
