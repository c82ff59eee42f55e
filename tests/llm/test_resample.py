"""Operator 11 and rows dealt by ranges, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import resample
from quillon.llm.ranges import deal, ranked, running

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def plain(docs, target, longest=1, percent=10, min_words=20, seed=2024, of=10_000):
    def cut(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % of for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    found = [(i, *cut(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in cut(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + of) / ((s[b] + 1) * (t.total() + of)))) for b in range(of)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    out = []
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        drawn[r] += 1
        out.append((r[0], *r[2:], k))
    for r in rows:
        if drawn[r]:
            drawn[r] -= 1
        else:
            out.append((r[0], *r[2:], None))
    return sorted(out, key=str)


def texts(n):
    vocabulary = ["the", "red", "Fox", "jumps", "over", "dog", "été", "x9", "lazy", "und"]
    return [" ".join(vocabulary[(i * 7 + j * j + j * (i % 3)) % 10] for j in range(i % 60)) for i in range(n)]


ODD = [None, "", " .,\n", "ONE", "word " * 30_000, "x" * 100_000, "a b c d e f g h i j k l m n o p q r s t", "café naïve 7seven"]


def test_like_plain(spark):
    docs = [*enumerate(texts(400)), *((1000 + i, t) for i, t in enumerate(ODD)), (7, texts(60)[58]), (7, texts(60)[58]), (None, texts(60)[59]), (None, "")]
    target = ["the lazy dog jumps", "x9 und x9 und", None, ""]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], "doc_id long, text string, weight int, rank int, part int, place int, able int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for more in ({}, {"longest": 2, "percent": 37, "min_words": 5, "seed": 1}, {"percent": 100, "min_words": 0, "of": 7}):
        got = resample.resample(frame, goal, **more)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, **more)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resample(none, one).collect() == []
    got = resample.resample(one, none, percent=100).first()
    assert (got.n_features, got["rank"]) == (40, 1)


def test_only_counts_shuffle_before_the_ranks(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = resample.weighed(docs, [5] * resample.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan


def test_ranges_rank_and_run(spark):
    rows = [(k, i, (i * 37 + k) % 101) for k in (1, 2, 3) for i in range(2000 if k == 2 else 20)] + [(None, 0, 4), (None, 1, 6)]
    frame = spark.createDataFrame(rows, "k long, i long, v long")
    dealt = deal(frame, [F.col("k").asc_nulls_first(), "i"], "test")
    assert dealt.select("part").distinct().count() > 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in ranked(dealt, "r").orderBy("r").select("k", "i", "v").collect()] == order
    got = running(dealt, "k", {"s": (F.col("v"), "sum"), "x": (F.col("v"), "xor"), "n": (F.lit(1), "count")})
    want, held = {}, {}
    for k, i, v in order:
        s, x, n = held.get(k, (0, 0, 0))
        want[k, i] = held[k] = (s + v, x ^ v, n + 1)
    assert {(r.k, r.i): (r.s, r.x, r.n) for r in got.collect()} == want
