"""Operator 12 against a plain trie."""

import hashlib
import zlib

from quillon.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, order=None):
    """The rows build() should return. order sorts turns of the same number; without it there must be none."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(said, key=order or (lambda x: x[:2]))] for c, said in convs.items()}
    rebuilt = {}
    for c, said in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - c % 5, [])[:h] + said[h:])
    members = {}
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    out = []
    for node, of in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in of if rebuilt[c] == node))
        kids = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in members)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), kids(node), sum(kids(n) == 0 for n in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows):
    return sorted(tuple(r) for r in trie.build(spark.createDataFrame(rows, SCHEMA)).collect())


def logs(n, deepest=12):
    """Snapshots and forks: conversations take their turns from few words, so that many beginnings are shared."""
    return [(c, i, "user" if i % 2 else None, f"word {(c * c * (i // 3 + 1)) % 3} é") for c in range(n) for i in range((c * 7) % deepest)]


def test_like_plain(spark):
    rows = logs(60) + [(3, None, None, None), (200, 1, "user", None), (201, 1, "user", ""), (-7, 1, "x", "y"), (None, 1, "no", "conversation")]
    assert got(spark, rows) == plain(rows)


def test_long_chain_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    rows = [(c, i, "user", f"turn {i}") for c in range(1000, 1005) for i in range(150 - 10 * (c % 5))]
    rows += [(5 * c, 0, "user", "hello") for c in range(400, 700)] + [(10_000, 0, "user", "x" * 200_000)]
    assert got(spark, rows) == plain(rows)


def test_rounds_follow_forks_not_turns(spark, monkeypatch):
    rounds = []
    once = trie.materialise
    monkeypatch.setattr(trie, "materialise", lambda df, label, **more: (rounds.append(label), once(df, label, **more))[1])
    got(spark, [(5 * c, i, "user", str(i)) for c in range(30) for i in range(c + 1)])
    assert rounds.count("pending") <= 2


def test_ties_and_repeated_rows_are_turns(spark):
    rows = [(0, 1, "user", "same")] * 3 + [(5, 1, "user", "same")] * 2
    assert got(spark, rows) == plain(rows)
    a = got(spark, [(0, 1, "a", "b"), (0, 1, "c", "d")])
    assert a == got(spark, [(0, 1, "c", "d"), (0, 1, "a", "b")]) and len(a) == 3


def test_empty_and_other_columns(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []
    rows = [(0, 1, "user", "a"), (5, 1, "user", "b")]
    more = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], SCHEMA + ", part int, at int, run int, depth int")
    assert sorted(tuple(r) for r in trie.build(more).collect()) == plain(rows)
