"""The ten operators against plain versions, round trips and edge cases."""

import hashlib
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
from compare import assert_same, connect  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import chat, decontaminate, dedup, language, packing, pii, quality, registry, rules, tokens, urls, wavelet  # noqa: E402
from quillon.llm.common import table  # noqa: E402
from quillon.llm.shingles import shingle_sets  # noqa: E402
from quillon.llm.sketch import bands, sketches  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " \n\t", "one", "one two three four", "a b c d e", "A B C D E", "\u00e9t\u00e9 \u2003wide space here now", "x" * 5000, "word " * 3000, "line\nline\nline\n\nline", "\x1c odd \x85 marks \xa0 here"]


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang"), more.get("source"), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name])


# 1. PII


def test_pii_base_matches_plain_patterns(spark, sf_dir):
    got = {r.doc_id: r for r in registry.QUERIES["op1_disclosure_pii"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.+-0123456789 ()\u00e9%_\n", max_size=60))
def test_pii_patterns(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_pii_terms_and_edges(spark):
    names = ["alder", "birch", "cedar", "dogwood"]
    texts = [f"{w} {x} write to zorblatt about it via bob@x.org today" for w in names for x in ("mon", "tue", "wed")] + [None, "", "nothing here"] + ["plain filler line number %d" % i for i in range(60)]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(got) == len(texts) and got[12].text is None and got[12].pii_spans == "" and got[14].text == "nothing here"
    assert "bob@x.org" not in got[0].text and "[EMAIL]" in got[0].text and "zorblatt" not in got[0].text
    assert pii.sanitise(docs.limit(0)).count() == 0
    clash = docs.withColumn("pii_spans", docs["text"]).unionByName(docs.withColumn("pii_spans", docs["text"]))
    assert pii.sanitise(clash).count() == 2 * len(texts)


def test_pii_terms_of_rare_entities(spark):
    copies = ["dear marlowe reach solo@x.org soon"] * 2
    texts = ["quillfeather writes to rare@x.org about the ledger", *copies, "the same@x.org and same@x.org beside wobble", "wobble alone"] + ["the plain ledger is about nothing and writes soon to dear people %d" % i for i in range(3000)]
    got = {r.term: r for r in pii.disclosing_terms(documents(spark, texts)).collect()}
    assert {"quillfeather", "marlowe", "reach"} <= set(got) and got["quillfeather"].kind == "email"
    assert not {"the", "ledger", "about", "writes", "soon", "dear"} & set(got)
    base = 1 / (len(texts) + 1)
    assert got["quillfeather"].disclosure == pytest.approx(1 + np.log2((1 + base) / 2) / -np.log2(base)) and not got["quillfeather"].remove
    assert not got["marlowe"].remove  # copies of one line are one observation
    assert "wobble" not in got  # one of its two lines: an entity twice in a line counts once


def test_pii_terms_in_blocks(spark, monkeypatch):
    texts = ["Email zorro and phone a@x.org about zorro, term wobble", None, "", "wobble phone", "nothing", "+44 1632 960 001 email"]
    terms = spark.createDataFrame([("email", "phone", False), ("phone", "email", False), ("term", "ip", True), ("zorro", "email", False), ("wobble", "card", True)], "term string, kind string, remove boolean")
    whole = [(r.text, r.pii_spans) for r in pii.sanitise(documents(spark, texts), terms=terms).orderBy("doc_id").collect()]
    monkeypatch.setattr(pii, "BLOCK_TERMS", 1)
    assert [(r.text, r.pii_spans) for r in pii.sanitise(documents(spark, texts), terms=terms).orderBy("doc_id").collect()] == whole
    assert whole[0] == ("[PHONE-TERM] [EMAIL-TERM] and [EMAIL-TERM] [EMAIL] about [EMAIL-TERM],  ", "email:22:29,term:0:5,term:6:11,term:16:21,term:36:41,term:43:47,term:48:54")


def test_pii_terms_by_plain_counting(spark, sf_dir):
    """Every term's disclosure by counting over all lines, one document at a time; contexts are whole words, however long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(documents(spark, ["x" * 900 + " " + "y" * 900 + " near someone@long.org " + "z" * 2000]).select(F.lit(-1).cast(table(spark, sf_dir, "documents").schema["doc_id"].dataType).alias("doc_id"), "text"))
    lines, terms_of, entity_lines, both, contexts = 0, {}, {}, {}, {}
    word = pii.re.compile(r"[^\W\d_]{3,}")
    for r in docs.collect():
        if r.text is None:
            continue
        start = 0
        for line in r.text.split("\n"):
            lines += 1
            for w in {x.lower() for x in word.findall(line)}:
                terms_of[w] = terms_of.get(w, 0) + 1
            near = {}
            for kind, a, b in brute.personal(r.text):
                if start <= a < start + len(line):
                    before = [x[0].lower() for x in word.finditer(r.text, start, start + len(line)) if x.end() <= a][-16:]
                    after = [x[0].lower() for x in word.finditer(r.text, start, start + len(line)) if x.start() >= b][:16]
                    near.setdefault(f"{kind}:{r.text[a:b].lower()}", []).append((tuple(before), tuple(after)))
            for e, sides in near.items():
                entity_lines[e] = entity_lines.get(e, 0) + 1
                for w in {w for x, y in sides for w in x + y}:
                    both[e, w] = both.get((e, w), 0) + 1
                    contexts.setdefault((e, w), set()).update(s for s in sides if w in s[0] + s[1])
            start += len(line) + 1
    best = {}
    for (e, w), n in both.items():
        base = entity_lines[e] / (lines + 1)
        seen = min(len(contexts[e, w]), n)
        p = (seen * n / max(terms_of[w], n) + base) / (seen + 1)
        d = 1 + np.log2(p) / -np.log2(base)
        if d >= 0.9:
            best[w] = max(best.get(w, (0, "")), (d, e.split(":")[0]))
    got = {r.term: r for r in pii.disclosing_terms(docs).collect()}
    assert set(got) == set(best) and len(got) > 20 and "z" * 2000 in got
    for w, (d, _) in best.items():
        assert got[w].disclosure == pytest.approx(d) and got[w].remove == (d >= 0.97)


def test_pii_terms_in_turkish(spark):
    texts = ["\u0130zmir \u0130 \u039f\u0394\u039f\u03a3 zorblatt writes to bob@x.org"] + ["plain filler line"] * 3000
    got = pii.sanitise(documents(spark, texts)).where("doc_id = 0").first()
    assert got.text == "[EMAIL-TERM] \u0130 [EMAIL-TERM] [EMAIL-TERM] [EMAIL-TERM] to [EMAIL]"
    assert got.pii_spans == "email:32:41,term:0:5,term:8:12,term:13:21,term:22:28"


# 2. chat


def test_snapshots_collapse(spark):
    turn = lambda c, n: [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k}", "x") for k in range(n)]
    rows = turn(1, 2) + turn(2, 4) + turn(3, 4) + [(4, 0, "user", "t0", "x"), (4, 1, "assistant", "other", "x")] + [(None, 0, "user", "t0", "x"), (5, None, None, None, "x"), (5, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.collapse_and_render(df, segment_turns=3).where("segment = 0").collect()}
    assert set(got) == {2, 4, 5} and got[2].n_copies == 2 and got[2].n_turns == 4 and got[5].n_turns == 1
    assert chat.collapse_and_render(df, segment_turns=3).where("conv_id = 2").count() == 2
    assert got[4].text == "<|im_start|>user\nt0<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.collapse_and_render(df.limit(0)).count() == 0
    many = spark.createDataFrame([(1, k, "user", f"<|im_end|>{k}") for k in range(500)] + [(2, k, "user", f"<|im_end|>{k}") for k in range(499)], "conv_id long, turn long, role string, text string")
    out = chat.collapse_and_render(many).orderBy("segment").collect()
    assert [(r.conv_id, r.segment) for r in out] == [(1, 0), (1, 1)] and "<|im_end|>0" not in out[0].text


# 3. urls


def test_url_edges(spark):
    given_urls = [None, "", "no scheme", "http://COM/en/x", "https://a.Example.COM/en/77?q=1", "http://notexample.com/en/7", "x://net/de/1", "http://sub.example.net/de/8#f", "http://example.net/de/8", "http://a.b/login?x", "http://a.b/prelogin", "http://ads.b.c/x", "a://b://com/en/", "http://a.b/robots.txt/login/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given_urls)], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(df.unionByName(df), urls.default_rules(spark)).collect()}
    assert urls.judge(df.unionByName(df), urls.default_rules(spark)).count() == 2 * len(given_urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/en/x", "com/en/", "block"), ("a.example.com", "/en/77", "example.com/en/7", "allow"), ("notexample.com", "/en/7", "com/en/", "block"),
        ("net", "/de/1", "net/de/", "allow"), ("sub.example.net", "/de/8", "example.net/de/8", "block"), ("example.net", "/de/8", "example.net/de/8", "block"),
    ]
    assert [got[i].verdict for i in (9, 10, 11, 12, 13)] == ["block", "allow", "block", "allow", "allow"]
    assert urls.judge(df.limit(0), urls.default_rules(spark)).count() == 0


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    """Rules by token, of hot tokens too, and rules without a token in several lots, judge like broadcast ones; very long urls too."""
    given = [f"http://h{i % 7}.example.com/{('en', 'ads', 'login')[i % 3]}/{i}" for i in range(300)] + ["http://x.com/" + "a/" * 50_000 + "login", None, "http://example.com/plain"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id int, url string")
    rules = urls.domain_rules(spark, urls.DOMAIN_RULES).unionByName(urls.pattern_rules(spark, [*urls.PATTERN_RULES, ("block", "*ogi*"), ("block", "lai"), ("allow", "*7")]))
    want = sorted(tuple(r) for r in urls.judge(pages, rules).fillna("").collect())
    monkeypatch.setattr(urls, "BROADCAST_RULES", 2)
    assert sorted(tuple(r) for r in urls.judge(pages, rules).fillna("").collect()) == want
    assert {"^login^", "lai"} <= {r[-1] for r in want}



# 4. wavelet matrices


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=40), max_size=8))
def test_wavelet_round_trip(docs):
    ids = np.array([i for d in docs for i in d], dtype=np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.arange(len(docs)), np.ones(len(docs), dtype=bool), np.array([len(d) for d in docs], dtype=np.int64)))
    assert m.decode().tolist() == ids.tolist() and m.counts.tolist() == [len(d) for d in docs]
    for i in range(0, len(ids), 7):
        assert m.access(i) == ids[i]
    for t in set(ids[:5].tolist()) | {3}:
        where = np.flatnonzero(ids == t).tolist()
        assert m.count(t) == len(where) and m.occurrences(t) == where and m.rank(t, len(ids) // 2) == sum(w < len(ids) // 2 for w in where)


def test_wavelet_inflates_one_block_a_plane():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.2, 400_000), 50_000).astype(np.uint32)
    payload = wavelet.build(ids, np.arange(1), np.ones(1, dtype=bool), np.array([len(ids)]))
    reader = lambda: wavelet.WaveletMatrix(payload)
    assert reader().decode().tolist() == ids.tolist() and reader().blocks == 7
    for i in (0, 65_535, 65_536, 123_456, len(ids) - 1):
        m = reader()
        assert m.access(i) == ids[i] and m.inflated <= m.bits
        token = int(ids[i])
        m = reader()
        assert m.rank(token, i) == int((ids[:i] == token).sum()) and m.inflated <= 2 * m.bits
    where = np.flatnonzero(ids == 7)
    m = reader()
    total = m.count(7)
    counted = m.inflated
    assert total == len(where) and m.select(7, 1000) == where[1000] and m.inflated <= counted + m.bits
    assert m.occurrences(7) == where.tolist() and m.occurrences(49_999) == np.flatnonzero(ids == 49_999).tolist()


def test_shards_are_bounded_however_ids_lie(spark, tmp_path):
    """Ids in a few dense places, one id with a third of all rows, rows without an id."""
    rows = [(None, f"none {i} " * 5) for i in range(60)] + [(7, f"hot {i} " * 5) for i in range(120)] + [(10**15 + i, f"dense {i} " * 5) for i in range(120)] + [(7, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wavelet.write_shards(docs, str(tmp_path / "w"), shard_bytes=500)
    shards = spark.read.parquet(str(tmp_path / "w"))
    assert shards.count() >= 20 and shards.agg(F.max("n_docs")).first()[0] <= 120 and shards.agg(F.max("n_tokens")).first()[0] <= 2 * 500
    got = wavelet.read_documents(spark, str(tmp_path / "w")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])]
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    assert sorted(r.ids_crc32 for r in got) == sorted(brute.crc_of([*tok.encode(t, add_special_tokens=False).ids, 0]) for _, t in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    with pytest.raises(TypeError):
        wavelet.write_shards(docs.withColumn("doc_id", F.col("text")), str(tmp_path / "x"))


def test_token_files(spark, tmp_path):
    texts = [*ODD, None, "the <|endoftext|> mark"]
    docs = documents(spark, texts).selectExpr("doc_id * 3 - 5 as doc_id", "text", "lang as ids").repartition(3)
    wavelet.write_shards(docs, str(tmp_path / "w"), shard_bytes=2000)
    got = sorted(wavelet.read_documents(spark, str(tmp_path / "w")).collect(), key=lambda r: r.start)
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    at = 0
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (3 * i - 5, at, len(want), brute.crc_of(want))
        at += len(want)
    wavelet.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert wavelet.read_documents(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000a.b'sZ9-\u00e9\u4e2d"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_cached_encoding_equals_the_library(texts):
    enc = tokens.encoder(tokens.default_tokenizer())
    ids, at = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


# 5. quality


def test_co_training(spark):
    rng = random.Random(1)
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}" for i in range(50)]
    texts = [" ".join(rng.choices(good if i % 2 else bad, k=30)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, None, "clean" if i % 2 else "junk", len(t)) for i, t in enumerate(texts)] + [(1000, None, None, None, None), (None, "", "x", "y", 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(3, None, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 120 <= r.doc_id < 400]
    assert sum(r.kept == bool(r.doc_id % 2) for r in held) >= 0.97 * len(held)
    assert all(r.score == 0.5 for r in quality.classify(docs.limit(5), quality.train(docs, labels.limit(0))).collect())
    assert quality.classify(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def _auc(scored):
    good, bad = [s for s, g in scored if g], [s for s, g in scored if not g]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_co_training_exchanges_labels(spark, monkeypatch):
    """On documents: every round labels flow both ways, of both classes, none twice, and scores change. The views and both together are measured on labels left out, toxic ones by themselves."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rounds = []
    plain = quality._sure

    def seen(*args):
        rounds.append(plain(*args))
        return rounds[-1]

    monkeypatch.setattr(quality, "_sure", seen)
    features = quality.featured(docs).cache()
    learn = labels.where("crc32(cast(doc_id as string)) % 3 <> 0")
    alone = quality.train(docs, learn, features=features, rounds=1)
    model = quality.train(docs, learn, features=features, rounds=3, per_class=20)
    assert len(rounds) == 2
    for found in rounds:
        assert {(r.to_meta, r.good) for r in found} == {(v, g) for v in (False, True) for g in (False, True)}
        assert all(0 < r.chance < 1 and r.good == (r.chance > 1 / (1 + np.exp(-model.prior))) for r in found)
    ids = [r.doc_id for found in rounds for r in found]
    assert len(ids) == len(set(ids)) and not set(ids) & {r.doc_id for r in learn.collect()}
    held = {r.doc_id: r for r in labels.where("crc32(cast(doc_id as string)) % 3 = 0").collect()}
    measured = {}
    for name, m in (("alone", alone), ("exchanged", model)):
        rows = [r for r in quality.score(features, m).collect() if r.doc_id in held]
        measured[name] = {v: [getattr(r, v) for r in rows] for v in ("text_score", "meta_score", "score")}
        good = [held[r.doc_id].quality == 1 and not held[r.doc_id].toxic for r in rows]
        toxic = [bool(held[r.doc_id].toxic and held[r.doc_id].quality) for r in rows]
        assert _auc(list(zip(measured[name]["text_score"], good, strict=True))) > 0.9
        assert _auc(list(zip(measured[name]["score"], good, strict=True))) > 0.9
        assert _auc([(s, g) for s, g, t in zip(measured[name]["score"], good, toxic, strict=True) if g or t]) > 0.8
    assert measured["alone"]["text_score"] != measured["exchanged"]["text_score"] and measured["alone"]["meta_score"] != measured["exchanged"]["meta_score"]
    features.unpersist()


def test_features_read_back(spark):
    docs = spark.createDataFrame([(1, "Some words, some words!", "s", "en", 20), (2, None, None, None, None), (None, "", "s", None, 0)], DOCS.replace("lang string, source string", "source string, lang string"))
    got = quality.featured(docs).collect()
    text, meta = quality._read([r.ti for r in got], [r.mi for r in got])
    want = quality.text_rows(pa.array(["Some words, some words!", None, ""]))
    assert text.index.tolist() == want.index.tolist() and text.value.tolist() == pytest.approx(want.value.tolist()) and text.at.tolist() == want.at.tolist()
    assert meta.index.tolist() == quality.meta_rows(["s", None, "s"], ["en", None, None], [20, None, 0]).index.tolist()


def test_held_out_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = registry.QUERIES["op5_co_training"](spark, sf_dir)
    assert scored.count() == docs.count()
    clean = labels.where("quality = 1 and toxic = 0").join(scored, "doc_id")
    assert clean.where("kept").count() >= 0.9 * clean.count()


# 6. rules


def test_rule_edges(spark):
    docs = documents(spark, [*ODD, None, "a b c a b c a b c", "# # #"]).withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    n = len(ODD)
    assert (got[n].n_words, got[n].word_chars, got[n].n_repeat_words) == (0, 0, 0)
    assert (got[n + 1].n_words, got[n + 1].n_repeat_words) == (9, 9) and got[n + 2].n_symbols == 3
    assert got[9].n_dup_lines == 3 and got[8].n_repeat_words == 3000
    assert rules.ledger(docs.limit(0)).count() == 0 and rules.ablations(rules.ledger(docs.limit(0))).where("n_kept <> 0").count() == 0


# 7. packing


def test_packing_places_every_piece(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cd\n") for _ in range(rng.randrange(0, 9000))) for _ in range(60)] + [None, ""]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.limit(1))
    rows = packing.pack_documents(docs).collect()
    assert sum(r.piece == 0 for r in rows) == len(texts) + 1
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.ids_crc32 == brute.crc_of(ids[r.start : r.start + r.length])
    assert len(held) >= -(-sum(r.length for r in rows) // 1024)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bound_holds(lengths):
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = len(lengths)
        for i in {rooms.index(r) for r in set(rooms) if r >= rest[0]}:
            best = min(best, fewest(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1 :]))
        return min(best, fewest(rest[1:], [*rooms, 30 - rest[0]]))

    bins, _ = packing.best_fit_decreasing(np.array(lengths, dtype=np.int64), 30)
    used = int(bins.max()) + 1 if lengths else 0
    least = fewest(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(np.bincount(np.array(lengths, dtype=np.int64), minlength=31), 30) <= least <= used


def test_repacking_over_partitions(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 1024) for _ in range(4000)]
    parts = spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long")
    placed, certificates = packing.place(parts, items_per_partition=300)
    rows, certs = placed.collect(), certificates.collect()
    assert len(rows) == 4000 == len({r.piece_key for r in rows})
    used = {r.sequence_id for r in rows}
    bound = packing.lower_bound(np.bincount(np.array(lengths), minlength=1025), 1024)
    assert bound <= len(used) <= 1.02 * bound
    first = [c for c in certs if c.turn == 0]
    assert sum(c.n_pieces for c in first) == 4000 and len(first) == 14 and all(c.sequences >= c.bound and c.certified == (c.sequences == c.bound) for c in certs)
    for c in certs:  # a certified partition is settled as it was packed
        own = [r for r in rows if r.sequence_id >> 28 == (c.turn << 30) + c.part]
        if c.certified:
            assert len(own) == c.n_pieces and len({r.sequence_id for r in own}) == c.sequences == c.bound and all(r.certified for r in own)
        else:
            assert len(own) <= c.n_pieces and not any(r.certified for r in own)


def test_partitions_exchange_until_certified(spark):
    """Halves and thirds of a sequence that one partition can't fill alone; a partition of equal halves is certified at once."""
    halves = spark.createDataFrame([(i, 512) for i in range(400)], "piece_key long, length long")
    placed, certificates = packing.place(halves, items_per_partition=64)
    assert placed.count() == 400 and all(c.sequences == c.bound and c.certified for c in certificates.collect())
    # three of 300, one of 420 and one of 690 in 1024: no partition meets its bound, so that all exchange until a turn gains nothing
    hard = spark.createDataFrame([(i, (300, 420, 690, 301, 333)[i % 5]) for i in range(500)], "piece_key long, length long")
    placed, certificates = packing.place(hard, items_per_partition=40)
    certs = certificates.collect()
    assert placed.count() == 500 and max(c.turn for c in certs) >= 1 and not all(c.certified for c in certs)
    large = spark.createDataFrame([(i, 600 + i % 3) for i in range(50)], "piece_key long, length long")
    placed, certificates = packing.place(large, items_per_partition=16)
    assert placed.select("sequence_id").distinct().count() == 50 and certificates.where("turn > 0 or not certified").count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = documents(spark, [f"some words {i} " * (i * 7 % 40) for i in range(120)]).selectExpr("concat('d', doc_id) as doc_id", "text")
    parts = packing.pieces(docs, capacity=64)
    placed, _ = packing.place(parts, capacity=64, items_per_partition=50)
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    texts = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = {d: [] for d in texts}
    for r in packing.sequences(parts, placed).collect():
        ids, at = np.frombuffer(bytes(r.ids), dtype="<u2").tolist(), 0
        assert len(ids) <= 64
        for p in r.pieces:
            assert p.offset == at
            got[p.doc_id].append((p.piece, ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert {d: [i for _, part in sorted(x) for i in part] for d, x in got.items()} == texts


# 8. decontamination


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_myers(pattern, text):
    got = decontaminate.myers(pattern, text, len(pattern))
    assert got[0] == brute.edit_in(pattern, text)


def test_planted_items(spark, sf_dir):
    rng = random.Random(5)
    items = [r for r in table(spark, sf_dir, "benchmark").collect() if r.text][:6]
    texts, want = [], set()
    for r in items:
        t = decontaminate.normalise(r.text)
        for edits in (0, decontaminate.budget(t), decontaminate.budget(t) * 3 + 4):
            s = list(t)
            for _ in range(edits):
                s[rng.randrange(len(s))] = rng.choice("0123456789")
            exact = brute.edit_in(t, "".join(s))
            if exact <= decontaminate.budget(t):
                want.add((len(texts), r.item_id, exact))
            texts.append("before it " + "".join(s) + " and after")
    docs = documents(spark, [*texts, None, "", "clean text"])
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, table(spark, sf_dir, "benchmark").where(f"item_id in ({', '.join(str(r.item_id) for r in items)})")).collect()}
    assert want <= found and len(want) >= len(items)
    left = {r.doc_id for r in decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).collect()}
    assert {len(texts), len(texts) + 1, len(texts) + 2} <= left and not left & {w[0] for w in want}
    assert decontaminate.matches(docs, table(spark, sf_dir, "benchmark").limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), table(spark, sf_dir, "benchmark")).count() == 0


def test_decontamination_matches_all_pairs(spark, sf_dir):
    """Every document against every item, by the distance to the whole text."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = items.unionByName(spark.createDataFrame([(900, "a"), (901, "the other"), (902, None), (903, "")], "item_id long, text string").select(F.col("item_id").cast(items.schema["item_id"].dataType), "text"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs, items).collect()}
    want = {}
    wanted = [(r.item_id, t) for r in items.collect() if r.text and len(t := decontaminate.normalise(r.text)) >= decontaminate.CHARS_PER_EDIT]
    for r in docs.collect():
        text = decontaminate.normalise(r.text)
        for item, t in wanted:
            found = decontaminate.myers(t, text, decontaminate.budget(t))
            if found:
                want[r.doc_id, item] = found[0]
    assert got == want and got
    left = {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


# 9. language


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = registry.QUERIES["op9_compression_language_id"](spark, sf_dir)
    assert got.count() == docs.count()
    both = got.where("held_out").join(docs.where("lang is not null and text is not null"), "doc_id")
    assert both.where("lang_pred = lang").count() >= 0.95 * both.count()


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, g, None, 0) for i, (t, g) in enumerate([("the weather around this house never stays quite the same", "en"), ("le temps autour de cette maison ne reste jamais pareil", "fr"), (None, "en"), ("123 !!", "fr"), ("", None), ("this house never stays quite the same around the weather", None)] * 3)], DOCS)
    found = language.identify(docs.withColumn("lang_score", docs["text"]), language.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:6]] == ["en", "fr", "und", "und", "und", "en"] and all(0 <= r.lang_score <= 1 for r in found)
    assert [r.lang_pred for r in language.identify(docs, language.train(docs.limit(0))).collect()] == ["und"] * 18
    assert language.identify(docs.limit(0), []).count() == 0


def test_language_has_letters():
    assert [language.has_letter(t) for t in (None, "", "12 \u00bd \u00b2 \u2167 _ !", "\u2460 \u0661", "1a", "\u4e2d", "\u00aa", "\u0431")] == [False] * 4 + [True] * 4


def test_language_compresses_whole_texts(spark, sf_dir):
    """Against a plain compressor that takes one text at a time, and all of it."""
    import zstandard

    docs = table(spark, sf_dir, "documents").unionByName(documents(spark, ["\u00bd \u00b2 \u2167", "the house " * 5000 + "le temps " * 9000, None]).withColumn("doc_id", F.col("doc_id") - 9).select(*table(spark, sf_dir, "documents").columns), allowMissingColumns=True)
    learned = language.train(table(spark, sf_dir, "documents"))
    how = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_LAZY, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    by_lang = {g: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for g, d in learned}
    for r in language.identify(docs, learned).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.lang_rejected) == ("und", True)
            continue
        raw = r.text.lower().encode()
        cost = {g: sum(len(c.compress(raw[k : k + language.CHUNK])) for k in range(0, len(raw), language.CHUNK)) for g, c in by_lang.items()}
        assert r.lang_pred == min(cost, key=lambda g: (cost[g], [n for n, _ in learned].index(g)))
        low, second = sorted(cost.values())[:2]
        assert r.lang_rejected == (second - low < 2)


def test_language_learns_every_label(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)) for _ in range(70)]
    docs = spark.createDataFrame([(i, t, f"l{i:02}", None, len(t)) for i, t in enumerate(texts)], DOCS)
    assert len(language.train(docs)) == 70
    found = lambda: [(r.lang, r.lang_pred, r.lang_score, r.lang_rejected) for r in language.identify(docs, language.train(docs)).orderBy("doc_id").collect()]
    got = found()
    assert all(lang == pred for lang, pred, _, _ in got)
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 100)
    assert found() == got


# 10. near duplicates


def variants(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "shingles"), [(512, dedup.BLOCK_SHINGLES), (8, dedup.BLOCK_SHINGLES), (512, 400)])
def test_components_match_all_pairs(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", shingles)
    texts = dict(enumerate([*ODD, None, *variants(1, 40), *variants(2, 25), *variants(3, 3), *["same text here for all of them"] * 20]))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, block=block).collect()}
    assert got == brute.components(texts)


def test_dedup_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string").withColumn("print", F.lit(1))
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    assert dedup.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \tC\u00e9\n", max_size=60), min_size=1, max_size=5))
def test_shingles_count_as_the_plain_ones(texts):
    got = shingle_sets(pa.array(texts, pa.string()))
    plain = [brute.shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in plain]
    for a, p in zip(got, plain, strict=True):
        for b, q in zip(got, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)])) for _ in range(2))
    s = sketches([a, b, a[:3], np.zeros(0, dtype=np.uint64)], 500)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.06 and (s[2] != np.uint64(2**64 - 1)).all()
    assert bands(s, 5).shape == (4, 100)


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= docs.count()
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


@pytest.fixture(scope="module")
def odd_documents(spark, sf_dir):
    """All documents of the table and rows that are awkward: nulls, repeated rows, ids with several texts, empty and very long texts."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("length(text) > 400").orderBy("doc_id").limit(3).collect()
    more = [
        (None, first[0].text, "en", None, 5), (first[1].doc_id, first[1].text, first[1].lang, first[1].source, first[1].n_chars), (first[1].doc_id, first[1].text, None, "other", None),
        (first[2].doc_id, "an unlike text that stands under the same id as a longer one and stays", "en", None, 9), (first[2].doc_id, first[0].text, "en", "moved", 9),
        (50_000, None, None, None, None), (50_000, None, None, None, None), (50_001, "", "en", "s", 0), (50_002, "\u00bd 12 !", "en", "s", 6), (50_003, "the house " * 20_000, "en", "s", 1),
    ]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def _stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stage_language(spark, odd_documents, sf_dir):
    import zstandard

    learned = language.train(odd_documents.where(~language.held_out()))
    how = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_LAZY, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    by_lang = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for _, d in learned]

    def kept(text):
        if not any(c.isalpha() for c in text or ""):
            return False
        raw = text.lower().encode()
        low, second = sorted(sum(len(c.compress(raw[k : k + 8192])) for k in range(0, len(raw), 8192)) for c in by_lang)[:2]
        return second - low >= 2

    assert _rows(_stage("language")(spark, odd_documents, sf_dir)) == sorted((tuple(r) for r in odd_documents.collect() if kept(r.text)), key=str)


@pytest.mark.parametrize("bound", [dedup.BROADCAST_GONE, 0])
def test_stage_near_copies(spark, odd_documents, sf_dir, monkeypatch, bound):
    monkeypatch.setattr(dedup, "BROADCAST_GONE", bound)
    rows = odd_documents.collect()
    group = brute.components({i: r.text for i, r in enumerate(rows) if r.doc_id is not None})
    parts = {}
    for i, (n, root) in group.items():
        parts.setdefault(root if n else ("none", i), []).append(i)
    got = _rows(_stage("near_copies")(spark, odd_documents, sf_dir))
    free = [tuple(rows[i]) for x in parts.values() if len(x) == 1 for i in x] + [tuple(r) for r in rows if r.doc_id is None]
    rest = list(got)
    for r in free:
        rest.remove(r)
    for members in (x for x in parts.values() if len(x) > 1):
        least = min(rows[i].doc_id for i in members)
        stays = [r for r in rest if r in [tuple(rows[i]) for i in members]]
        assert len(stays) == 1 and stays[0][0] == least
        rest.remove(stays[0])
    assert not rest


def test_stage_benchmark_passages(spark, odd_documents, sf_dir):
    items = [decontaminate.normalise(r.text) for r in table(spark, sf_dir, "benchmark").collect()]

    def clean(text):
        text = decontaminate.normalise(text)
        return not any(decontaminate.myers(t, text, decontaminate.budget(t)) for t in items if len(t) >= 16)

    short = odd_documents.where("coalesce(length(text), 0) < 3000")
    assert _rows(_stage("benchmark_passages")(spark, short, sf_dir)) == sorted((tuple(r) for r in short.collect() if clean(r.text)), key=str)


def test_stage_personal_data(spark, odd_documents, sf_dir):
    got = _stage("personal_data")(spark, odd_documents, sf_dir).collect()
    known = {r.term: r for r in pii.disclosing_terms(odd_documents).collect()}
    want = []
    for r in odd_documents.collect():
        text = r.text
        if text is not None:
            spans = [(a, b, f"[{k.upper()}]") for k, a, b in brute.personal(text)]
            for m in pii.re.finditer(r"[^\W\d_]{3,}", text):
                t = known.get(m[0].lower())
                if t and not any(a < m.end() and m.start() < b for a, b, _ in spans if _[1:-1] in ("EMAIL", "IP", "CARD", "PHONE")):
                    spans.append((*m.span(), "" if t.remove else f"[{t.kind.upper()}-TERM]"))
            out, at = "", 0
            for a, b, mark in sorted(spans, key=lambda s: (s[0], ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"].index(s[2]) if s[2] in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]") else 4)):
                if b > at:
                    out += text[at : max(a, at)] + mark
                    at = b
            text = out + text[at:]
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_stage_packing(spark, odd_documents, sf_dir):
    got = _stage("packing")(spark, odd_documents, sf_dir).collect()
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = []
    for r in odd_documents.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(r.doc_id, k, a, b - a, brute.crc_of(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]  # noqa: B905
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_stages_take_empty_tables_and_clashing_names(spark, odd_documents, sf_dir):
    import corpus_pipeline

    clash = odd_documents.limit(40).withColumns({c: F.lit("x") for c in ("print", "pii_spans", "lang_pred", "kept", "node", "_h", "certified")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_documents.limit(0), sf_dir).count() == 0, name
        out = stage(spark, clash.select(*odd_documents.columns, "print", "lang_pred", "kept", "node", "certified"), sf_dir)
        assert out.columns[:5] == odd_documents.columns and 0 < out.count() <= 40, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd_documents.limit(0), sf_dir).count() == 0


def test_scratch_tables_are_deleted(spark, sf_dir):
    from quillon.llm.common import materialise, scratch_root, workspace

    held = lambda: set(os.listdir(scratch_root(spark)))
    before = held()
    with workspace(spark) as keep:
        a, b = materialise(spark.range(5), "a"), materialise(spark.range(5), "b")
        with workspace(spark) as inner:
            c, d = materialise(spark.range(5), "c"), materialise(spark.range(5), "d")
            inner(d)
        assert len(held() - before) == 3
        keep(b, d)
    assert len(held() - before) == 2 and b.count() + d.count() == 10
    import corpus_pipeline

    before = held()
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(held() - before) == 1 and out.count() > 0
