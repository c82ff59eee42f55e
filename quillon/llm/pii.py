"""Personal data: exact patterns, and terms that disclose the entities found.

Patterns find the protected entities. Over the whole corpus, terms that stand near an entity are counted; a term t
discloses an entity c to the degree PMI(c; t) / IC(c), with IC(c) = -log2 p(c) and PMI(c; t) = IC(c) + log2 p(c | t), where
p(c | t) is the share of the lines with t that hold c near it. Every pair that met is scored, however rare. The share is
drawn towards p(c) with the weight of one observation, against the different contexts in which the two met: copies of one
line are one observation, and a pair met once counts as about half certain. Terms beyond the lower threshold are
generalised to the entity's kind, those beyond the upper one removed.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialise, small_batches, table, workspace
from quillon.llm.graphs import join_groups

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of span lists: the base, then what the method adds.
ORDER = {k: i for i, k in enumerate((*KINDS, "term"))}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

#: Words on each side of an entity that make its context; most terms that a worker holds at once; a word with more than one
#: in so many of all counts is frequent.
CONTEXT_WORDS, BLOCK_TERMS, FREQUENT = 16, 200_000, 10_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: a match holds one "@"; its local part is the run of local characters before that."""
    low = 0
    at = text.find("@")
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", max(low, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _words(text: str) -> list[str]:
    """The terms of a text in lower case. Each is lowered by itself, after it is found: lowering can change a text's length."""
    return [w.lower() for w in _TERM.findall(text)]


def contexts(text: str | None) -> Iterator[tuple[str, int, str, int]]:
    """(entity, hash of its context, term, lines) for each distinct term near each entity; a row with the term "" for the entity itself.

    A context is the CONTEXT_WORDS terms of the line on each side, however long they are. lines is 1 where the two meet in
    a line for the first time, else 0. A line's terms are found once, whatever the number of its entities.
    """
    met: set[tuple[int, str, str]] = set()
    begin, end, words, starts, ends = 0, -1, [], [], []
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1:]):
        if a > end:
            begin, end = text.rfind("\n", 0, a) + 1, text.find("\n", a)
            end = len(text) if end < 0 else end
            found = list(_TERM.finditer(text, begin, end))
            words, starts, ends = [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]
        entity = f"{kind}:{text[a:b].lower()}"
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        before, after = words[max(0, left - CONTEXT_WORDS) : left], words[right : right + CONTEXT_WORDS]
        mark = int.from_bytes(hashlib.blake2b(" ".join([*before, "|", *after]).encode(), digest_size=8).digest(), "big", signed=True)
        for term in ("", *dict.fromkeys(before + after)):
            new = (begin, entity, term) not in met
            met.add((begin, entity, term))
            yield entity, mark, term, int(new)


def _line_terms(text: str) -> Iterator[set[str]]:
    if text.isascii():
        for line in text.lower().split("\n"):
            yield set(_TERM.findall(line))
    else:
        for line in text.split("\n"):
            yield set(_words(line))


def word_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_term): how many lines hold each term. Every task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        out = lambda: pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    for terms in _line_terms(t):
                        found.update(terms)
                if len(found) >= BLOCK_TERMS:
                    yield out()
                    found.clear()
        yield out()

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, *, text_col: str = "text", prior_weight: float = 1.0, generalise_at: float = 0.9, remove_at: float = 0.97) -> DataFrame:
    """(term, kind, disclosure, remove): terms beyond a threshold, with the kind of the entity that they disclose most."""
    spark = docs.sparkSession
    small_batches(spark)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, str, int]] = []
            lines = 0
            for t in batch.column(0).to_pylist():
                rows += contexts(t)
                lines += t.count("\n") + 1 if t else 0
            rows.append(("", 0, "", lines))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["entity", "mark", "term", "n"])

    met = materialise(docs.select(text_col).mapInArrow(near, "entity string, mark long, term string, n long"), "contexts")
    lines = met.where("entity = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_context = met.where("entity <> ''").groupBy("entity", "term", "mark").agg(F.sum("n").alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_both"))
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], "term string, kind string, disclosure double, remove boolean")

    n_pairs = pairs.count()
    by_entity = pairs.groupBy("entity").agg(F.count("*").alias("n"), F.max(F.when(F.col("term") == "", F.col("n_both"))).alias("n_entity"))
    by_term = pairs.where("term <> ''").groupBy("term").agg(F.count("*").alias("n")).join(word_lines(docs, text_col), "term")
    share = F.col("n_both") / F.greatest("n_term", "n_both")
    base = F.col("n_entity") / F.lit(float(max(lines, 1) + 1))
    seen = F.least("contexts", "n_both")  # neither copies of a line nor repeats within one are observations of their own
    p = (seen * share + prior_weight * base) / (seen + prior_weight)
    ic = -F.log2(base)
    # an entity that stands near very many terms, and a term near very many entities, are hot keys
    both = join_groups(join_groups(pairs.where("term <> ''"), by_entity, "entity", n_pairs), materialise(by_term, "term-lines"), "term", n_pairs)
    scored = both.select("term", F.substring_index("entity", ":", 1).alias("kind"), ((ic + F.log2(p)) / ic).alias("disclosure"))
    best = scored.where(F.col("disclosure") >= generalise_at).groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("m"))
    return best.select("term", "m.kind", "m.disclosure", (F.col("m.disclosure") >= remove_at).alias("remove"))


def all_spans(text: str | None, terms: dict[str, tuple[str, bool]]) -> list[tuple[str, int, int]]:
    """Base spans and, outside of them, the spans of disclosing terms."""
    found = base_spans(text)
    if text and terms:
        taken = sorted((a, b) for _, a, b in found)
        if not terms.keys().isdisjoint(_TERM.findall(text.lower()) if text.isascii() else _words(text)):
            k = 0
            for m in _TERM.finditer(text):
                if m[0].lower() in terms:
                    while k < len(taken) and taken[k][1] <= m.start():
                        k += 1
                    if k == len(taken) or taken[k][0] >= m.end():
                        found.append(("term", *m.span()))
    return found


def redact(text: str | None, spans: list[tuple[str, int, int]], terms: dict[str, tuple[str, bool]]) -> str | None:
    """The text with entities replaced by their kind, and disclosing terms generalised to the kind that they disclose or removed."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        else:
            of, remove = terms[text[a:b].lower()]
            out.append("" if remove else f"[{of.upper()}-TERM]")
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """docs with the sanitised text in text_col, and pii_spans: kind:start:end in code points of the given text, by kind and start.

    Null texts stay null and have no spans; other columns are kept (a column pii_spans is replaced). Up to BLOCK_TERMS terms
    go to every worker; more are joined to the words of the texts, so that a text meets its own terms only. Both give the
    same result from one pass over the texts given.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pii_spans")
    at, names = docs.columns.index(text_col), docs.columns
    everywhere: dict[str, tuple[str, bool]] = {}
    with workspace(docs.sparkSession) as keep:
        terms = materialise(disclosing_terms(docs, text_col=text_col) if terms is None else terms, "disclosing")
        if terms.count() <= BLOCK_TERMS:
            everywhere = {r.term: (r.kind, r.remove) for r in terms.collect()}
            given = docs.withColumn("_pii_rules", F.lit(None).cast("string"))
        else:
            lines = materialise(word_lines(docs, text_col), "words")
            given = _with_own_terms(docs, text_col, terms, lines)
            keep(terms, lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)[:-1]
            rules = [everywhere if own is None else {t: (kind, remove == "true") for t, (kind, remove) in json.loads(own).items()} for own in batch.column(len(names)).to_pylist()]
            spans = [all_spans(t, own) for t, own in zip(texts, rules, strict=True)]
            columns[at] = pa.array([redact(t, s, own) for t, s, own in zip(texts, spans, rules, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([span_list(s) for s in spans], pa.string())], names=[*names, "pii_spans"])

    return given.select(*names, "_pii_rules").mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii_spans", T.StringType())]))


def _with_own_terms(docs: DataFrame, text_col: str, terms: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with _pii_rules: the terms that their text holds, as JSON. lines: what word_lines returns.

    Texts are known by two hashes. Of words that are a good part of all words, the join gets only those that are terms:
    there are fewer than FREQUENT such words, and they are known to every worker.
    """
    total = lines.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    frequent = lines.where(F.col("n_term") > max(total // FREQUENT, 1))
    idle = {r.term for r in frequent.join(terms, "term", "left_anti").select("term").collect()}
    counted = terms.join(lines, "term").select("term", F.to_json(F.map_from_entries(F.array(F.struct("term", F.array("kind", F.col("remove").cast("string")))))).alias("rule"), "n_term")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[w for w in dict.fromkeys(_words(t)) if w not in idle] if t else [] for t in batch.column(2).to_pylist()]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array([w for f in found for w in f], pa.string())], names=["_a", "_b", "term"])

    hashes = {"_a": F.xxhash64(text_col), "_b": F.xxhash64(F.lit(1), text_col)}
    held = docs.withColumns(hashes).select("_a", "_b", text_col).mapInArrow(words, "_a long, _b long, term string")
    own = join_groups(held, counted, "term", total, "n_term").groupBy("_a", "_b").agg(F.collect_set("rule").alias("rules"))
    own = own.select("_a", "_b", F.concat(F.lit("{"), F.array_join(F.transform("rules", lambda r: r.substr(F.lit(2), F.length(r) - 2)), ","), F.lit("}")).alias("_pii_rules"))
    return docs.withColumns(hashes).join(own, ["_a", "_b"], "left").withColumn("_pii_rules", F.coalesce("_pii_rules", F.lit("{}")))


def span_list(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op1_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.split("pii_spans", ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.filter(spans, lambda s: ~s.startswith("term:")), ",")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))


QUERIES = {"op1_disclosure_pii": op1_disclosure_pii}
ORACLES: dict[str, str] = {}
