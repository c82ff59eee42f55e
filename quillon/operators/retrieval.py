"""Hybrid retrieval: exact vector neighbours, lexical scores, rank fusion; sections and chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.functions.conventions import safe_ratio
from quillon.functions.ordered import flag_in_order

#: Rank fusion constant, and chunk sizes in tokens of four characters (fixed values).
RRF_K, CHUNK_TOKENS, OVERLAP_TOKENS, BACK_CHARS = 60, 1024, 128, 64
SECTION_TOKENS, CSV_ROWS, MAX_DEPTH = 4096, 50, 8


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of floats, summed as doubles; null where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return safe_ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows most like one query vector, by exact cosine; a scan and a top-k of k rows a task."""
    sim = F.round(cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query))), 6)
    return vectors.withColumn("similarity", sim).where("similarity is not null").orderBy(F.desc("similarity"), id_col).limit(k)


def best_per_group(hits: DataFrame, group: str, order: list[Column], most: int = 2) -> DataFrame:
    """The first rows of each group."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def tokens_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: str, fields: dict[str, float], *, id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents that hold a query term, weighted by field. One pass counts the few query terms' documents; no index of all terms is built."""
    terms = sorted(set(query.lower().split()))
    # fields are cut into words once; what is counted afterwards are the few that are query terms
    words = docs.select(id_col, *(tokens_of(F.col(f)).alias(f"_w{i}") for i, f in enumerate(fields)))
    hit = lambda i: F.filter(F.col(f"_w{i}"), lambda w: w.isin(terms)).alias(f"_h{i}")
    hits = words.select(id_col, sum((F.size(f"_w{i}") for i in range(len(fields))), F.lit(0)).alias("_len"), *(hit(i) for i in range(len(fields))))
    count = lambda i, t: F.size(F.filter(F.col(f"_h{i}"), lambda w: w == t))
    scored = hits.select(id_col, "_len", *(sum((count(i, t) * w for i, w in enumerate(fields.values())), F.lit(0.0)).alias(f"_t{k}") for k, t in enumerate(terms)))
    stats = scored.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *(F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    s = scored.where(" or ".join(f"_t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    part = lambda i: F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)) * F.col(f"_t{i}") * (k1 + 1) / (F.col(f"_t{i}") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return s.select(id_col, F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), 6).alias("score"))


def ranked(hits: DataFrame, order: list[Column], pool: int) -> DataFrame:
    """The first `pool` hits with their rank; numbered only after the limit, so that the one task holds `pool` rows."""
    return hits.orderBy(*order).limit(pool).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(vector: DataFrame, lexical: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """(keys, vec_rank, bm25_rank, score): reciprocal-rank fusion of two ranked pools over a null-safe full outer join."""
    v = vector.select(*(F.col(c).alias(f"v_{c}") for c in keys), F.col("rank").alias("vec_rank")).alias("v")
    x = lexical.select(*(F.col(c).alias(f"x_{c}") for c in keys), F.col("rank").alias("bm25_rank")).alias("x")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"v_{c}").eqNullSafe(F.col(f"x_{c}"))
    score = F.coalesce(1 / (k + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("bm25_rank")), F.lit(0.0))
    return v.join(x, on, "full").select(*(F.coalesce(f"v_{c}", f"x_{c}").alias(c) for c in keys), "vec_rank", "bm25_rank", F.round(score, 9).alias("score"))


def keep_relevant(hits: DataFrame, least: float = 0.3) -> DataFrame:
    """Lexical hits stay whatever their similarity; others need the least one."""
    return hits.where(F.col("bm25_rank").isNotNull() | (F.col("similarity") >= least))


#: Query vectors that are compared in one pass over the pending ones.
QUERY_BLOCK = 2048

#: Pending vectors that are compared with a block at once, and characters of texts that are cut into sections at once.
COMPARED, CUT_CHARS = 512, 1 << 20


def near_pending(new: DataFrame, pending: DataFrame, at: float = 0.85, *, id_col: str = "vec_id", vec_col: str = "embedding", scope: str = "label") -> DataFrame:
    """(id, nearest, similarity, is_duplicate): each new vector's most similar pending one of its scope (ties: the least id); new ones without any are left out.

    New vectors are taken in blocks of about QUERY_BLOCK; every pass scans the pending ones and each task returns at most
    one row for each query, so that no pairs are built.
    """
    spark = new.sparkSession
    n = -(-new.count() // QUERY_BLOCK)
    found = None
    for k in range(n):
        rows = new.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == k).select(id_col, scope, vec_col).where(F.col(vec_col).isNotNull()).collect()
        if not rows:
            continue
        ids, scopes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        q = np.array([r[2] for r in rows], dtype=np.float64)
        q /= np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)

        def scan(batches: Iterator[pd.DataFrame], ids=ids, scopes=scopes, q=q) -> Iterator[pd.DataFrame]:
            best, who = np.full(len(ids), -2.0), np.zeros(len(ids), dtype=np.int64)
            for pdf in (whole.iloc[k : k + COMPARED] for whole in batches for k in range(0, len(whole), COMPARED)):
                pdf = pdf.dropna()
                if not len(pdf):
                    continue
                v = np.array(pdf[vec_col].tolist(), dtype=np.float64)
                v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
                other = pdf[id_col].to_numpy()
                sim = np.round(q @ v.T, 6)
                sim[(scopes[:, None] != pdf[scope].to_numpy()[None, :]) | (ids[:, None] == other[None, :])] = -2.0
                order = np.argsort(other, kind="stable")
                j = order[sim[:, order].argmax(axis=1)]
                s = sim[np.arange(len(ids)), j]
                better = (s > best) | ((s == best) & (other[j] < who))
                best, who = np.where(better, s, best), np.where(better, other[j], who)
            seen = best > -2
            yield pd.DataFrame({"q": ids[seen], "s": best[seen], "n": who[seen]})

        one = pending.select(id_col, scope, vec_col).mapInPandas(scan, "q long, s double, n long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "q long, s double, n long")
    best = found.groupBy("q").agg(F.max(F.struct("s", (-F.col("n")).alias("n"))).alias("m"))
    return best.select(F.col("q").alias(id_col), (-F.col("m.n")).alias("nearest"), F.col("m.s").alias("similarity"), (F.col("m.s") >= at).alias("is_duplicate"))


_HEADING, _CAPITALS, _RULE = re.compile(r"#{1,6}\s+(\S.*)"), re.compile(r"[^a-z]*[A-Z]{5}[^a-z]*"), re.compile(r"-{3,}\s*")


def split_at_headings(text: str, level: int = 1) -> list[tuple[str, str]]:
    """(title, text) cut at markdown headings of `level` or deeper, lines of capitals (5 letters or more) and rules."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        m = _HEADING.fullmatch(line)
        if m and len(line) - len(line.lstrip("#")) >= level:
            out.append((m[1].strip(), []))
        elif not m and (_CAPITALS.fullmatch(line) or _RULE.fullmatch(line)):
            out.append(("" if _RULE.fullmatch(line) else line.strip(), []))
        else:
            out[-1][1].append(line)
    found = [(title, "\n".join(body)) for title, body in out]
    return found if found[0][1] or len(found) == 1 else found[1:]


def _capped(title: str, text: str, depth: int) -> Iterator[tuple[str, str, bool]]:
    if len(text) <= 4 * SECTION_TOKENS:
        yield title, text, False
        return
    parts = split_at_headings(text, depth + 1) if depth < MAX_DEPTH else []
    if len(parts) > 1:
        for t, body in parts:
            yield from _capped(t or title, body, depth + 1)
    else:
        yield title, text, True


def heading_sections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, title, text, truncated): sections at headings; one of more than SECTION_TOKENS is cut at its sub-headings, and where there are none it stays whole and is marked as truncated: its chunks stand for it. Null texts have no section."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                if text is None:
                    continue
                i = batch.column(0)[at].as_py()
                rows += [(i, k, *x) for k, x in enumerate(x for title, body in split_at_headings(text) for x in _capped(title, body, 1))]
                held += len(text)
                if held >= CUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    kind = docs.schema[id_col].dataType
    names = [T.StructField(id_col, kind), T.StructField("section", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("truncated", T.BooleanType())]
    out = to_arrow_schema(T.StructType(names))
    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(names))


def csv_batches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = CSV_ROWS) -> DataFrame:
    """(id, section, title, text): lines after the header in batches, each under the header; title "Rows a-b"."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x != "")
    n = F.size("_l") - 1
    cut = docs.select(id_col, lines.alias("_l")).where("size(_l) > 1").select(id_col, "_l", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / rows).cast("int"))).alias("section"))
    part = F.slice("_l", F.col("section") * rows + 2, rows)
    return cut.select(id_col, "section", F.concat(F.lit("Rows "), (F.col("section") * rows + 1).cast("string"), F.lit("-"), F.least((F.col("section") + 1) * rows, n).cast("string")).alias("title"), F.concat(F.get("_l", F.lit(0)), F.lit("\n"), F.array_join(part, "\n")).alias("text"))


def chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4 * CHUNK_TOKENS, overlap: int = 4 * OVERLAP_TOKENS, back: int = BACK_CHARS) -> DataFrame:
    """(id, chunk, start, text): windows of at most `size` characters that overlap; a window ends at white space up to `back` characters before its edge if there is one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / (size - overlap)).cast("int") - 1))
    cut = docs.select(id_col, text.alias("_t"), F.explode(starts).alias("chunk")).where("_t <> ''").withColumn("start", (F.col("chunk") * (size - overlap)).cast("long"))
    window = F.substr(F.col("_t"), (F.col("start") + 1).cast("int"), F.lit(size))
    trimmed = F.regexp_replace(window, r"(?s)\s\S{0,%d}\z" % (back - 1), "")
    at_end = F.col("start") + size >= F.length("_t")
    return cut.select(id_col, "chunk", "start", F.when(at_end, window).otherwise(trimmed).alias("text"))


def within_budget(hits: DataFrame, keys: list[str], order: list[str], cost: str, budget: int = 24_000) -> DataFrame:
    """hits with kept: greedy in order; a hit over what is left is skipped and later ones are tried; the first always stays. Hits of a key are streamed; what is held is the cost so far."""

    def step(used: int | None, cost: int) -> tuple[int, bool]:
        fits = used is None or used + cost <= budget
        return (used or 0) + (cost if fits else 0), fits

    return flag_in_order(hits, keys, order, [cost], step, "kept")


def expand_checklist(hits: DataFrame, steps: DataFrame) -> DataFrame:
    """(checklist_id, text): of step hits the checklist with most hits, then the best score, as one ordered list of its steps."""
    best = hits.groupBy("checklist_id").agg(F.count("*").alias("n"), F.max("score").alias("s")).orderBy(F.desc("n"), F.desc("s"), "checklist_id").limit(1)
    listed = steps.join(F.broadcast(best.select("checklist_id")), "checklist_id").groupBy("checklist_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("h"))
    return listed.select("checklist_id", F.array_join(F.transform("h", lambda x: F.concat(x["number"].cast("string"), F.lit(". "), x["text"])), "\n").alias("text"))


def split_thread(messages: DataFrame, *, longer_than: int = 40, keep: int = 20) -> DataFrame:
    """messages with to_summary: in threads of more than `longer_than` all but the last `keep`."""
    w = Window.partitionBy("conv_id")
    return messages.withColumn("to_summary", (F.count("*").over(w) > longer_than) & (F.row_number().over(w.orderBy(F.desc("turn"))) > keep))


def find(recalled: list[DataFrame], *, limit: int, least: float = 0.3, most: int = 50) -> DataFrame:
    """(id, similarity, bm25_rank, path, weak): what several recall paths found, each row once, by similarity then id.

    Paths (id, similarity, bm25_rank) are numbered from 0 and united; of an id the most similar row counts, then the first
    path. The limit is clamped to 1..most; twice as many are fetched before the relevance filter. weak marks a result
    whose best row lies under the least similarity.
    """
    limit = min(max(int(limit), 1), most)
    union = None
    for k, one in enumerate(recalled):
        one = one.select("id", "similarity", "bm25_rank", F.lit(k).alias("path"))
        union = one if union is None else union.unionByName(one)
    best = union.groupBy("id").agg(F.max_by(F.struct("similarity", "path"), F.struct(F.coalesce("similarity", F.lit(-2.0)), -F.col("path"))).alias("m"), F.min("bm25_rank").alias("bm25_rank"))
    flat = best.select("id", "m.similarity", "bm25_rank", "m.path")
    order = [F.desc_nulls_last("similarity"), F.asc("id")]
    fetched = flat.orderBy(*order).limit(2 * limit)
    top = fetched.agg(F.coalesce(F.max("similarity") < least, F.lit(True)).alias("weak"))
    return keep_relevant(fetched, least).orderBy(*order).limit(limit).crossJoin(F.broadcast(top))  # one row


#: Chunks of the pool, sections kept of an entity, and entities recalled by their own vector (fixed values).
CHUNK_POOL, TOP_SECTIONS, CANDIDATES = 200, 2, 50


def vector_paths(
    chunks: DataFrame, entities: DataFrame, query: list[float], *,
    pool: int = CHUNK_POOL, sections: int = TOP_SECTIONS, candidates: int = CANDIDATES,
) -> DataFrame:
    """(entity, section, similarity, path, rank): what three vector paths recall for one query.

    chunks (chunk, entity, section, embedding) give the pool of nearest chunks, and of each entity its best sections. Entities
    (entity, chunked, embedding) without chunks by design come by their own vector; so do those that have chunks, but none in
    the pool, so that an entity with very many chunks can't hide the others. Ranks count over all paths.
    """
    near = nearest(chunks, query, pool, id_col="chunk").groupBy("entity", "section").agg(F.max("similarity").alias("similarity"))
    hits = best_per_group(near, "entity", [F.desc("similarity"), F.col("section")], sections)
    seen = hits.select("entity").distinct()
    own = lambda rows: nearest(rows, query, candidates, id_col="entity")
    plain, missed = own(entities.where(~F.col("chunked"))), own(entities.where("chunked").join(F.broadcast(seen), "entity", "left_anti"))
    none = F.lit(None).cast(chunks.schema["section"].dataType).alias("section")
    rows = hits.select("entity", "section", "similarity", F.lit("chunks").alias("path"))
    for found, path in ((plain, "entities"), (missed, "fallback")):
        rows = rows.unionByName(found.select("entity", none, "similarity", F.lit(path).alias("path")))
    order = [F.desc("similarity"), "entity", F.col("section").asc_nulls_first()]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a few hundred rows


def best_section(hits: DataFrame, matched: DataFrame, sections: DataFrame) -> DataFrame:
    """hits (id, ...) with section_id: the nearest of the id's matched sections (id, section_id, dist), else its first section (id, section_id, position), else null. Each side is reduced to a row for an id before it is joined."""
    near = matched.groupBy("id").agg(F.min_by("section_id", F.struct("dist", "section_id")).alias("_near"))
    first = sections.groupBy("id").agg(F.min_by("section_id", F.struct("position", "section_id")).alias("_first"))
    return hits.join(near, "id", "left").join(first, "id", "left").withColumn("section_id", F.coalesce("_near", "_first")).drop("_near", "_first")
