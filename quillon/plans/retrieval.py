"""Queries of schemaless tables and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import retrieval as r
from quillon.operators import tabular
from quillon.operators.postings import TextIndex
from quillon.operators.vector_index import VectorIndex
from quillon.sources.store import shared_folder
from quillon.sources.views import MESSAGES, messages, table

#: A fixed query vector of the embeddings' width, and query words.
QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
QUERY_TEXT = "the and thing"


def _sheet(s: SparkSession, p: str) -> DataFrame:
    """Parts as rows of text cells, prices with a currency sign."""
    cells = {"Name": F.col("p_name"), "Type": F.col("p_type"), "Unit_Price": F.concat(F.lit("£"), F.format_number("p_retailprice", 2)), "size": F.col("p_size").cast("string")}
    data = F.create_map(*(x for k, v in cells.items() for x in (F.lit(k), v)))
    return table(s, p, "part").select(F.lit("parts").alias("doc_id"), F.col("p_partkey").alias("row_index"), data.alias("data"))


TYPES = {"Name": "string", "Type": "string", "Unit_Price": "number", "size": "number"}


def _run(s: SparkSession, p: str, query: tabular.Query) -> DataFrame:
    return tabular.run(_sheet(s, p), TYPES, query)[0]


def _legs(s: SparkSession, p: str) -> tuple[DataFrame, DataFrame]:
    v = r.nearest(table(s, p, "embeddings"), QUERY_VECTOR, 60).select(F.col("vec_id").alias("id"), "similarity")
    x = r.bm25(table(s, p, "documents"), QUERY_TEXT, {"text": 1.0, "source": 0.5}, id_col="doc_id").withColumnRenamed("doc_id", "id")
    return r.ranked(v, [F.desc("similarity"), F.col("id")], 60), r.ranked(x, [F.desc("score"), F.col("id")], 60)


def fused(s: SparkSession, p: str) -> DataFrame:
    vector, lexical = _legs(s, p)
    return r.fuse(vector, lexical, ["id"])


def token_budget(s: SparkSession, p: str) -> DataFrame:
    hits = messages(s, p).select("conv_id", "turn", F.ceil(F.length("text") / 4).cast("long").alias("cost"))
    return r.within_budget(hits, ["conv_id"], ["turn"], "cost", 150)


def found(s: SparkSession, p: str) -> DataFrame:
    """The union of three recall paths: the nearest of all vectors, of those with label 1, and the lexical hits."""
    vectors = table(s, p, "embeddings")
    none = F.lit(None).cast("int").alias("bm25_rank")
    paths = [r.nearest(v, QUERY_VECTOR, 40).select(F.col("vec_id").alias("id"), "similarity", none) for v in (vectors, vectors.where("label = 1"))]
    lexical = r.ranked(r.bm25(table(s, p, "documents"), QUERY_TEXT, {"text": 1.0}, id_col="doc_id").withColumnRenamed("doc_id", "id"), [F.desc("score"), F.col("id")], 40)
    return r.find([*paths, lexical.select("id", F.lit(None).cast("double").alias("similarity"), F.col("rank").alias("bm25_rank"))], limit=30)


def _index(s: SparkSession, p: str) -> VectorIndex:
    return VectorIndex.build(table(s, p, "embeddings"), shared_folder(s, "vectors"))


def vector_neighbours(s: SparkSession, p: str) -> DataFrame:
    """The ten nearest of all vectors to every twentieth one, through the index with all cells probed: exact."""
    index = _index(s, p)
    return index.search(table(s, p, "embeddings").where("vec_id % 20 = 0"), 10, probes=max(1, len(index.centre)))


def vector_index_recall(s: SparkSession, p: str) -> DataFrame:
    """For every twentieth vector how many of its ten nearest the index finds with the probes that its own measurement asks for."""
    index = _index(s, p)
    asked = table(s, p, "embeddings").where("vec_id % 20 = 0")
    true = index.search(asked, 10, probes=max(1, len(index.centre))).select("query", "id")
    found = index.search(asked, 10, recall=0.95).select("query", "id", F.lit(1).alias("hit"))
    counts = true.join(found, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    return counts.select(
        F.col("query").alias("vec_id"), "neighbours", "found", (F.col("found") / F.col("neighbours")).alias("recall"),
        F.lit(len(index.centre)).alias("cells"), F.lit(index.probes_for(0.95)).alias("probes"),
    )


def vector_paths(s: SparkSession, p: str) -> DataFrame:
    """Six vectors stand for the chunks of an entity, two for a section; the first is the entity's own. Every third entity has no chunks."""
    vectors = table(s, p, "embeddings")
    entity = F.floor(F.col("vec_id") / 6)
    chunked = entity % 3 != 0
    chunks = vectors.where(chunked).select(F.col("vec_id").alias("chunk"), entity.alias("entity"), F.floor(F.col("vec_id") / 2).alias("section"), "embedding")
    own = vectors.where("vec_id % 6 = 0").select(entity.alias("entity"), chunked.alias("chunked"), "embedding")
    return r.vector_paths(chunks, own, QUERY_VECTOR, pool=40, candidates=15)


#: Words that texts of one language share, and the fields they are sought in: source, first line, text.
COVER_TEXT = "the and of"


def _titled(s: SparkSession, p: str) -> DataFrame:
    first = F.element_at(F.split("text", "\n"), 1)
    return table(s, p, "documents").select("doc_id", F.col("source").alias("title"), first.alias("summary"), "text")


def cover_density(s: SparkSession, p: str) -> DataFrame:
    """All documents with every word of a query, by cover density over postings of title, summary and text."""
    index = TextIndex.build(_titled(s, p), shared_folder(s, "postings"), ["title", "summary", "text"], id_col="doc_id")
    return index.search(COVER_TEXT)


QUERIES = {
    "cover_density": cover_density,
    "vector_neighbours": vector_neighbours,
    "vector_index_recall": vector_index_recall,
    "vector_paths": vector_paths,
    "tabular_types": lambda s, p: tabular.infer_types(_sheet(s, p)),
    "tabular_group": lambda s, p: _run(s, p, tabular.Query(where=[("type", "contains", "a")], group_by="Type", aggregate=("sum", "unit price"), limit=5)),
    "tabular_total": lambda s, p: _run(s, p, tabular.Query(where=[("unit price", "gte", "£1,000")], aggregate=("avg", "size"))),
    "tabular_rows": lambda s, p: _run(s, p, tabular.Query(where=[("size", "lt", "10")], sort=("UNIT PRICE", True), limit=25)).select("row_index", F.element_at("data", F.lit("Unit_Price")).alias("price")),
    "vector_nearest": lambda s, p: r.nearest(table(s, p, "embeddings"), QUERY_VECTOR, 50).select("vec_id", "label", "similarity"),
    "vector_two_per_label": lambda s, p: r.best_per_group(r.nearest(table(s, p, "embeddings"), QUERY_VECTOR, 200), "label", [F.desc("similarity"), F.col("vec_id")]).select("vec_id", "label", "similarity"),
    "lexical_scores": lambda s, p: r.bm25(table(s, p, "documents"), QUERY_TEXT, {"text": 1.0, "source": 0.5}, id_col="doc_id"),
    "rank_fusion": fused,
    "near_pending": lambda s, p: r.near_pending(table(s, p, "embeddings").where("vec_id % 20 = 0"), table(s, p, "embeddings")),
    "sections": lambda s, p: r.heading_sections(table(s, p, "documents")).select("doc_id", "section", "title", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "truncated"),
    "found": found,
    "chunks": lambda s, p: r.chunks(table(s, p, "documents")).select("doc_id", "chunk", "start", F.md5("text").alias("text_md5")),
    "csv_batches": lambda s, p: r.csv_batches(table(s, p, "documents"), rows=5).select("doc_id", "section", "title", F.md5("text").alias("text_md5")),
    "token_budget": token_budget,
    "split_threads": lambda s, p: r.split_thread(messages(s, p), longer_than=4, keep=2).select("conv_id", "turn", "to_summary"),
}

_SHEET = "sheet AS (SELECT p_partkey AS row_index, p_name AS name, p_type AS kind, round(p_retailprice, 2) AS price, p_size AS size FROM part)"
_Q = "[" + ", ".join(repr(x) for x in QUERY_VECTOR) + "]::DOUBLE[]"
_NEAR = f"near AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS similarity FROM embeddings)"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BM25 = f"""w AS (SELECT doc_id, {_WORDS.format("text")} AS a, {_WORDS.format("source")} AS b FROM documents),
  t AS (SELECT doc_id, len(a) + len(b) AS n, {", ".join(f"len(list_filter(a, lambda w: w = '{t}')) + 0.5::DOUBLE * len(list_filter(b, lambda w: w = '{t}')) AS t{i}" for i, t in enumerate(sorted(QUERY_TEXT.split())))} FROM w),
  z AS (SELECT count(*) AS c, avg(n) AS mean, {", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(3))} FROM t),
  lexical AS (SELECT doc_id, round({" + ".join(f"ln(1 + (c - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for i in range(3))}, 6) AS score FROM t, z WHERE t0 > 0 OR t1 > 0 OR t2 > 0)"""
_BM25_TEXT = _BM25.replace("len(a) + len(b)", "len(a)").replace(" + 0.5::DOUBLE * len(list_filter(b,", " + 0::DOUBLE * len(list_filter(b,")
_FIELDS = [_WORDS.format(f"coalesce({c}, '')") for c in ("source", "string_split(text, chr(10))[1]", "text")]
ORACLES = {
    "cover_density": f"""WITH
      w AS (
        SELECT doc_id AS doc, unnest(list_concat(
          list_transform({_FIELDS[0]}, lambda t: {{'t': t, 'w': 1.0}}),
          list_transform({_FIELDS[1]}, lambda t: {{'t': t, 'w': 0.4}}),
          list_transform({_FIELDS[2]}, lambda t: {{'t': t, 'w': 0.2}}))) AS x, generate_subscripts(list_concat(
          {_FIELDS[0]}, {_FIELDS[1]}, {_FIELDS[2]}), 1) AS pos FROM documents),
      e AS (SELECT doc, pos, x.t AS t, 1 / x.w::DOUBLE AS inv, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM w WHERE x.t IN ('the', 'and', 'of')),
      l AS (
        SELECT *, sum(inv) OVER o AS upto, max(i) FILTER (t = 'the') OVER o AS a, max(i) FILTER (t = 'and') OVER o AS b, max(i) FILTER (t = 'of') OVER o AS c
        FROM e WINDOW o AS (PARTITION BY doc ORDER BY i)),
      f AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(a, b, c) END AS first FROM l),
      g AS (SELECT *, lag(first) OVER (PARTITION BY doc ORDER BY i) AS was FROM f),
      covers AS (
        SELECT q.doc, (q.i - q.first + 1) / (q.upto - p.upto + p.inv) / (1 + (q.pos - p.pos) - (q.i - p.i)) AS worth
        FROM g q JOIN g p ON p.doc = q.doc AND p.i = q.first WHERE q.first IS NOT NULL AND q.first IS DISTINCT FROM q.was)
      SELECT doc, round(sum(worth), 9) AS score, CAST(count(*) AS INTEGER) AS covers FROM covers GROUP BY doc""",
    "vector_neighbours": """
      SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
        CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) AS INTEGER) AS rank
      FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10""",
    "vector_paths": f"""WITH {_NEAR},
      n AS (SELECT vec_id, vec_id // 6 AS entity, vec_id // 2 AS section, similarity FROM near WHERE similarity IS NOT NULL),
      pool AS (SELECT * FROM n WHERE entity % 3 <> 0 ORDER BY similarity DESC, vec_id LIMIT 40),
      best AS (SELECT entity, section, max(similarity) AS similarity FROM pool GROUP BY entity, section),
      hits AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY entity ORDER BY similarity DESC, section) <= 2),
      own AS (SELECT entity, similarity FROM n WHERE vec_id % 6 = 0),
      united AS (
        SELECT entity, section, similarity, 'chunks' AS path FROM hits
        UNION ALL SELECT * FROM (SELECT entity, NULL, similarity, 'entities' FROM own WHERE entity % 3 = 0 ORDER BY similarity DESC, entity LIMIT 15)
        UNION ALL SELECT * FROM (
          SELECT entity, NULL, similarity, 'fallback' FROM own
          WHERE entity % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.entity = own.entity) ORDER BY similarity DESC, entity LIMIT 15))
      SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, entity, section NULLS FIRST) AS INTEGER) AS rank FROM united""",
    "tabular_types": "SELECT 'parts' AS doc_id, name, inferred FROM (VALUES ('Name', 'string'), ('Type', 'string'), ('Unit_Price', 'number'), ('size', 'number')) AS x(name, inferred)",
    "tabular_group": f"WITH {_SHEET} SELECT kind AS key, round(sum(price), 6) AS value FROM sheet WHERE contains(lower(kind), 'a') GROUP BY kind ORDER BY value DESC, key LIMIT 6",
    "tabular_total": f"WITH {_SHEET} SELECT round(avg(size), 6) AS value FROM sheet WHERE price >= 1000",
    "tabular_rows": f"WITH {_SHEET} SELECT row_index, '£' || format('{{:,.2f}}', price) AS price FROM (SELECT * FROM sheet WHERE size < 10 ORDER BY price DESC, row_index LIMIT 26)",
    "vector_nearest": f"WITH {_NEAR} SELECT * FROM near ORDER BY similarity DESC, vec_id LIMIT 50",
    "vector_two_per_label": f"WITH {_NEAR}, p AS (SELECT * FROM near ORDER BY similarity DESC, vec_id LIMIT 200) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 2",
    "lexical_scores": f"WITH {_BM25} SELECT * FROM lexical",
    "rank_fusion": f"""WITH {_NEAR}, {_BM25}, v AS (SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INTEGER) AS vec_rank FROM near QUALIFY vec_rank <= 60), x AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS bm25_rank FROM lexical QUALIFY bm25_rank <= 60)
      SELECT coalesce(v.id, x.id) AS id, vec_rank, bm25_rank, round(coalesce(1 / (60 + vec_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 9) AS score FROM v FULL JOIN x ON v.id IS NOT DISTINCT FROM x.id""",
    "near_pending": """WITH p AS (SELECT a.vec_id, b.vec_id AS nearest, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
      SELECT DISTINCT ON (vec_id) vec_id, nearest, similarity, similarity >= 0.85 AS is_duplicate FROM p ORDER BY vec_id, similarity DESC, nearest""",
    "token_budget": f"""WITH RECURSIVE {MESSAGES}, h AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM messages),
      f AS (SELECT conv_id, turn, cost, k, true AS kept, cost AS used FROM h WHERE k = 1 UNION ALL
        SELECT h.conv_id, h.turn, h.cost, h.k, f.used + h.cost <= 150, f.used + CASE WHEN f.used + h.cost <= 150 THEN h.cost ELSE 0 END FROM f JOIN h ON h.conv_id = f.conv_id AND h.k = f.k + 1)
      SELECT conv_id, turn, cost, kept FROM f""",
    "split_threads": f"WITH {MESSAGES} SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) > 4 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS to_summary FROM messages",
    "csv_batches": r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents), c AS (SELECT doc_id, l, unnest(range(0, (len(l) - 2) // 5 + 1)) AS section FROM l WHERE len(l) > 1)
      SELECT doc_id, CAST(section AS INTEGER) AS section, 'Rows ' || CAST(section * 5 + 1 AS VARCHAR) || '-' || CAST(least((section + 1) * 5, len(l) - 1) AS VARCHAR) AS title, md5(l[1] || chr(10) || array_to_string(l[section * 5 + 2 : section * 5 + 6], chr(10))) AS text_md5 FROM c""",
    "sections": r"""WITH lines AS (SELECT doc_id, t.line, t.i FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, i)),
      marked AS (SELECT *, regexp_full_match(line, '#{1,6}\s+\S.*') AS heading, regexp_full_match(line, '-{3,}\s*') AS bar, regexp_full_match(line, '[^a-z]*[A-Z]{5}[^a-z]*') AS capitals FROM lines),
      counted AS (SELECT *, heading OR bar OR capitals AS opens, sum(CAST(heading OR bar OR capitals AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM marked),
      parts AS (SELECT doc_id, part, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT opens), '') AS text,
        coalesce(max(CASE WHEN heading THEN regexp_replace(regexp_replace(line, '^#{1,6}\s+', ''), '\s+$', '') WHEN bar THEN '' ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END) FILTER (WHERE opens), '') AS title,
        count(*) OVER (PARTITION BY doc_id) AS n FROM counted GROUP BY doc_id, part)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section, title, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars, length(text) > 16384 AS truncated
      FROM parts WHERE NOT (part = 0 AND text = '' AND n > 1)""",
    "chunks": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      c AS (SELECT doc_id, t, unnest(range(0, greatest(0, CAST(ceil((length(t) - 512) / 3584) AS BIGINT) - 1) + 1)) AS chunk FROM d WHERE t <> ''),
      w AS (SELECT *, chunk * 3584 AS start, substr(t, chunk * 3584 + 1, 4096) AS win FROM c)
      SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(start AS BIGINT) AS start, md5(CASE WHEN start + 4096 >= length(t) THEN win ELSE regexp_replace(win, '(?s)\s\S{0,63}\z', '') END) AS text_md5 FROM w""",
    "found": f"""WITH {_NEAR}, {_BM25_TEXT}, v AS (SELECT * FROM (SELECT vec_id AS id, similarity, NULL AS r, 0 AS path FROM near ORDER BY similarity DESC, vec_id LIMIT 40)
        UNION ALL SELECT * FROM (SELECT vec_id, similarity, NULL, 1 FROM near WHERE label = 1 ORDER BY similarity DESC, vec_id LIMIT 40)
        UNION ALL SELECT * FROM (SELECT doc_id, NULL, row_number() OVER (ORDER BY score DESC, doc_id), 2 FROM lexical ORDER BY score DESC, doc_id LIMIT 40)),
      b AS (SELECT id, max(similarity) AS similarity, CAST(min(r) AS INTEGER) AS bm25_rank, arg_min(path, {{'s': -coalesce(similarity, -2), 'p': path}}) AS path FROM v GROUP BY id),
      f AS (SELECT * FROM b ORDER BY similarity DESC NULLS LAST, id LIMIT 60)
      SELECT id, similarity, bm25_rank, path, (SELECT coalesce(max(similarity) < 0.3, true) FROM f) AS weak FROM f WHERE bm25_rank IS NOT NULL OR similarity >= 0.3 ORDER BY similarity DESC NULLS LAST, id LIMIT 30""",
}
