"""Importance resampling towards a target: documents are drawn by how much likelier the target's words make them.

Words and their runs are hashed to buckets. What both sides hold is counted bucket by bucket (only these counts are
shuffled); each bucket's gain is the log ratio of its smoothed shares. A document's weight is the sum of the gains of its
features, found without spreading them over rows: its array of buckets is folded over one literal array of gains. Noise
that a hash of the document's id fixes is added to the weight (Gumbel's, so that the highest scores are a draw without
replacement), and the highest scores are drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table, workspace
from quillon.llm.ranges import deal, ranked

BUCKETS = 10_000

#: Words: runs of digits, lower-case letters and whatever lies beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """All words of a whole text, A-Z lower-cased; null texts have none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, longest: int = 1) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space. found must be a column, not an expression to be evaluated again."""
    runs, n = [found], F.size(found)
    for k in range(2, longest + 1):
        left = F.greatest(n - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), left), F.slice(found, F.lit(k), left), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*runs) if longest > 1 else found


def buckets(found: Column, longest: int = 1, of: int = BUCKETS) -> Column:
    return F.transform(features(found, longest), lambda f: (F.crc32(f.cast("binary")) % of).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, of: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts fall into each bucket: at most `of` numbers, added up in the tasks before they meet."""
    cut = texts.select(words(F.col(text_col)).alias("_w"))  # a column of its own: inside a lambda it would be cut anew for every run
    each = cut.select(F.explode(buckets(F.col("_w"), longest, of)).alias("b"))
    return dict(each.groupBy("b").agg(F.count("*").alias("n")).collect())


def gains(source: dict[int, int], target: dict[int, int], of: int = BUCKETS) -> list[int]:
    """Per bucket a thousand times the log ratio of the target's share to the source's, rounded down; either counts from one."""
    s_all, t_all = float(sum(source.values()) + of), float(sum(target.values()) + of)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(of)]


def weighed(docs: DataFrame, gain: list[int], *, text_col: str = "text", longest: int = 1) -> DataFrame:
    """docs with n_words, n_features and weight: the sum of the gains of its features, 0 without any. Such columns are replaced."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal when the query is planned
    kept = [c for c in docs.columns if c not in ("n_words", "n_features", "weight", "_w", "_b")]
    cut = docs.select(*kept, words(F.col(text_col)).alias("_w")).select(*kept, "_w", buckets(F.col("_w"), longest, len(gain)).alias("_b"))
    weight = F.aggregate("_b", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    return cut.select(*kept, F.size("_w").cast("long").alias("n_words"), F.size("_b").cast("long").alias("n_features"), weight.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times Gumbel noise, rounded down, from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    longest: int = 1, percent: int = 10, min_words: int = 20, seed: int = 2024, of: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is 1, 2, 3... for those drawn, else null.

    Of the rows with at least min_words words, percent in a hundred (rounded down) are drawn: the highest scores, ties to the
    smaller id. Null texts have no words, so weight 0, and are never drawn; a null id counts as empty in the hash and comes
    last among ties. Repeated rows are rows of their own and get ranks one after the other. Without documents there are no
    rows; with an empty target every bucket counts from one. Other columns are ignored.

    Scores are dealt by ranges, so that ranks come from places and one offset for each range: no task sorts all rows.
    """
    gain = gains(bucket_counts(docs, text_col, longest, of), bucket_counts(target, target_text, longest, of), of)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = weighed(lean, gain, longest=longest).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("able")
    )
    with workspace(docs.sparkSession) as keep:
        scored = materialise(found, "scored")
        drawn = scored.where("able").count() * percent // 100
        order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        dealt = deal(scored, order, "ranked")
        keep(dealt)
    rank = F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked(dealt, "rank").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance_resampling": op11_importance_resampling}

#: crc32 is worked out byte by byte, once for each distinct word.
CRC32_SQL = """crc_table AS MATERIALIZED (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
    crc AS MATERIALIZED (
      SELECT word, xor(list_reduce(
          list_transform(range(1, length(h), 2), lambda j: CAST('0x' || substr(h, j, 2) AS BIGINT)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
      FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM hashed), crc_table)"""

ORACLES = {
    "op11_importance_resampling": f"""WITH
    cut AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
    goal AS MATERIALIZED (
      SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
    said AS MATERIALIZED (SELECT r, unnest(w) AS word FROM cut),
    hashed AS (SELECT word FROM said UNION ALL SELECT word FROM goal),
    {CRC32_SQL},
    s AS MATERIALIZED (SELECT r, crc % 10000 AS b FROM said JOIN crc USING (word)),
    sb AS (SELECT b, count(*) AS s FROM s GROUP BY b),
    tb AS (SELECT crc % 10000 AS b, count(*) AS t FROM goal JOIN crc USING (word) GROUP BY 1),
    totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM sb) AS s_all, (SELECT coalesce(sum(t), 0) FROM tb) AS t_all),
    gain AS MATERIALIZED (
      SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g
      FROM sb LEFT JOIN tb USING (b), totals),
    weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM s JOIN gain USING (b) GROUP BY r),
    scored AS (
      SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM cut LEFT JOIN weights USING (r)),
    placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (r)""",
}
