"""Quality rules as a bitmask ledger. DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps the measurements and a mask with a bit for each failed
rule. A policy is a version's set of rules: a document is kept if its mask and the policy's have no common bit. Ablations
are computed from counts by mask, of which there are at most 2 ** rules, however many documents there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: White space that parts words, marks that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit by bit: the rule's name and the condition, over the measurements, on which a document fails it.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
]
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that each applies.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "shouting"), "v2": tuple(name for name, _ in RULES)}


def mask_of(names: tuple[str, ...]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def _repeat_words(words: Column, window: int = 3) -> Column:
    """Words covered by windows that occur twice or more: equal windows become neighbours when hashes are sorted.

    Only texts in which some window recurs are sorted; windows are compared by 64-bit hashes.
    """
    n = F.size(words) - window + 1

    def ends(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

        covered = lambda at: F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )
        return _let(placed, lambda s: _let(places(s), covered))

    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))
    return F.when(n > 1, _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), ends(h)).otherwise(0))).otherwise(0)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the measurements of the whole text as long columns; columns of those names are replaced. Null texts have no words.

    A Python-free form: words, lines and windows are arrays within the row, so a document never leaves its task.
    """
    names = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    # the split is cut off from what uses it, so that it runs once
    staged = docs.select(*names, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")).alias("_words"), text.alias("_text"))
    worded = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    gone = lambda chars: F.length("_text") - F.length(F.translate("_text", chars, ""))
    staged = staged.select(*names, "_words", F.size("_words").cast("long").alias("n_words"), (F.length("_text") - gone(SPACE)).cast("long").alias("word_chars"), gone(SYMBOLS).cast("long").alias("n_symbols"), gone(UPPER).cast("long").alias("n_upper"), worded.alias("_lines"))
    return staged.select(
        *names, "n_words", "word_chars", "n_symbols", "n_upper", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the text, with the measurements and failed (long): the mask of the rules that each fails."""
    found = measured(docs.drop("failed"), text_col=text_col).drop(text_col)
    bits = [F.when(F.expr(condition), 1 << i).otherwise(0) for i, (_, condition) in enumerate(RULES)]
    return found.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(entries: DataFrame, rules: tuple[str, ...], name: str = "kept") -> DataFrame:
    """Ledger rows with a column that tells whether no rule of the policy failed."""
    return entries.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask_of(rules))) == 0)


def ablations(entries: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept, n_kept_without): for each rule of each policy how many documents fail it, how many
    only it drops, and how many are kept with it and without it.

    Documents are first counted by mask; what is expanded by policy and rule are those counts.
    """
    spark = entries.sparkSession
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    asked = [(p, r, mask_of(rules), mask_of((r,))) for p, rules in policies.items() for r in rules]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("m"), F.lit(b).alias("b")) for p, r, m, b in asked)))
    rows = counts.select("failed", "n", each.alias("x")).select("n", "x.*", F.col("failed").bitwiseAND(F.col("x.m")).alias("hit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    found = rows.groupBy("policy", "rule").agg(
        total(F.col("hit").bitwiseAND(F.col("b")) != 0).alias("n_failed"), total(F.col("hit") == F.col("b")).alias("n_only"), total(F.col("hit") == 0).alias("n_kept"), total(F.col("hit").bitwiseAND(F.bitwise_not("b")) == 0).alias("n_kept_without")
    )
    every = spark.createDataFrame([(p, r) for p, r, _, _ in asked], "policy string, rule string")
    return every.join(F.broadcast(found), ["policy", "rule"], "left").na.fill(0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), POLICIES["v2"]), BASE, "passed")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("passed")).alias("base_failed"), "kept", "failed")


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


_MEASURED = r"""split_up AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines, row_number() OVER () AS row FROM documents),
      windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS k FROM (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM split_up WHERE len(w) > 2)),
      covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY row),
      measured AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM split_up LEFT JOIN covered USING (row)),
      ledger AS (SELECT *, """ + " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES)) + " AS failed FROM measured)"

QUERIES = {"op6_quality_rules": op6_quality_rules, "rules_ablation": rules_ablation}
ORACLES = {
    "op6_quality_rules": f"""WITH {_MEASURED} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM ledger""",
    "rules_ablation": f"""WITH {_MEASURED}, asked(policy, rule, m, b) AS (VALUES {", ".join(f"('{p}', '{r}', {mask_of(rules)}, {mask_of((r,))})" for p, rules in POLICIES.items() for r in rules)})
      SELECT policy, rule, count(*) FILTER (WHERE failed & b <> 0) AS n_failed, count(*) FILTER (WHERE failed & m = b) AS n_only, count(*) FILTER (WHERE failed & m = 0) AS n_kept, count(*) FILTER (WHERE failed & m & ~b = 0) AS n_kept_without
      FROM asked, ledger GROUP BY policy, rule""",
}
