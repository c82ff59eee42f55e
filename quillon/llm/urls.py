"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

Every rule has literal tokens that each url it fits must hold. How often these tokens occur is counted over all urls; a
rule is filed under its rarest one. The tokens of a url fetch the rules filed under them, and only those run their regular
expressions. A rule without a whole token is filed under the empty token, which every url has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, table
from quillon.llm.graphs import join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rules that are broadcast (a rule has some hundred bytes); a larger table is joined by a shuffle.
BROADCAST_RULES = 50_000

#: Fixed values of op3: verdict, host and path of the domain rules.
DOMAIN_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Pattern rules for urls that no domain rule judges. "*" is any text, "^" a separator or the end, "||" a host's beginning.
PATTERN_RULES = [
    ("block", "^login^"), ("block", "^signin^"), ("block", "^signup^"), ("block", "^cart^"), ("block", "^checkout^"), ("block", "^wp-login^"), ("block", "^admin^"), ("block", "^search?"),
    ("block", "^casino^"), ("block", "^poker^"), ("block", "^porn^"), ("block", "^xxx^"), ("block", "^torrent^"), ("block", "^phishing^"), ("block", "^doubleclick^"), ("block", "||ads.*"), ("block", "||track.*"),
    ("block", "^sessionid="), ("block", "^phpsessid="), ("block", "^replytocom="), ("block", "^print=1^"), ("allow", "^robots.txt^"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def tokens(c: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.^$|?*+(){}\[\]\-])", r"\\$1")


def domain_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as (rule, verdict, tier, weight, pattern, tokens): fit a host and its subdomains if the path begins with theirs.

    They run on host and path; the longest wins. The last run of a path is no token unless something follows it, for a longer one fits too.
    """
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    text = F.concat(ascii_lower("host"), "path")
    whole = F.when(F.col("path") == "", F.col("host")).otherwise(F.regexp_replace(text, "[A-Za-z0-9]+$", ""))
    return given.select(
        F.concat("host", "path").alias("rule"), "verdict", F.lit(1).alias("tier"), F.length(text).alias("weight"), F.lit(True).alias("on_place"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(ascii_lower("host")), F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(_quoted(F.col("path")))).alias("pattern"), tokens(whole).alias("tokens"),
    )


def pattern_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, pattern) in the same columns; they run on the whole lower-cased url. An allowing one beats a blocking one."""
    given = spark.createDataFrame(rules, "verdict string, rule string")
    at_host = F.col("rule").startswith("||")
    # "*" at an edge says nothing, and would be tried from every place of a long url
    low = ascii_lower(F.regexp_replace(F.when(at_host, F.expr("substr(rule, 3)")).otherwise(F.regexp_replace("rule", r"^\*+", "")), r"\*+$", ""))
    body = F.replace(F.replace(_quoted(low), F.lit(r"\*"), F.lit(".*")), F.lit(r"\^"), F.lit(r"(?:[^a-z0-9]|$)"))
    # a run of letters and digits is a whole token where it does not touch "*" or the rule's edge
    edged = F.concat(F.when(at_host, F.lit("^")).otherwise(F.lit("*")), low, F.lit("*"))
    whole = F.regexp_extract_all(edged, F.lit(r"(?<![*a-z0-9])[a-z0-9]+(?![*a-z0-9])"), F.lit(0))
    return given.select(
        "rule", "verdict", F.lit(0).alias("tier"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("weight"), F.lit(False).alias("on_place"),
        F.concat(F.when(at_host, F.lit(r"(?s)^[^/?#]*://(?:[^/?#]*\.)?")).otherwise(F.lit("(?s)")), body).alias("pattern"), F.array_distinct(whole).alias("tokens"),
    )


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with `token`: the rarest of their tokens among the urls (ties: the first in order), or "" if they have none."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    each = urls.select(F.explode(tokens(F.col("url"))).alias("token"))
    counted = lambda rows: rows.groupBy("token").agg(F.count("*").alias("n"))
    if wanted.count() <= BROADCAST_RULES:
        seen = counted(each.join(F.broadcast(wanted), "token", "left_semi"))
    else:  # counted first: a token that all urls have is a row for each task then
        seen = counted(each).join(wanted, "token", "left_semi")
    keyed = rules.select("rule", "tier", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = keyed.groupBy("rule", "tier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
    token, n = F.coalesce("m.token", F.lit("")).alias("token"), F.coalesce("m.n", F.lit(0)).alias("n")
    return rules.join(rarest, ["rule", "tier"], "left").select("rule", "verdict", "tier", "weight", "on_place", "pattern", token, n)


def _candidates(urls: DataFrame, indexed: DataFrame) -> DataFrame:
    """urls (url, place) with the rules that they must be tried against: those filed under one of their tokens, and those without a token.

    Up to BROADCAST_RULES rules are broadcast. More are joined by token, each token's rules in one row; of tokens that many urls
    have, these rows go to the urls. Rules without a token meet every url, in broadcast lots.
    """
    rule = ["rule", "verdict", "tier", "weight", "on_place", "pattern"]
    keyed = urls.select("*", F.explode(tokens(F.col("url"))).alias("token"))
    total = indexed.count()
    if total <= BROADCAST_RULES:
        every = urls.select("*", F.explode(F.array_append(tokens(F.col("url")), F.lit(""))).alias("token"))
        return every.join(F.broadcast(indexed.drop("n")), "token").drop("token")
    filed = indexed.where("token <> ''").groupBy("token").agg(F.collect_list(F.struct(*rule)).alias("rules"), F.max("n").alias("n"))
    met = join_groups(keyed, filed, "token", keyed.count())
    found = met.select("url", "place", F.inline("rules"))
    loose = indexed.where("token = ''").select(*rule)
    lots = -(-loose.count() // BROADCAST_RULES)
    for lot in range(lots):
        few = loose.where(F.pmod(F.xxhash64("rule", "tier"), F.lit(lots)) == lot)
        found = found.unionByName(urls.crossJoin(F.broadcast(few)))  # a stated set of rules against all rows, in blocks
    return found


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict, and pattern_rule (columns of these names are replaced).

    rule is the longest domain rule that fits, else null; verdict is that rule's, else that of the pattern rule that fits
    (pattern_rule, else null), else the default. Null and malformed urls have an empty host and path and get the default, or
    what a pattern says. Repeated rows stay. Rules of equal weight: the first in order. The same url is judged once.
    """
    spark = pages.sparkSession
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern_rule")]
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    indexed = materialise(index_rules(pages.select(F.col(url_col).alias("url")), rules), "rules")
    host, path = host_and_path(F.col("url"))
    candidates = _candidates(urls.select("url", F.concat(host, path).alias("place")), indexed)
    fits = F.rlike(F.when(F.col("on_place"), F.col("place")).otherwise(ascii_lower("url")), F.col("pattern"))
    order = F.struct("tier", "weight", F.col("rule").alias("r"))
    best = candidates.where(fits).groupBy("url").agg(F.max_by(F.struct("rule", "verdict", "tier"), order).alias("found")).withColumnRenamed("url", "found_url")
    host, path = host_and_path(F.col(url_col))
    joined = pages.select(*names).join(best, F.col(url_col) == F.col("found_url"), "left")
    return joined.select(
        *names, host.alias("host"), path.alias("path"), F.when(F.col("found.tier") == 1, F.col("found.rule")).alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"), F.when(F.col("found.tier") == 0, F.col("found.rule")).alias("pattern_rule"),
    )


def default_rules(spark: SparkSession) -> DataFrame:
    return domain_rules(spark, DOMAIN_RULES).unionByName(pattern_rules(spark, PATTERN_RULES))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"), default_rules(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _oracle() -> str:
    """Every rule against every url, without an index."""
    domain = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in DOMAIN_RULES)

    def regex(rule: str) -> str:
        at_host, low = rule.startswith("||"), rule.removeprefix("||").lower()
        body = "".join({"*": ".*", "^": "([^a-z0-9]|$)"}.get(c, "\\" + c if not c.isalnum() else c) for c in low)
        return "(?s)" + (r"^[^/?#]*://([^/?#]*\.)?" if at_host else "") + body

    patterns = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{r}' AS rule, '{regex(r)}' AS re" for v, r in PATTERN_RULES)
    low = "translate({}, '" + UPPER + "', '" + LOWER + "')"
    return f"""WITH domain AS ({domain}), patterns AS ({patterns}),
      parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      placed AS (SELECT page_id, url, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
      judged AS (SELECT *,
        (SELECT max_by(struct_pack(r := h || p, v := verdict), length(h || p)) FROM domain WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS d,
        (SELECT max_by(struct_pack(r := rule, v := verdict), (CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END, rule)) FROM patterns WHERE regexp_matches({low.format("url")}, re)) AS m FROM placed)
      SELECT page_id, host, path, d.r AS rule, coalesce(d.v, m.v, 'allow') AS verdict, CASE WHEN d IS NULL THEN m.r END AS pattern_rule FROM judged"""


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLES = {"op3_url_filters": _oracle()}
