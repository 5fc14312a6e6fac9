"""URL filters by expanded expressions and short hash prefixes.

Every distinct (host, path) is expanded into expressions: each suffix of the
host at a dot, joined with each prefix of the path that has the length of some
rule's path (lengths are taken from the rules, so an URL makes labels x lengths
expressions, not one for each character). Expressions and rules meet in an
equi-join on the first ``PREFIX_HEX`` hex digits of SHA-256; then the full
digests are compared. Of the rules that fit, the longest (host and path
together) wins, then the longest host, then allow before block.

Hot hosts cost nothing extra: URLs are made distinct first, expressions are
made distinct before they meet the rules, and verdicts go back to the pages
by (host, path) with a join that the adaptive plan can split.

Defined results: a null URL or one without `://` has empty host and path, and
no rule fits it. Host: after the first `://` up to `/`, `?`, `#` or the end,
A-Z lower-cased; path: from there up to `?`, `#` or the end. Where no rule
fits, ``default`` is the verdict. Empty tables give empty results; repeated
rows and null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import sized, staged, table

PREFIX_HEX = 8
#: The rules of the query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """id, url, host, path, rule, verdict: one row per row of ``pages``."""
    host, path = url_parts(pages[url_col])
    rows = staged(pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), host.alias("host"),
                               path.alias("path")), "urls")
    digest = F.sha2(F.concat_ws("\n", "x_host", "x_path"), 256)
    known = rules.select(F.col("rule_host").alias("x_host"), F.col("rule_path").alias("x_path"), "verdict").withColumn(
        "digest", digest)
    # one rule for each expression: allow comes first
    known = staged(known.groupBy("digest").agg(
        F.min("verdict").alias("verdict"), F.first(F.concat("x_host", "x_path")).alias("rule"),
        F.max(F.length("x_host")).alias("host_len"), F.max(F.length("x_path")).alias("path_len")).withColumn(
        "short", F.substring("digest", 1, PREFIX_HEX)), "url-rules")
    lengths = known.select(F.col("path_len").alias("cut")).distinct()

    urls = rows.filter("host <> ''").select("host", "path").distinct()
    # suffixes of as many labels as some rule's host has
    sizes = rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).agg(F.collect_set("n").alias("sizes"))
    hosts = urls.select("host").distinct().withColumn("labels", F.split("host", r"\.")).crossJoin(F.broadcast(sizes))
    suffixes = F.transform(F.filter("sizes", lambda n: n <= F.size("labels")), lambda n: F.array_join(
        F.slice("labels", F.size("labels") - n + 1, n), "."))
    hosts = hosts.select("host", F.explode(F.array_distinct(suffixes)).alias("x_host"))
    # hosts that no rule can fit leave before their paths are expanded
    rule_hosts = staged(rules.select(F.sha2("rule_host", 256).alias("r_host")).distinct(), "url-rule-hosts")
    hosts = hosts.withColumn("h_digest", F.sha2("x_host", 256))
    hosts = hosts.join(sized(rule_hosts), (F.substring("h_digest", 1, PREFIX_HEX) == F.substring("r_host", 1, PREFIX_HEX))
                       & (F.col("h_digest") == F.col("r_host")), "left_semi").select("host", "x_host")
    hosts = staged(hosts.groupBy(F.col("host").alias("k_host")).agg(F.collect_set("x_host").alias("x_hosts")), "url-hosts")
    cuts = lengths.agg(F.collect_set("cut").alias("cuts"))  # as many as the rules have path lengths
    pairs = urls.join(hosts, F.col("host") == F.col("k_host")).crossJoin(F.broadcast(cuts))
    found = pairs.select("host", "path", F.explode("x_hosts").alias("x_host"), "cuts").select(
        "host", "path", "x_host", F.explode(F.filter("cuts", lambda n: n <= F.length("path"))).alias("cut"))
    found = found.withColumn("x_path", F.col("path").substr(F.lit(1), F.col("cut"))).withColumn("x_digest", digest)
    met = (F.substring("x_digest", 1, PREFIX_HEX) == F.col("short")) & (F.col("x_digest") == F.col("digest"))
    found = found.join(sized(known), met)
    order = F.struct(F.col("host_len") + F.col("path_len"), "host_len")
    best = found.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(
        F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    best = staged(best, "url-verdicts")
    out = rows.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return out.select("id", "url", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH r(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
f AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""
