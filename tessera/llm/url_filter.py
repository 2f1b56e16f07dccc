"""URL rules by host suffix and path prefix, matched on short hashes, in DataFrame operations only.

A rule is (verdict, host, path): it fits its host and all subdomains where the url's path starts with the rule's. Of the rules that
fit a url the longest counts (host and path together; at equal length the longer host, then block before allow).

The host of a url is what follows the first `://` up to `/`, `?`, `#` or the end, A to Z lower-cased; its path is what follows up to `?`,
`#` or the end. Each different (host, path) is expanded once into expressions: host suffixes cut at dots times path prefixes cut at
slashes. An expression meets rules in an equi-join on the first PREFIX hex digits of its SHA-256, and the whole digest is confirmed.
A rule's path may end anywhere: prefixes also end as many characters after a slash as any rule does.

Expressions are made only as deep as the deepest rule's host and path, which the rules say, so a url of a million dots or slashes
has no more of them than another, and none is lost. What repeats (a host and path that a third of all pages share, null urls)
is one row before it is expanded. The join back to the pages is a left join that Spark splits where a key is hot.

Null urls, and those without `://`, have an empty host and path. Rules with a null host or path are left out, repeated rules count once, and a
verdict other than allow is block. Without rules nothing fits, and what no rule fits is allowed. Repeated pages are pages of their own, null
page_ids stay, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the short hash: 4 bytes.
PREFIX = 8
#: The contract's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
RULE = "verdict string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host of a url and its path without query and fragment; both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def filed(rules: DataFrame) -> DataFrame:
    """Rules as they are looked up: short hash, digest of host and path (hosts hold no slash), what is `found` in order of precedence, and their depth."""
    r = rules.select(F.when(F.col("verdict") == "allow", "allow").otherwise("block").alias("verdict"), F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"), F.col("path").cast("string").alias("path"))
    r = r.where("host IS NOT NULL AND path IS NOT NULL").distinct().withColumn("rule", F.concat("host", "path")).withColumn("digest", F.sha2("rule", 256))
    beyond = F.when(_count(F.col("path"), "/") == 0, F.length("path")).otherwise(F.length(F.substring_index("path", "/", -1)))
    found = F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "verdict", "rule")
    return r.select(F.substring("digest", 1, PREFIX).alias("short"), F.col("digest").alias("whole"), found.alias("found"), (_count(F.col("host"), ".") + 1).alias("labels"), _count(F.col("path"), "/").alias("slashes"), beyond.alias("beyond"))


def expressions(urls: DataFrame, labels: int, slashes: int, beyond: list[int]) -> DataFrame:
    """urls (host, path) with short and digest of each expression: host suffixes of at most `labels` labels, with path prefixes that end
    `beyond` characters after one of the first `slashes` slashes or after the path's begin."""
    suffixes = F.expr(f"array_distinct(transform(sequence(1, least({labels}, length(host) - length(replace(host, '.', '')) + 1)), n -> substring_index(host, '.', -n)))")
    deep = F.least(F.lit(slashes), _count(F.col("path"), "/"))
    cuts = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda n: F.length(F.call_function("substring_index", F.col("path"), F.lit("/"), n)) + 1)).otherwise(F.array().cast("array<int>"))
    ends = F.flatten(F.transform(F.concat(F.array(F.lit(0)), cuts), lambda c: F.transform(F.array(*map(F.lit, beyond)), lambda n: c + n)))
    ends = F.array_distinct(F.filter(ends, lambda n: n <= F.length("path")))
    rows = urls.select("host", "path", F.explode(suffixes).alias("suffix"), ends.alias("ends"))
    digests = F.transform("ends", lambda n: F.sha2(F.concat("suffix", F.substring(F.col("path"), F.lit(1), n)), 256))
    return rows.select("host", "path", F.explode(digests).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each different (host, path) that any rule fits: host, path, rule, verdict of the rule that counts."""
    listed = filed(rules)
    deepest = listed.agg(F.max("labels"), F.max("slashes"), F.sort_array(F.collect_set("beyond"))).first()  # beyond: as many as the longest path has characters, at most
    made = expressions(urls.select("host", "path").distinct(), deepest[0] or 1, deepest[1] or 0, deepest[2] or [0])
    met = made.join(listed.select("short", "whole", "found"), "short").where(F.col("digest") == F.col("whole"))
    best = met.groupBy("host", "path").agg(F.max("found").alias("found"))
    return best.select("host", "path", "found.rule", "found.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits) and verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = rows.join(matches(rows, rules), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = """
WITH rules(verdict, host, path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rest AS (
    SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
    SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), best AS (
    SELECT c.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
    GROUP BY c.n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (n)
"""
