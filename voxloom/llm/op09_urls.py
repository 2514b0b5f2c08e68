"""URL filters by host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into expressions: every suffix of the host at a
label border, with every prefix of the path whose length some rule has.  The first 32
bits of the expressions' SHA-256 are joined to those of the rules; the full digests then
confirm, and the longest rule wins, of equal ones that with the longer host, then block.

Cases: a null url or one without ``://`` has empty host and path, which no rule fits; a
url that no rule fits is allowed; rules repeat without harm; of rules for one expression
that say both, block holds; no pages give no rows, no rules allow everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, stash

#: The filter list of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = (rules.where("host <> '' and path is not null")
              .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
              .agg(F.max("verdict").alias("verdict"))
              .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
              .withColumn("prefix", F.substring("digest", 1, 8)))
    listed = stash(listed, "rules")
    # Distinct lengths, not rules: bounded by the longest path a rule may have.
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().collect()]
    suffixes = F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]) if lengths \
        else F.array().cast("array<string>")
    distinct = parsed.where("host <> ''").select("host", "path").distinct()
    asked = (distinct.withColumn("_labels", F.split("host", r"\."))
             .select("host", "path", F.explode(suffixes).alias("_h"), prefixes.alias("_paths"))
             .select("host", "path", "_h", F.explode("_paths").alias("_p")).where("_p is not null")
             .withColumn("full", _digest(F.col("_h"), F.col("_p"))).withColumn("prefix", F.substring("full", 1, 8)))
    small = listed.count() <= BROADCAST_ROWS
    found = asked.join(F.broadcast(listed) if small else listed, "prefix").where("full = digest")
    rule = F.concat("rule_host", "rule_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("rule_host").alias("h"), F.col("verdict"), rule.alias("rule"))).alias("b"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"),
        F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))
