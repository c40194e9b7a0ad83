"""URL filters: rules on hosts and path prefixes, found by hash prefixes and confirmed by full digests.

A rule is a host, which stands for itself and all subdomains, and a path, which every path fits that starts with it. Each
distinct URL is expanded into (host suffix, path prefix) expressions, but only with as many host labels and path characters
as some rule has: these two small sets of numbers bound the expressions of a URL, however long it is. Expressions and rules
meet on the first 32 bits of a SHA-256 digest, the whole digest confirms, and of a URL's confirmed rules the longest wins
(the most characters in host and path; of two as long, the one with the longer host, then the first by name, block first).

Copies of a URL meet in one row before the expansion. Rules travel to all tasks up to a checked number, beyond it they are
shuffled; hot expressions are then split by Spark's skew handling.

Odd cases: a null URL, or one without `://`, has an empty host and path, which no rule fits. Rules with a null or empty
host fit nothing; a null path counts as empty. Rules given twice count once. Without rules the default verdict holds for
all. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm import frames

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest on which the join meets.
PREFIX = 8


def _until(text: Column, marks: str) -> Column:
    """Text before the first of the given characters."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = _until(rest, "/?#")
    return F.translate(host, UPPER, LOWER), _until(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")


def digest(host: Column, path: Column) -> Column:
    """Of an expression; a line feed cannot be part of a host with labels, so it separates safely."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit("\n"), host, path), 256)


def known_rules(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) ready to be met: labels, length, digest and its prefix."""
    host = F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    clean = rules.select(F.col("action").cast("string").alias("action"), host.alias("rule_host"), path.alias("rule_path")).where(
        "rule_host <> '' AND action IN ('allow', 'block')").distinct()
    return clean.select(
        "action", "rule_host", "rule_path", F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length("rule_path").alias("characters"), digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest")).withColumn(
        "prefix", F.substring("rule_digest", 1, PREFIX))


def expressions(urls: DataFrame, labels: list[int], characters: list[int]) -> DataFrame:
    """(url, prefix, digest) of every host suffix and path prefix that a rule could have."""
    suffixes = F.filter(F.transform(F.array(*[F.lit(n) for n in labels]), lambda n: F.when(
        F.size(F.split("host", r"\.")) >= n, F.call_function("substring_index", "host", F.lit("."), -n))), lambda s: s.isNotNull())
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in characters]), lambda n: F.when(
        F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda s: s.isNotNull())
    spread = urls.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(prefixes))
    return spread.select("url", digest(F.col("suffix"), F.col("start")).alias("digest")).withColumn(
        "prefix", F.substring("digest", 1, PREFIX))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule (host and path of the rule that decides, or null) and verdict of every page."""
    known = known_rules(rules)
    shapes = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("characters").alias("characters")).head()
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    if not shapes["labels"]:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = judged.where("host <> ''").select("url", "host", "path").distinct()
    asked = expressions(urls, sorted(shapes["labels"]), sorted(shapes["characters"]))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
                    F.col("action").alias("action"), F.concat("rule_host", "rule_path").alias("rule"))
    met = asked.join(frames.small_side(known.drop("labels", "characters"), 100_000), "prefix").where("digest = rule_digest")
    best = met.groupBy("url").agg(F.max(rank).alias("best"))
    found = best.select(F.col("url").alias("_url"), F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return judged.join(found, F.col("url") == F.col("_url"), "left").drop("_url").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default)))
