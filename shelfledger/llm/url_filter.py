"""URL rules by equi-join on hash prefixes of host and path expressions.

A URL is expanded into every (host suffix, path prefix) expression that a rule
could have: suffixes at label borders, as deep as the deepest rule, and prefixes
of the lengths that rule paths have. Expressions meet the rules on the first
``SHORT`` hex digits of their SHA-256; a match counts only if the full digests
agree. Of several rules the longest wins, then the longer host, then a block.

A null URL or one without ``://`` has an empty host and path. Hosts are lower-cased
for A-Z only. A URL that fits no rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, block: list[str], allow: list[str]) -> DataFrame:
    """Rules such as ``example.com/de/`` as rows: rule, verdict."""
    rows = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rows])
    return spark.range(1).select(F.inline(listed))


def _prepared(rules: DataFrame) -> DataFrame:
    slash = F.instr("rule", "/")
    host = F.translate(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit(""))
    digest = F.sha2(F.concat(host, F.lit("\n"), path), 256)
    return rules.where("rule is not null").select(
        "rule", "verdict", host.alias("rule_host"), path.alias("rule_path"),
        digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"),
    )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Without rules every URL is allowed. Repeated rows and null ids stay rows of
    their own; other columns are not read. The driver sees two facts about the
    rules: how deep hosts go and which lengths paths have.
    """
    rules = _prepared(rules)
    facts = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("depth"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not facts.depth:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))

    # Suffixes of one label up to `depth` labels, those that the host has.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, facts.depth + 1)]))
    prefixes = F.array_compact(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(facts.lengths)])
    )
    row = F.monotonically_increasing_id()
    spread = (
        urls.withColumn("row", row)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode_outer(prefixes))
        .withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
        .withColumn("key", F.substring("digest", 1, SHORT))
    )
    fits = F.col("digest") == F.col("rule_digest")
    strength = F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict"))
    found = spread.join(rules, F.col("key") == F.col("short"), "left").select(
        "row", "page_id", "host", "path",
        F.when(fits, F.struct(strength.alias("strength"), "rule", "verdict")).alias("hit"),
    )
    best = found.groupBy("row", "page_id", "host", "path").agg(F.max("hit").alias("hit"))
    return best.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")
    )
