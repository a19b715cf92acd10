"""Allow and block rules for URLs, looked up by hashed host-suffix and path-prefix expressions.

A URL is expanded into every (host suffix, path prefix) pair whose numbers of labels and characters occur among the rules;
other pairs can't equal a rule. Each expression is joined with the rules on the first eight hex digits of its SHA-256, then
the whole digest has to agree, and of the rules that remain the longest wins: by host, then by path, then block before allow.

Cases: a null URL, or one without ``://``, has an empty host and path and no rule. Repeated rows stay rows of their own,
repeated rules count once, rules with a null are left out. Without a rule the default verdict holds. Extra columns of
the pages are ignored; no pages give no rows, no rules the default for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import ascii_lower, bounded

#: Rules up to this number are broadcast; more of them are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url) by ``rules`` (host, path, verdict)."""
    rules = rules.select("host", "path", "verdict").dropna().select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    digest = _digest(F.col("host"), F.col("path"))
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict")).select(
        F.substring(digest, 1, 8).alias("prefix"), digest.alias("rule_digest"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"), F.length("path").alias("path_length"), "rule_verdict")
    # The shapes (labels in the host, characters in the path) of the rules are as few as their longest host and path allow.
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    label = F.split("host", r"\.")
    expressions = F.array(*[
        F.when((F.size(label) >= s.labels) & (F.length("path") >= s.chars),
               _digest(F.substring_index("host", ".", -s.labels), F.substring(F.col("path"), F.lit(1), F.lit(s.chars)))) for s in shapes]
    ) if shapes else F.array(F.lit(None).cast("string"))
    exploded = base.withColumn("digest", F.explode_outer(F.array_compact(expressions))).withColumn("prefix", F.substring("digest", 1, 8))
    found = exploded.join(bounded(listed, BROADCAST_RULES), "prefix", "left")
    agrees = F.col("digest") == F.col("rule_digest")
    best = F.max(F.when(agrees, F.struct("host_length", "path_length", "rule_verdict", "rule")))
    return found.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"),
    ).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
