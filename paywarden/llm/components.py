"""Connected components of a link table by rounds of joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node of the component.

    Alternates two steps until every component is a star: each node hands its larger neighbours to its smallest one, then
    its smaller ones. Only minima are grouped and neighbours stay rows, so a node with very many links is never
    collected. Nodes may have any sortable type; null ends, loops and repeated links are left out; no links, no rows.
    """
    edges = stored(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        larger = both.join(lowest, "u").filter(F.col("v") > F.col("u"))
        edges = stored(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(lowest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(smaller.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        if _stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one link, to a node that is no upper end itself: then every component is a star."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("below")).filter("ups > 1 or ups = 1 and below = 1").isEmpty()
