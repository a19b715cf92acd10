"""The ordered change feed of the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators.ranking import distributed_rank, with_neighbour

INSERT, PRE, POST, DELETE = "insert", "update_preimage", "update_postimage", "delete"
ENTITY = ["status", "action_type"]


def change_feed(events: DataFrame) -> DataFrame:
    """Change rows for a sequence of versions per entity.

    The first version is an insert, a final error a delete, every other version a pre- and post-image
    pair. An entity may hold a large share of all versions: order and predecessor come from the
    distributed rank, the version count from a map-side combined aggregate.
    """
    ranked = distributed_rank(events, ["id"], [F.asc("event_id")], "version")
    sized = ranked.join(
        events.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    rows = with_neighbour(sized, ["id"], "version", ENTITY, -1, "prev_")
    first = F.col("version") == 1
    last = (F.col("version") == F.col("n")) & (F.col("event_type") == "error")

    def row(kind: str, status: str, action: str, bump: int):
        return F.struct(
            F.lit(kind).alias("_pg_change_type"), F.col(status).alias("status"), F.col(action).alias("action_type"),
            (F.col("event_id") * 2 + bump).alias("_sort_by"))

    changes = (
        F.when(first, F.array(row(INSERT, "status", "action_type", 0)))
        .when(last, F.array(row(DELETE, "status", "action_type", 0)))
        .otherwise(F.array(row(PRE, "prev_status", "prev_action_type", 0), row(POST, "status", "action_type", 1))))
    return rows.select("id", "event_id", "ts", F.explode(changes).alias("c")).select(
        "id", "c.status", "c.action_type", "c._pg_change_type", (F.col("event_id") * 64).alias("_pg_lsn"),
        F.pmod(F.col("event_id"), F.lit(1 << 31)).cast("int").alias("_pg_xid"), F.col("ts").alias("_timestamp"), "c._sort_by")


def newest_version(feed: DataFrame) -> DataFrame:
    """Highest ``_sort_by`` per entity, deletes included; the aggregate also runs on a stream."""
    row = F.struct(*ENTITY, "_pg_change_type", "_timestamp", "_sort_by")
    return feed.filter(F.col("_pg_change_type") != PRE).groupBy("id").agg(F.max_by(row, "_sort_by").alias("v"))


def apply_latest(feed: DataFrame) -> DataFrame:
    """Current rows: the newest version of every entity that is not deleted."""
    return newest_version(feed).filter(F.col("v._pg_change_type") != DELETE).select(
        "id", "v.status", "v.action_type", F.col("v._timestamp").alias("changed_at"), "v._sort_by")


def history(feed: DataFrame) -> DataFrame:
    """Validity interval of every version; a delete ends the last one and has no row of its own."""
    versions = feed.filter(F.col("_pg_change_type") != PRE)
    ranked = distributed_rank(versions, ["id"], [F.asc("_sort_by")], "version")
    rows = with_neighbour(ranked, ["id"], "version", ["_timestamp"], 1, "next")
    return rows.filter(F.col("_pg_change_type") != DELETE).select(
        "id", "status", "action_type", F.col("_timestamp").alias("valid_from"), F.col("next_timestamp").alias("valid_to"),
        F.col("next_timestamp").isNull().alias("is_current"), "version")


def update_diffs(feed: DataFrame) -> DataFrame:
    """Pre- and post-image of each update with the names of the changed columns."""
    pre = feed.filter(F.col("_pg_change_type") == PRE).select(
        "id", "_pg_lsn", "_pg_xid", *[F.col(c).alias(f"old_{c}") for c in ENTITY])
    post = feed.filter(F.col("_pg_change_type") == POST)
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in ENTITY]))
    return post.join(pre, ["id", "_pg_lsn", "_pg_xid"]).select(
        "id", "_sort_by", "old_status", "status", "old_action_type", "action_type", changed.alias("changed_columns"))


def change_counts(feed: DataFrame, width: str = "1 hour") -> DataFrame:
    """Changes per type and tumbling window; the same function serves batch and stream."""
    return feed.groupBy(F.window("_timestamp", width).alias("w"), "_pg_change_type").agg(F.count(F.lit(1)).alias("n"))
