"""Messages, tool calls and decisions on one timeline; conversation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.joins import salted_join
from paywarden.operators.ranking import distributed_rank

KEEP_NULLS = {"ignoreNullFields": "false"}


def _is_call(step: Column) -> Column:
    return step["kind"] == "tool_call"


def tool_names() -> Column:
    return F.transform(F.filter("thinking", _is_call), lambda e: e["name"])


def workflow_state(messages: DataFrame, conversations: DataFrame, actions: DataFrame) -> DataFrame:
    """Message and decision events in one common shape, in time order."""
    titles = conversations.select(F.col("id").alias("conversation_id"), "title")
    tools = F.when(F.size(tool_names()) > 0, tool_names())
    said = salted_join(messages, titles, "conversation_id", "position", messages).select(
        F.col("created_at").alias("event_ts"),
        F.when(F.exists("thinking", _is_call), "tool_call").otherwise("message").alias("event_kind"),
        F.col("role").alias("actor"), F.lit(None).cast("bigint").alias("payment_id"),
        F.to_json(F.struct("role", "position", F.col("title").alias("conversation"), tools.alias("tools")),
                  KEEP_NULLS).alias("detail"))
    decided = actions.select(
        F.coalesce("decided_at", "created_at").alias("event_ts"), F.lit("decision").alias("event_kind"),
        F.col("approved_by").alias("actor"), "payment_id",
        F.to_json(F.struct("action_type", "status", "hold_duration_hours", "predicted_recovery_usd", "audit_trail"),
                  KEEP_NULLS).alias("detail"))
    return said.unionByName(decided).orderBy("event_ts")


def append_positions(stored: DataFrame, incoming: DataFrame, arrival: list[Column]) -> DataFrame:
    """Positions for a batch of new messages: after the stored maximum, in arrival order.

    One conversation may hold a large share of the batch, so the order comes from the distributed rank.
    """
    last = stored.groupBy("conversation_id").agg(F.max("position").alias("last"))
    ranked = distributed_rank(incoming, ["conversation_id"], arrival, "n")
    return salted_join(ranked, last, "conversation_id", "n", incoming, "left").withColumn(
        "position", F.coalesce("last", F.lit(-1)) + F.col("n")).drop("last", "n")


def conversation_list(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy("user_email", F.desc("updated_at"), "id")


def conversation_messages(messages: DataFrame, conversation) -> DataFrame:
    return messages.filter(F.col("conversation_id") == conversation).orderBy("position", "created_at")


def tool_usage(messages: DataFrame) -> DataFrame:
    calls = messages.select("conversation_id", "position", F.explode(tool_names()).alias("tool"))
    return calls.groupBy("conversation_id", "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("position").alias("messages"))


def clean_history(messages: DataFrame) -> DataFrame:
    """Per conversation: kept messages, role of the last kept one, and whether it can be sent."""
    kept = messages.filter(F.col("role").isin("user", "assistant") & F.col("content").rlike(r"\S"))
    return kept.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("kept"), F.max_by("role", "position").alias("last_role")).withColumn(
        "sendable", F.col("last_role") == "user")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("conversation_id", F.col("created_at").cast("date").alias("day")).agg(
        F.count_if(F.col("value") == "up").alias("up"), F.count_if(F.col("value") == "down").alias("down"))
