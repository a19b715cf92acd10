"""Timeline, conversations, change feed and the streams that keep them current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.operators import changes
from paywarden.operators import desk as K
from paywarden.operators import scoring
from paywarden.operators import timeline as T
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import arr, tim
from paywarden.session import work_dir
from paywarden.streaming import feeds
from paywarden.streaming.history import stream_history


@query("workflow_state", """
    SELECT strftime(m.created_at, '%Y-%m-%d %H:%M:%S.%f') AS event_ts,
           CASE WHEN m.tool IS NOT NULL THEN 'tool_call' ELSE 'message' END AS event_kind, m.role AS actor,
           CAST(NULL AS BIGINT) AS payment_id, c.title AS conversation, CAST(m.position AS VARCHAR) AS position, m.tool,
           CAST(NULL AS VARCHAR) AS action_type, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS hold_hours
    FROM messages m JOIN chats c ON c.id = m.conversation_id
    UNION ALL
    SELECT strftime(coalesce(decided_at, created_at), '%Y-%m-%d %H:%M:%S.%f'), 'decision', approved_by, payment_id,
           NULL, NULL, NULL, action_type, status, CAST(hold_duration_hours AS VARCHAR) FROM case_actions""")
def workflow_state(c: Context) -> DataFrame:
    rows = T.workflow_state(c.t.messages(), c.t.conversations(), c.t.case_actions())

    def field(path, name):
        return F.get_json_object("detail", f"$.{path}").alias(name)

    return rows.select("event_ts", "event_kind", "actor", "payment_id", field("conversation", "conversation"),
                       field("position", "position"), field("tools[0]", "tool"), field("action_type", "action_type"),
                       field("status", "status"), field("hold_duration_hours", "hold_hours"))


@query("append_positions", """
    WITH stored AS (SELECT conversation_id, max(position) AS last FROM messages WHERE conversation_id % 2 = 0 GROUP BY 1)
    SELECT m.conversation_id, m.content, coalesce(s.last, -1) + row_number() OVER (PARTITION BY m.conversation_id
           ORDER BY m.created_at, m.position) AS position
    FROM messages m LEFT JOIN stored s ON m.conversation_id = s.conversation_id""")
def append_positions(c: Context) -> DataFrame:
    """Even conversations already hold their messages; the same messages arrive again as a batch for all."""
    stored = c.t.messages().filter(F.col("conversation_id") % 2 == 0)
    incoming = c.t.messages().select("conversation_id", "content", "created_at", F.col("position").alias("seq"))
    return T.append_positions(stored, incoming, [F.asc("created_at"), F.asc("seq")]).select(
        "conversation_id", "content", "position")


@query("conversation_list", f"SELECT id, user_email, title, {tim('created_at', 'updated_at')} FROM chats")
def conversation_list(c: Context) -> DataFrame:
    return T.conversation_list(c.t.conversations())


@query("tool_usage", """
    SELECT conversation_id, tool, count(*) AS calls, count(DISTINCT position) AS messages FROM messages
    WHERE tool IS NOT NULL GROUP BY 1, 2""")
def tool_usage(c: Context) -> DataFrame:
    return T.tool_usage(c.t.messages())


@query("clean_history", """
    SELECT conversation_id, count(*) AS kept, arg_max(role, position) AS last_role,
           arg_max(role, position) = 'user' AS sendable
    FROM messages WHERE role IN ('user', 'assistant') AND regexp_matches(content, '\\S') GROUP BY 1""")
def clean_history(c: Context) -> DataFrame:
    return T.clean_history(c.t.messages())


@query("feedback_summary", """
    SELECT conversation_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE value = 'up') AS up,
           count(*) FILTER (WHERE value = 'down') AS down FROM feedback GROUP BY 1, 2""")
def feedback_summary(c: Context) -> DataFrame:
    return T.feedback_summary(c.t.feedback())


# -- change feed ----------------------------------------------------------------------------------

CURRENT = """SELECT id, status, action_type, strftime(_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS changed_at, _sort_by
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _sort_by DESC) AS rn FROM change_feed
          WHERE _pg_change_type <> 'update_preimage') WHERE rn = 1 AND _pg_change_type <> 'delete'"""


def feed_files(c: Context) -> tuple[str, object]:
    """The feed as files whose order says nothing about the order of the changes."""
    rows, path = changes.change_feed(c.t.decision_events()), work_dir(c.spark, "change-feed")
    rows.repartition(F.xxhash64("_sort_by")).write.parquet(path)
    return path, rows.schema


def feed(c: Context) -> DataFrame:
    path, schema = feed_files(c)
    return c.spark.read.schema(schema).parquet(path)


@query("cdc_apply_latest", CURRENT)
def cdc_apply_latest(c: Context) -> DataFrame:
    return changes.apply_latest(feed(c))


@query("cdc_apply_latest_stream", CURRENT)
def cdc_apply_latest_stream(c: Context) -> DataFrame:
    source, schema = feed_files(c)
    return feeds.stream_latest(c.spark, source, schema, work_dir(c.spark, "latest"), work_dir(c.spark, "latest-state"))


HISTORY = """
    WITH v AS (SELECT *, lead(_timestamp) OVER (PARTITION BY id ORDER BY _sort_by) AS nxt,
               row_number() OVER (PARTITION BY id ORDER BY _sort_by) AS version FROM change_feed
               WHERE _pg_change_type <> 'update_preimage')
    SELECT id, status, action_type, strftime(_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS valid_from,
           strftime(nxt, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, nxt IS NULL AS is_current, version
    FROM v WHERE _pg_change_type <> 'delete'"""


@query("cdc_history_scd2", HISTORY)
def cdc_history_scd2(c: Context) -> DataFrame:
    return changes.history(feed(c))


@query("cdc_history_scd2_stream", HISTORY)
def cdc_history_scd2_stream(c: Context) -> DataFrame:
    """The files replay a month in arbitrary order, so the allowed lateness covers that month."""
    source, schema = feed_files(c)
    return stream_history(c.spark, source, schema, work_dir(c.spark, "history"), work_dir(c.spark, "history-state"), "40 days")


@query("change_order", """
    SELECT b.id, b._sort_by, a.status AS old_status, b.status, a.action_type AS old_action_type, b.action_type,
           CASE WHEN a.status IS DISTINCT FROM b.status AND a.action_type IS DISTINCT FROM b.action_type
                THEN 'status,action_type' WHEN a.status IS DISTINCT FROM b.status THEN 'status'
                WHEN a.action_type IS DISTINCT FROM b.action_type THEN 'action_type' ELSE '' END AS changed_columns
    FROM change_feed a JOIN change_feed b ON a.id = b.id AND a._pg_lsn = b._pg_lsn AND a._pg_xid = b._pg_xid
    WHERE a._pg_change_type = 'update_preimage' AND b._pg_change_type = 'update_postimage'""")
def change_order(c: Context) -> DataFrame:
    return changes.update_diffs(feed(c))


@query("cdc_change_counts", """
    SELECT strftime(date_trunc('hour', _timestamp), '%Y-%m-%d %H:%M:%S.%f') AS start, _pg_change_type, count(*) AS n
    FROM change_feed GROUP BY 1, 2""")
def cdc_change_counts(c: Context) -> DataFrame:
    """The files replay a month in arbitrary order, so the allowed lateness covers that month."""
    source, schema = feed_files(c)
    return feeds.stream_change_counts(c.spark, source, schema, work_dir(c.spark, "counts"),
                                      work_dir(c.spark, "counts-state"), "40 days")


@query("queue_live_refresh", f"""
    SELECT CAST(coalesce(sum(s.{K.EXPOSURE}), 0) AS DOUBLE) AS {K.EXPOSURE},
           CAST(coalesce(sum(s.{K.RECOVERY}), 0) AS DOUBLE) AS projected_recovery_usd, count(*) AS flagged_count,
           count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS refer_recommended_count
    FROM scored s WHERE payment_id NOT IN (SELECT payment_id FROM case_actions)""")
def queue_live_refresh(c: Context) -> DataFrame:
    c = c.with_stored_queue()
    actions, log = c.t.case_actions().drop("audit_trail"), work_dir(c.spark, "decisions")
    actions.write.parquet(log)
    queue = c.s.scored.select("payment_id", K.EXPOSURE, K.RECOVERY, "recommended_disposition")
    return feeds.stream_queue_kpis(
        c.spark, log, actions.schema, queue, work_dir(c.spark, "kpis"), work_dir(c.spark, "kpis-state"))


@query("flag_ingest_dedup", f"SELECT payment_id, n_signals, {arr('signal_list')}, has_strong_signal FROM summary")
def flag_ingest_dedup(c: Context) -> DataFrame:
    raw, path = c.t.flag_arrivals(), work_dir(c.spark, "flag-files")
    raw.write.parquet(path)
    pairs = feeds.stream_flag_pairs(c.spark, path, raw.schema, work_dir(c.spark, "pairs"),
                                    work_dir(c.spark, "pairs-state"))
    return scoring.signal_summary(pairs, c.t.signal_classification()).select(
        "payment_id", "n_signals", "signal_list", "has_strong_signal")
