"""Reads of the working desk and the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import desk as K
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import dbl, tim

E, V = K.EXPOSURE, K.RECOVERY
MEMO_ID = 100  # the payment the single-payment reads look at
ALLOWED = " USER1, user2 , ,user1 ,user77,User140"


@query("latest_action_join", f"""
    SELECT payment_id, program, state, queue_date, n_signals, signals, risk_level, recommended_disposition,
           confidence_score, live_disposition, action_status, {dbl('payment_amount_usd', E, V)} FROM live_queue""")
def latest_action_join(c: Context) -> DataFrame:
    return c.desk.live.select(*K.POSITION, "recommended_disposition", "confidence_score", "live_disposition",
                              "action_status")


@query("latest_per_key", f"""
    SELECT payment_id, id, action_type, status, approved_by, {tim('decided_at', 'created_at')},
           hold_duration_hours FROM latest_action""")
def latest_per_key(c: Context) -> DataFrame:
    return K.latest_actions(c.desk.actions)


@query("open_anti_join", f"""
    SELECT payment_id, risk_level, {dbl(E)} FROM positions
    WHERE payment_id NOT IN (SELECT payment_id FROM case_actions)""")
def open_anti_join(c: Context) -> DataFrame:
    decided = c.desk.actions.select("payment_id").distinct()
    return c.desk.positions.join(decided, "payment_id", "left_anti").select("payment_id", "risk_level", E)


@query("acted_left_join", """
    SELECT p.payment_id, a.payment_id IS NOT NULL AS acted, dr.recommended_disposition
    FROM positions p LEFT JOIN (SELECT DISTINCT payment_id FROM case_actions) a ON a.payment_id = p.payment_id
    LEFT JOIN rec_mirror dr ON dr.payment_id = p.payment_id""")
def acted_left_join(c: Context) -> DataFrame:
    acted = c.desk.actions.select(F.col("payment_id").alias("k")).distinct()
    return c.desk.positions_with_recs.join(acted, F.col("payment_id") == F.col("k"), "left").select(
        "payment_id", F.col("k").isNotNull().alias("acted"), "recommended_disposition")


@query("acted_distinct", "SELECT DISTINCT payment_id FROM case_actions")
def acted_distinct(c: Context) -> DataFrame:
    return c.desk.actions.select("payment_id").distinct()


@query("flag_enrichment", f"""
    WITH worst AS (SELECT * FROM flag_mirror ORDER BY {E} DESC NULLS LAST, payment_id LIMIT 1)
    SELECT w.payment_id, w.n_signals, w.signal_list AS signals, w.risk_level, CAST(w.{E} AS DOUBLE) AS {E},
           l.program, l.state, {dbl('l.payment_amount_usd', 'l.' + V)}, l.live_disposition, l.action_status
    FROM worst w LEFT JOIN live_queue l ON w.payment_id = l.payment_id
    UNION ALL
    SELECT w.payment_id, w.n_signals, w.signal_list, w.risk_level, CAST(w.{E} AS DOUBLE),
           l.program, l.state, CAST(l.payment_amount_usd AS DOUBLE), CAST(l.{V} AS DOUBLE), l.live_disposition, l.action_status
    FROM flag_mirror w LEFT JOIN live_queue l ON w.payment_id = l.payment_id WHERE w.payment_id = {MEMO_ID}""")
def flag_enrichment(c: Context) -> DataFrame:
    """The worst open flag, then a named one."""
    c = c.with_stored_queue()
    return K.flag_enrichment(c.desk.flags, c.desk.live).unionByName(
        K.flag_enrichment(c.desk.flags, c.desk.live, MEMO_ID))


@query("payment_detail", f"""
    SELECT l.payment_id, l.program, l.state, l.queue_date, l.n_signals, l.signals, l.risk_level,
           l.recommended_disposition, CAST(l.recommended_hold_hours AS BIGINT) AS recommended_hold_hours, l.live_disposition,
           {dbl('l.payment_amount_usd', 'l.' + E, 'l.' + V)}, a.id AS action_id, a.action_type, a.status,
           strftime(a.created_at, '%Y-%m-%d %H:%M:%S.%f') AS action_created_at,
           a.decided_at IS NOT NULL AS audited
    FROM live_queue l LEFT JOIN case_actions a ON a.payment_id = l.payment_id WHERE l.payment_id = {MEMO_ID}""")
def payment_detail(c: Context) -> DataFrame:
    detail = K.payment_detail(c.desk.live, c.desk.actions, MEMO_ID)
    return detail.withColumn("audited", F.coalesce(F.col("audit") != "[]", F.lit(False))).drop("audit")


@query("latest_vs_recommended", """
    SELECT payment_id, recommended_disposition, live_disposition, recommended_disposition <> live_disposition AS overridden,
           CAST(hold_duration_hours AS BIGINT) AS approved_hours, CAST(recommended_hold_hours AS BIGINT) AS recommended_hours,
           CAST(hold_duration_hours - recommended_hold_hours AS BIGINT) AS hours_delta
    FROM live_queue WHERE live_disposition IS NOT NULL""")
def latest_vs_recommended(c: Context) -> DataFrame:
    return c.desk.live.filter(F.col("live_disposition").isNotNull()).select(
        "payment_id", "recommended_disposition", "live_disposition",
        (F.col("recommended_disposition") != F.col("live_disposition")).alias("overridden"),
        F.col("hold_duration_hours").alias("approved_hours"), F.col("recommended_hold_hours").alias("recommended_hours"),
        (F.col("hold_duration_hours") - F.col("recommended_hold_hours")).alias("hours_delta"))


@query("action_ranking", f"""
    SELECT payment_id, disposition, hold_hours, {dbl('cost_usd', 'predicted_recovery_usd', 'predicted_net_value_usd')}
    FROM action_options""")
def action_ranking(c: Context) -> DataFrame:
    return c.desk.recs.select("payment_id", F.inline("action_ranking"))


@query("rank_options", f"""
    SELECT payment_id, disposition, {dbl('predicted_net_value_usd')},
           row_number() OVER (PARTITION BY payment_id ORDER BY action_options.predicted_net_value_usd DESC, hold_hours) AS net_rank
    FROM action_options""")
def rank_options(c: Context) -> DataFrame:
    return K.ranked_options(c.desk.recs).select("payment_id", "disposition", "predicted_net_value_usd", "net_rank")


@query("what_if_release", f"""
    SELECT r.payment_id, r.recommended_disposition, CAST(o.predicted_net_value_usd AS DOUBLE) AS recommended_net_usd,
           CAST(z.predicted_net_value_usd AS DOUBLE) AS release_net_usd,
           CAST(o.predicted_net_value_usd - z.predicted_net_value_usd AS DOUBLE) AS net_gain_usd,
           CAST(o.predicted_recovery_usd - z.predicted_recovery_usd AS DOUBLE) AS recovery_forgone_usd,
           CAST(o.cost_usd - z.cost_usd AS DOUBLE) AS delay_cost_avoided_usd
    FROM rec_mirror r JOIN action_options o ON r.payment_id = o.payment_id AND o.disposition = r.recommended_disposition
    JOIN action_options z ON r.payment_id = z.payment_id AND z.disposition = 'release'""")
def what_if_release(c: Context) -> DataFrame:
    return K.what_if_release(c.desk.recs)


@query("payment_explanation", f"""
    SELECT q.payment_id, q.program, q.state, q.risk_level, q.n_signals, array_to_string(q.signal_list, ',') AS signal_list,
           CAST(q.payment_amount_usd AS DOUBLE) AS payment_amount_usd, CAST(q.{E} AS DOUBLE) AS improper_exposure_usd,
           r.recommended_disposition, CAST(r.recommended_hold_hours AS BIGINT) AS recommended_hold_hours,
           CAST(r.predicted_recovery_usd AS DOUBLE) AS predicted_recovery_usd, r.reasoning
    FROM open_queue q JOIN rec_mirror r USING (payment_id) WHERE q.payment_id = {MEMO_ID}""")
def payment_explanation(c: Context) -> DataFrame:
    q, r = c.s.queue.filter(F.col("payment_id") == MEMO_ID), c.desk.recs
    return q.join(r.drop(E), "payment_id").select(
        "payment_id", "program", "state", "risk_level", "n_signals", "signal_list", "payment_amount_usd",
        F.col(E).alias("improper_exposure_usd"), "recommended_disposition", "recommended_hold_hours",
        "predicted_recovery_usd", "reasoning")


@query("worst_flag", f"""
    SELECT payment_id, n_signals, signal_list, risk_level, {dbl(E)} FROM flag_mirror
    ORDER BY flag_mirror.{E} DESC NULLS LAST, payment_id LIMIT 1""")
def worst_flag(c: Context) -> DataFrame:
    return K.worst_flags(c.desk.flags)


@query("decided_first", f"""
    SELECT payment_id, program, state, {dbl(E)}, risk_level, recommended_disposition, live_disposition, action_status,
           approved_by, {tim('decided_at')}
    FROM live_queue ORDER BY (live_disposition IS NOT NULL) DESC, live_queue.{E} DESC NULLS LAST, payment_id LIMIT 10""")
def decided_first(c: Context) -> DataFrame:
    return c.desk.live.orderBy(F.col("live_disposition").isNotNull().desc(), F.desc_nulls_last(E), "payment_id").limit(
        10).select("payment_id", "program", "state", E, "risk_level", "recommended_disposition", "live_disposition",
                   "action_status", "approved_by", "decided_at")


@query("queue_list", f"""
    SELECT payment_id, program, risk_level, live_disposition, {dbl(E, V)} FROM live_queue
    ORDER BY live_queue.{V} DESC NULLS LAST, payment_id LIMIT 300""")
def queue_list(c: Context) -> DataFrame:
    return K.queue_list(c.desk.live, sort="recovery").select("payment_id", "program", "risk_level", "live_disposition",
                                                             E, V)


@query("program_payments", f"""
    SELECT payment_id, program, {dbl(E)} FROM live_queue WHERE program = 'SNAP'
    ORDER BY live_queue.{E} DESC NULLS LAST, payment_id LIMIT 200""")
def program_payments(c: Context) -> DataFrame:
    return K.queue_list(c.desk.live, limit="1000", default=50, cap=200, program="SNAP").select("payment_id", "program", E)


@query("recent_activity", f"""
    SELECT 'action' AS kind, id AS action_id, payment_id,
           strftime(coalesce(decided_at, created_at), '%Y-%m-%d %H:%M:%S.%f') AS at, coalesce(approved_by, 'system') AS by,
           action_type, status, CAST(hold_duration_hours AS BIGINT) AS hold_duration_hours, {dbl('predicted_recovery_usd')},
           drafted_request AS notes
    FROM case_actions ORDER BY coalesce(decided_at, created_at) DESC NULLS LAST, id DESC LIMIT 20""")
def recent_activity(c: Context) -> DataFrame:
    return K.recent_activity(c.desk.actions)


@query("actions_for_payment", f"""
    SELECT id, payment_id, action_type, CAST(hold_duration_hours AS BIGINT) AS hold_duration_hours, drafted_request,
           {dbl('predicted_recovery_usd')}, status, approved_by, {tim('created_at', 'decided_at')}
    FROM case_actions WHERE payment_id = {MEMO_ID}""")
def actions_for_payment(c: Context) -> DataFrame:
    return K.clean_action_log(c.desk.actions).filter(F.col("payment_id") == MEMO_ID).orderBy(
        F.desc("created_at"), F.desc("id")).select(
        "id", "payment_id", "action_type", "hold_duration_hours", "drafted_request", "predicted_recovery_usd", "status",
        "approved_by", "created_at", "decided_at")


@query("capacity_batches", f"""
    SELECT payment_id, program, {dbl(E)}, rank, (rank - 1) // 50 + 1 AS batch
    FROM (SELECT payment_id, program, {E}, row_number() OVER (ORDER BY {E} DESC NULLS LAST, payment_id) AS rank
          FROM open_queue)""")
def capacity_batches(c: Context) -> DataFrame:
    return K.capacity_batches(c.s.queue)


@query("role_assign", """
    SELECT event_id, lower(trim(who)) AS identity,
           CASE WHEN lower(trim(who)) IN ('user1', 'user2', 'user77', 'user140') THEN 'supervisor' ELSE 'examiner' END AS role
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  USER' || CAST(user_id AS VARCHAR) || ' '
          WHEN 1 THEN 'user' || CAST(user_id AS VARCHAR) ELSE 'xuser' || CAST(user_id AS VARCHAR) END AS who FROM events)""")
def role_assign(c: Context) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    who = F.when(e % 3 == 0, F.concat(F.lit("  USER"), u, F.lit(" "))).when(e % 3 == 1, F.concat(F.lit("user"), u)) \
        .otherwise(F.concat(F.lit("xuser"), u))
    return c.t.read("events").select("event_id", K.normalise_identity(who).alias("identity"),
                                     K.role_of(who, ALLOWED).alias("role"))


@query("record_decisions", f"""
    WITH requests AS (SELECT *, id // 2 AS batch_id FROM case_actions WHERE approved_by IS NOT NULL),
    refused AS (SELECT DISTINCT batch_id FROM requests WHERE payment_id NOT IN (SELECT payment_id FROM positions)
                OR approved_by NOT IN (SELECT DISTINCT 'user' || CAST(user_id AS VARCHAR) FROM events WHERE user_id % 4 <> 0))
    SELECT r.id, r.payment_id, trim(split_part(p.signals, ',', 1)) AS signal_type, r.action_type,
           CAST(r.hold_duration_hours AS BIGINT) AS hold_duration_hours, 'approved' AS status, r.approved_by,
           'supervisor' AS reviewed_by_role, strftime(r.created_at, '%Y-%m-%d %H:%M:%S.%f') AS decided_at,
           {dbl('r.predicted_recovery_usd')}, 'Examiner-approved ' || r.action_type
           || CASE WHEN r.hold_duration_hours IS NOT NULL THEN ' — hold ' || CAST(r.hold_duration_hours AS VARCHAR) || 'h'
              ELSE '' END || '.' AS audit_notes
    FROM requests r JOIN positions p ON r.payment_id = p.payment_id
    WHERE r.batch_id NOT IN (SELECT batch_id FROM refused)""")
def record_decisions(c: Context) -> DataFrame:
    c = c.with_stored_queue()
    requests = c.desk.actions.filter(F.col("approved_by").isNotNull()).select(
        "id", "payment_id", "action_type", "hold_duration_hours", "drafted_request", "predicted_recovery_usd",
        F.col("approved_by").alias("requested_by"), F.col("created_at").alias("requested_at"),
        F.expr("id div 2").alias("batch_id"))
    return K.record_decisions(requests, c.desk.positions, supervisors=c.t.supervisors()).select(
        "id", "payment_id", "signal_type", "action_type", "hold_duration_hours", "status", "approved_by",
        "reviewed_by_role", "decided_at", "predicted_recovery_usd", F.col("audit_trail")[0]["notes"].alias("audit_notes"))


