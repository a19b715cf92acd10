"""The SQL each registered query is checked against.

The tables below restate the domain derivations in plain SQL over the input tables, independent of
the Spark code. ``statement`` puts the ones a query mentions in front of it.
"""

from __future__ import annotations

import re

SIG = ("['duplicate_identity','deceased_payee','income_mismatch','benefit_overlap',"
       "'cross_agency_fraud_flag','employment_mismatch','residence_mismatch','manual_review_flag']")
STRONG = "('duplicate_identity','deceased_payee','cross_agency_fraud_flag')"
MODERATE = "('income_mismatch','benefit_overlap','employment_mismatch')"
STATUS = "['proposed','approved','executed','overridden']"
ACTION = ("CASE event_type WHEN 'purchase' THEN 'release' WHEN 'signup' THEN 'hold_for_verification' "
          "WHEN 'error' THEN 'refer_to_investigation' END")
PROGRAMS = "['TANF','SNAP','Child Care','Disability','Veteran''s']"

CTES: dict[str, str] = {
    "beneficiaries": f"""
        SELECT c_custkey AS beneficiary_id,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'TANF' WHEN 'BUILDING' THEN 'SNAP'
                    WHEN 'FURNITURE' THEN 'Child Care' WHEN 'MACHINERY' THEN 'Disability'
                    WHEN 'AUTOMOBILE' THEN 'Veteran''s' END AS program,
               n_name AS state,
               greatest(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS monthly_income_usd,
               CASE c_custkey % 3 WHEN 1 THEN {SIG}[1 + c_custkey % 8]
                    WHEN 2 THEN {SIG}[1 + c_custkey % 8] || ' | ' || {SIG}[1 + (c_custkey + 3) % 8] END AS signal_tags,
               DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS enrollment_date
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "claims": """
        SELECT o_orderkey AS claim_id,
               CASE WHEN o_orderkey % 20 = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS beneficiary_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'new_application' WHEN '2-HIGH' THEN 'recertification'
                    WHEN '3-MEDIUM' THEN 'supplemental' WHEN '4-NOT SPECIFIED' THEN 'adjustment'
                    WHEN '5-LOW' THEN 'correction' END AS claim_type,
               CAST(o_totalprice AS DECIMAL(18,2)) AS claim_amount_usd, CAST(o_orderdate AS DATE) AS claim_date
        FROM orders WHERE o_orderkey % 20 <> 0""",
    "payments": """
        SELECT o_orderkey AS payment_id, o_custkey AS beneficiary_id, o_orderkey AS claim_id,
               CAST(o_totalprice AS DECIMAL(18,2)) AS payment_amount_usd, CAST(o_orderdate AS DATE) AS queue_date,
               'pre_disbursement' AS payment_status
        FROM orders""",
    "payment_flags": f"""
        SELECT DISTINCT l_orderkey AS payment_id, {SIG}[1 + l_partkey % 8] AS signal
        FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05::DOUBLE""",
    "payment_flags_wave": """
        SELECT f.payment_id, f.signal, p.queue_date FROM payment_flags f JOIN payments p ON f.payment_id = p.payment_id
        WHERE p.queue_date >= DATE '1999-01-01' OR (f.payment_id * 31) % 100 < 15""",
    "signal_classification": """
        SELECT * FROM (VALUES ('duplicate_identity','fraud'), ('deceased_payee','fraud'),
            ('cross_agency_fraud_flag','fraud'), ('income_mismatch','eligibility'),
            ('employment_mismatch','eligibility'), ('residence_mismatch','eligibility'),
            ('benefit_overlap','eligibility'), ('manual_review_flag','administrative')) v(signal, signal_category)""",
    "outcomes_raw": """
        SELECT o_orderkey AS case_id,
               CASE WHEN o_orderkey % 25 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS beneficiary_id,
               CAST(o_orderdate AS DATE) AS case_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_usd,
               o_orderkey % 5 AS n_signals,
               CASE WHEN o_orderkey % 5 >= 3 THEN 'refer_to_investigation'
                    WHEN o_orderkey % 5 = 2 AND o_custkey % 2 = 0 THEN 'hold_for_verification'
                    WHEN o_orderkey % 5 = 2 THEN 'refer_to_investigation'
                    WHEN o_orderkey % 5 = 1 AND o_custkey % 2 = 1 THEN 'hold_for_verification'
                    ELSE 'release' END AS disposition_chosen,
               CASE WHEN o_orderkey % 5 >= 2 THEN o_custkey % 100 < 85 ELSE o_custkey % 100 < 8 END AS was_improper,
               CAST(CASE WHEN (CASE WHEN o_orderkey % 5 >= 2 THEN o_custkey % 100 < 85 ELSE o_custkey % 100 < 8 END)
                    THEN ((CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * (o_custkey % 97) * 2 + 97) // 194)
                         * 0.01 ELSE 0 END AS DECIMAL(18,2)) AS recovery_amount_usd,
               1 + o_custkey % 30 AS days_to_resolution
        FROM orders WHERE o_orderstatus = 'F'""",
    "summary": f"""
        SELECT f.payment_id, count(*) AS n_signals, list(f.signal ORDER BY f.signal) AS signal_list,
               list(coalesce(l.signal_category, 'unclassified') ORDER BY f.signal) AS signal_categories,
               list_sort(list(DISTINCT coalesce(l.signal_category, 'unclassified'))) AS signal_category_set,
               CAST(NULL AS DOUBLE) AS ai_classification_min_confidence,
               list(CASE WHEN f.signal IN {STRONG} THEN 'strong' WHEN f.signal IN {MODERATE} THEN 'moderate'
                    ELSE 'weak' END ORDER BY f.signal) AS signal_strengths,
               max(CASE WHEN f.signal IN {STRONG} THEN 1 ELSE 0 END) AS has_strong_signal
        FROM payment_flags f LEFT JOIN signal_classification l ON f.signal = l.signal GROUP BY f.payment_id""",
    "silver": """
        SELECT p.payment_id, p.beneficiary_id, p.claim_id, b.program, b.state, p.payment_amount_usd, p.queue_date,
               p.payment_status, c.claim_type, s.n_signals, s.signal_list, s.signal_categories, s.signal_category_set,
               s.ai_classification_min_confidence, s.signal_strengths,
               CASE WHEN s.n_signals >= 2 AND s.has_strong_signal = 1 THEN 'high'
                    WHEN s.n_signals >= 1 THEN 'moderate' ELSE 'low' END AS risk_level
        FROM payments p JOIN beneficiaries b ON p.beneficiary_id = b.beneficiary_id
        LEFT JOIN claims c ON p.claim_id = c.claim_id JOIN summary s ON p.payment_id = s.payment_id""",
    "silver_outcomes": """
        SELECT o.case_id, o.beneficiary_id, b.program, b.state, o.case_date, o.amount_usd, o.n_signals,
               CASE WHEN o.n_signals >= 3 THEN 'stacked_strong' WHEN o.n_signals = 2 THEN 'mixed'
                    WHEN o.n_signals = 1 THEN 'single' ELSE 'none' END AS signal_strength_mix,
               o.disposition_chosen, o.was_improper, o.recovery_amount_usd, o.days_to_resolution
        FROM outcomes_raw o LEFT JOIN beneficiaries b ON o.beneficiary_id = b.beneficiary_id""",
    "open_queue": """
        SELECT q.*, CAST(round(improper_payment_exposure_usd * 0.65, 2) AS DECIMAL(18,2))
                    AS projected_recovery_if_investigated_usd,
               CASE WHEN list_contains(signal_strengths, 'strong') THEN 1 ELSE 0 END AS has_strong
        FROM (SELECT *, CAST(round(payment_amount_usd * CASE risk_level WHEN 'high' THEN 0.80 WHEN 'moderate' THEN 0.15
                        ELSE 0.02 END, 2) AS DECIMAL(18,2)) AS improper_payment_exposure_usd
              FROM silver WHERE queue_date <= DATE '2001-07-31') q""",
    "recs": """
        SELECT payment_id, program, risk_level, n_signals, signal_list, signal_categories, signal_category_set,
               ai_classification_min_confidence, improper_payment_exposure_usd, projected_recovery_if_investigated_usd,
               CASE WHEN n_signals >= 3 THEN 'refer_to_investigation' WHEN n_signals = 2 OR has_strong = 1
                    THEN 'hold_for_verification' ELSE 'release' END AS recommended_disposition,
               CASE WHEN n_signals >= 2 AND has_strong = 1 THEN 0.95::DOUBLE WHEN n_signals = 1 THEN 0.70::DOUBLE
                    ELSE 0.40::DOUBLE END AS confidence_score,
               citizen_delay_cost_usd,
               upper(risk_level[1]) || substring(risk_level, 2) || '-risk: ' || CAST(n_signals AS VARCHAR)
               || ' fraud signal(s) on a $' || format('{:,.0f}', CAST(payment_amount_usd AS DOUBLE)) || ' ' || program
               || ' payment → estimated $' || format('{:,.0f}', CAST(improper_payment_exposure_usd AS DOUBLE))
               || ' improper exposure, $' || format('{:,.0f}', CAST(projected_recovery_if_investigated_usd AS DOUBLE))
               || ' projected recovery if investigated. '
               || CASE WHEN n_signals >= 3 THEN
                  'Recommend refer-to-investigation: stacked signals justify a full investigation.'
                  WHEN n_signals = 2 OR has_strong = 1 THEN 'Recommend hold-for-verification: verification (~$'
                  || format('{:,.0f}', CAST(citizen_delay_cost_usd AS DOUBLE))
                  || ' delay cost over 3 days) confirms before disbursement. '
                  || 'If improper, recovery is preserved pre-disbursement.'
                  ELSE 'Recommend release: single weak signal; citizen-delay cost of holding a likely-legitimate payment '
                  || 'outweighs the low projected recovery.' END AS reasoning,
               'Case memo — Payment ' || CAST(payment_id AS VARCHAR) || ' (' || program || ', $'
               || format('{:,.0f}', CAST(payment_amount_usd AS DOUBLE)) || '): ' || CAST(n_signals AS VARCHAR)
               || ' fraud signal(s) [' || array_to_string(signal_list, ', ') || ']. Risk level ' || risk_level
               || '. Improper exposure $' || format('{:,.0f}', CAST(improper_payment_exposure_usd AS DOUBLE))
               || '. Prescribed disposition: ' || CASE WHEN n_signals >= 3 THEN 'refer to investigation.'
                  WHEN n_signals = 2 OR has_strong = 1 THEN 'hold for verification.' ELSE 'release.' END AS memo_scaffold
        FROM (SELECT *, CAST(round(payment_amount_usd * 0.005 * 3, 2) AS DECIMAL(18,2)) AS citizen_delay_cost_usd
              FROM open_queue) b""",
    "scored": """
        SELECT q.payment_id, q.program, q.risk_level, q.state, q.payment_amount_usd, q.queue_date, q.n_signals,
               q.signal_list, q.signal_categories, q.signal_category_set, q.ai_classification_min_confidence,
               q.improper_payment_exposure_usd, q.projected_recovery_if_investigated_usd, r.recommended_disposition,
               r.confidence_score
        FROM open_queue q JOIN recs r ON q.payment_id = r.payment_id""",
    "case_outcomes": """
        SELECT case_id, n_signals, signal_strength_mix, amount_usd, disposition_chosen, was_improper,
               recovery_amount_usd, days_to_resolution,
               CASE WHEN was_improper AND recovery_amount_usd > 0 THEN recovery_amount_usd ELSE 0 END AS recovery_outcome
        FROM silver_outcomes""",
    # serving mirrors
    "positions": """
        SELECT payment_id, program, state, payment_amount_usd, CAST(queue_date AS VARCHAR) AS queue_date, n_signals,
               array_to_string(signal_list, ', ') AS signals, risk_level, improper_payment_exposure_usd,
               projected_recovery_if_investigated_usd FROM scored""",
    "flag_mirror": """
        SELECT payment_id, n_signals, array_to_string(signal_list, ', ') AS signal_list,
               improper_payment_exposure_usd, risk_level FROM open_queue""",
    "rec_mirror": """
        SELECT payment_id, recommended_disposition, confidence_score,
               CASE WHEN recommended_disposition = 'hold_for_verification' THEN 72 END AS recommended_hold_hours,
               projected_recovery_if_investigated_usd AS predicted_recovery_usd,
               citizen_delay_cost_usd AS predicted_cost_usd, improper_payment_exposure_usd, reasoning FROM recs""",
    # decisions
    "case_actions": f"""
        SELECT event_id AS id, (event_id * 7) % 3000 AS payment_id, {SIG}[1 + event_id % 8] AS signal_type,
               {ACTION} AS action_type,
               CASE WHEN event_type = 'signup' THEN 24 * (1 + event_id % 4) END AS hold_duration_hours,
               'memo ' || CAST(event_id AS VARCHAR) AS drafted_request,
               CAST(value AS DECIMAL(18,2)) AS predicted_recovery_usd, {STATUS}[1 + event_id % 4] AS status,
               CASE WHEN event_id % 10 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) END AS approved_by,
               ts AS created_at,
               CASE WHEN event_id % 4 <> 0 THEN ts + to_minutes(CAST(event_id % 60 AS BIGINT)) END AS decided_at
        FROM events WHERE event_type IN ('purchase', 'signup', 'error')""",
    "latest_action": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY payment_id
               ORDER BY created_at DESC, id DESC) AS rn FROM case_actions) WHERE rn = 1""",
    "live_queue": """
        SELECT p.*, dr.recommended_disposition, dr.confidence_score, dr.recommended_hold_hours,
               la.action_type AS live_disposition, la.status AS action_status, la.approved_by, la.decided_at,
               la.hold_duration_hours, la.created_at
        FROM positions p LEFT JOIN rec_mirror dr ON dr.payment_id = p.payment_id
        LEFT JOIN latest_action la ON la.payment_id = p.payment_id""",
    "action_options": """
        SELECT payment_id, 'release' AS disposition, 0 AS hold_hours, CAST(0 AS DECIMAL(18,2)) AS cost_usd,
               CAST(0 AS DECIMAL(18,2)) AS predicted_recovery_usd, CAST(0 AS DECIMAL(18,2)) AS predicted_net_value_usd
        FROM rec_mirror
        UNION ALL SELECT payment_id, 'hold_for_verification', 72, coalesce(predicted_cost_usd, 0),
               coalesce(predicted_recovery_usd, 0), coalesce(predicted_recovery_usd, 0) - coalesce(predicted_cost_usd, 0)
        FROM rec_mirror
        UNION ALL SELECT payment_id, 'refer_to_investigation', 240, refer_cost, coalesce(improper_payment_exposure_usd, 0),
               coalesce(improper_payment_exposure_usd, 0) - refer_cost
        FROM (SELECT *, CAST(((CAST(coalesce(predicted_cost_usd, 0) * 100 AS BIGINT) * 20 + 3) // 6) * 0.01
                             AS DECIMAL(18,2)) AS refer_cost FROM rec_mirror)""",
    "change_feed": f"""
        SELECT id, event_id, status, action_type, change_type AS _pg_change_type, event_id * 64 AS _pg_lsn,
               event_id AS _pg_xid, ts AS _timestamp,
               event_id * 2 + CASE WHEN change_type = 'update_postimage' THEN 1 ELSE 0 END AS _sort_by
        FROM (
          SELECT id, event_id, ts, status, action_type,
                 CASE WHEN first_event = event_id THEN 'insert' WHEN last_event = event_id AND event_type = 'error'
                      THEN 'delete' ELSE 'update_postimage' END AS change_type
          FROM ordered_events
          UNION ALL
          SELECT id, event_id, ts, prev_status, prev_action, 'update_preimage' FROM ordered_events
          WHERE first_event <> event_id AND NOT (last_event = event_id AND event_type = 'error'))""",
    "ordered_events": f"""
        SELECT user_id AS id, event_id, ts, event_type, {STATUS}[1 + event_id % 4] AS status, {ACTION} AS action_type,
               min(event_id) OVER (PARTITION BY user_id) AS first_event,
               max(event_id) OVER (PARTITION BY user_id) AS last_event,
               lag({STATUS}[1 + event_id % 4]) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_status,
               lag({ACTION}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_action
        FROM events""",
    # usage
    "usage_facts": """
        SELECT event_id AS usage_id, 'w' || CAST(user_id % 3 AS VARCHAR) AS workspace_id,
               CASE event_type WHEN 'view' THEN 'MODEL_SERVING' WHEN 'click' THEN 'AI_GATEWAY' WHEN 'purchase' THEN 'APPS'
                    WHEN 'signup' THEN 'GENIE' WHEN 'error' THEN 'OTHER' END AS billing_origin_product,
               upper(event_type) AS sku_name, 'DBU' AS usage_unit, CAST(value AS DECIMAL(18,4)) AS usage_quantity,
               ts AS usage_end_time, CAST(ts AS DATE) AS usage_date, event_id % 2 = 0 AS is_serverless,
               event_id % 3 = 0 AS is_photon,
               CASE WHEN user_id % 4 <> 0 THEN 'p' || CAST(user_id % 4 AS VARCHAR) END AS budget_policy_id,
               'team' || CAST(user_id % 5 AS VARCHAR) AS team
        FROM events""",
    "price_list": """
        SELECT sku_name, 'DBU' AS usage_unit, price_start_time, price_end_time, unit_price FROM (VALUES
            ('VIEW', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 0.07), ('VIEW', TIMESTAMP '2024-01-16', NULL, 0.08),
            ('CLICK', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 0.10), ('CLICK', TIMESTAMP '2024-01-16', NULL, 0.12),
            ('PURCHASE', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 0.95),
            ('PURCHASE', TIMESTAMP '2024-01-16', NULL, 0.95),
            ('SIGNUP', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', 0.04), ('SIGNUP', TIMESTAMP '2024-01-16', NULL, 0.05)
        ) v(sku_name, price_start_time, price_end_time, unit_price)""",
    "priced_half_open": """
        SELECT u.*, p.unit_price, u.usage_quantity * p.unit_price AS cost
        FROM usage_facts u LEFT JOIN price_list p ON u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit
         AND u.usage_end_time >= p.price_start_time
         AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)""",
    "priced_closed": """
        SELECT u.*, p.unit_price, u.usage_quantity * p.unit_price AS cost
        FROM usage_facts u LEFT JOIN price_list p ON u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit
         AND u.usage_end_time BETWEEN p.price_start_time AND coalesce(p.price_end_time, TIMESTAMP '2024-01-31')""",
    "serving_usage": """
        SELECT event_id AS request_id, ts AS request_time, 'user' || CAST(user_id AS VARCHAR) AS requester,
               user_id % 4 AS served_entity_id, CAST(floor(value * 10) AS BIGINT) AS input_token_count,
               CAST(floor(value) AS BIGINT) AS output_token_count, 'w' || CAST(user_id % 3 AS VARCHAR) AS workspace_id,
               props AS request FROM events""",
    "served_entities": """
        SELECT * FROM (VALUES (0, 'governed-agent', 'EXTERNAL_MODEL', 'chat'),
            (1, 'text-embedder', 'FOUNDATION_MODEL', 'embedding'), (2, 'coding-assistant', 'EXTERNAL_MODEL', 'chat'))
            v(served_entity_id, endpoint_name, entity_type, task)""",
    # conversations
    "messages": """
        SELECT conv_id AS conversation_id, turn AS position, role, text AS content,
               TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS created_at,
               CASE WHEN role = 'assistant' AND conv_id % 2 = 0
                    THEN ['find_flag','rank_dispositions','ask_data'][1 + turn % 3] END AS tool
        FROM conversations""",
    "chats": """
        SELECT conversation_id AS id, 'user' || CAST(conversation_id % 10 AS VARCHAR) AS user_email,
               'Conversation ' || CAST(conversation_id AS VARCHAR) AS title, min(created_at) AS created_at,
               max(created_at) AS updated_at FROM messages GROUP BY conversation_id""",
    "feedback": """
        SELECT conversation_id, position, created_at, CASE WHEN position % 2 = 0 THEN 'down' ELSE 'up' END AS value
        FROM messages WHERE role = 'assistant' AND conversation_id % 3 = 0""",
    # search
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "partly_embedded": """
        SELECT vec_id, CASE WHEN vec_id % 50 <> 49 THEN CAST(embedding AS DOUBLE[]) END AS embedding FROM embeddings""",
    "playbooks": f"""
        SELECT 'guide-' || CAST(doc_id AS VARCHAR) AS guide_id, 'Guide ' || CAST(doc_id AS VARCHAR) AS title,
               'Agency ' || source AS agency, {PROGRAMS}[1 + doc_id % 5] AS program,
               {SIG}[1 + doc_id % 8] || ' review' AS scenario, text AS summary,
               ['confirm ' || {SIG}[1 + doc_id % 8], 'check records'] AS verification_steps,
               ['identity evidence', 'statement ' || CAST(doc_id % 7 AS VARCHAR)] AS required_documents,
               'hold at most ' || CAST(doc_id % 4 + 1 AS VARCHAR) || ' days' AS hold_guidance,
               'Section ' || CAST(doc_id % 90 AS VARCHAR) AS authority_citation
        FROM documents""",
}


def _mentioned(sql: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b{name}\b", sql)}


def statement(body: str) -> str:
    """The body with every domain table it needs, directly or not, as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in _mentioned(CTES[name]) - {name}:
            visit(other)
        needed.append(name)

    own = set(re.findall(r"(?:\bWITH\b|,)\s*(\w+) AS \(", body))
    for name in sorted(_mentioned(body) - own):
        visit(name)
    body = body.strip()
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n.rpartition('.')[2]}" for n in names)


def txt(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n.rpartition('.')[2]}" for n in names)


def arr(*names: str) -> str:
    return ", ".join(f"array_to_string({n}, ',') AS {n.rpartition('.')[2]}" for n in names)


def tim(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S.%f') AS {n.rpartition('.')[2]}" for n in names)


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n.rpartition('.')[2]}" for n in names)
