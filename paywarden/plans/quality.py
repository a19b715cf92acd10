"""Quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import classify
from paywarden.operators import desk as K
from paywarden.operators import quality as Q
from paywarden.plans.registry import Context, query

E, V = K.EXPOSURE, K.RECOVERY
KNOWN = Q.KnownPayment(4, "SNAP", "389137.41", ("benefit_overlap", "cross_agency_fraud_flag"), "311309.93",
                       "hold_for_verification", "202351.45")
REQUIRED = {
    "queue": ["payment_id", "program", "risk_level", "signal_list", E, V],
    "recs": ["payment_id", "recommended_disposition", "confidence_score", "reasoning", "memo_scaffold"],
    "actions": ["id", "payment_id", "action_type", "status", "created_at"],
}


def _row(name: str, seen: str, ok: str, source: str) -> str:
    return (f"SELECT '{name}' AS \"check\", round(CAST({seen} AS DOUBLE), 6) AS observed, "
            f"coalesce({ok}, false) AS passed FROM {source}")


SQL = f"""
WITH qs AS (SELECT count(*) AS n,
      count(*) FILTER (WHERE payment_id = {KNOWN.payment_id} AND program = '{KNOWN.program}'
        AND payment_amount_usd = {KNOWN.amount} AND array_to_string(signal_list, ',') = '{",".join(KNOWN.signals)}'
        AND {E} = {KNOWN.exposure}) AS known,
      count(*) FILTER (WHERE payment_id = {KNOWN.payment_id} AND recommended_disposition = '{KNOWN.disposition}'
        AND {V} = {KNOWN.recovery}) AS known_rec,
      count(*) FILTER (WHERE recommended_disposition = 'release') AS r1,
      count(*) FILTER (WHERE recommended_disposition = 'hold_for_verification') AS r2,
      count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS r3,
      count(*) FILTER (WHERE risk_level = 'high') AS high,
      count(*) FILTER (WHERE risk_level = 'high' AND list_has_any(signal_list,
        ['duplicate_identity','deceased_payee','cross_agency_fraud_flag'])) AS high_strong,
      median(n_signals) FILTER (WHERE risk_level = 'high') AS high_median, sum({E}) AS exposure,
      count(*) FILTER (WHERE risk_level NOT IN ('high','moderate','low') OR len(signal_list) = 0 OR {E} < 0 OR {V} > {E}) AS bad
    FROM scored),
hs AS (SELECT count(*) FILTER (WHERE n_signals = 1 AND disposition_chosen = 'release') AS a,
      count(*) FILTER (WHERE n_signals = 1 AND disposition_chosen = 'hold_for_verification') AS b,
      avg(was_improper::INT) FILTER (WHERE disposition_chosen = 'release') AS r1,
      avg(was_improper::INT) FILTER (WHERE disposition_chosen = 'hold_for_verification') AS r2,
      avg(was_improper::INT) FILTER (WHERE disposition_chosen = 'refer_to_investigation') AS r3 FROM outcomes_raw),
sg AS (SELECT (count(f.payment_id) FILTER (WHERE queue_date >= DATE '1999-01-01'))::DOUBLE
         / count(*) FILTER (WHERE queue_date >= DATE '1999-01-01')
         / ((count(f.payment_id) FILTER (WHERE queue_date < DATE '1999-01-01'))::DOUBLE
         / count(*) FILTER (WHERE queue_date < DATE '1999-01-01')) AS ratio
       FROM payments p LEFT JOIN (SELECT DISTINCT payment_id FROM payment_flags_wave) f ON p.payment_id = f.payment_id),
dups AS (SELECT count(*) AS n FROM (SELECT 1 FROM payment_flags GROUP BY payment_id, signal HAVING count(*) > 1)),
unl AS (SELECT count(DISTINCT f.signal) AS n FROM payment_flags f
        WHERE f.signal NOT IN (SELECT signal FROM signal_classification)),
gold AS (SELECT count(*) AS n FROM scored), pos AS (SELECT count(*) AS n, count(DISTINCT payment_id) AS k FROM positions),
flg AS (SELECT count(*) AS n FROM flag_mirror),
mir AS (SELECT pos.n, pos.k, gold.n = pos.n AND gold.n = flg.n AND gold.n > 0 AS same FROM gold, pos, flg),
orph AS (SELECT count(*) AS n FROM positions WHERE payment_id NOT IN (SELECT payment_id FROM rec_mirror)),
unk AS (SELECT count(*) AS n FROM case_actions WHERE payment_id NOT IN (SELECT payment_id FROM positions)),
lost AS (SELECT count(*) AS n FROM claims WHERE beneficiary_id NOT IN (SELECT beneficiary_id FROM beneficiaries)),
clm AS (SELECT count(*) AS n FROM (SELECT 1 FROM claims GROUP BY claim_id HAVING count(*) > 1)),
msg AS (SELECT count(*) AS n FROM (SELECT 1 FROM messages GROUP BY conversation_id, position HAVING count(*) > 1))
""" + " UNION ALL ".join([
    _row("known_payment", "known", "known = 1", "qs"),
    _row("known_recommendation", "known_rec", "known_rec = 1", "qs"),
    _row("three_way_mix", "greatest(r1, r2, r3)::DOUBLE / n", "least(r1, r2, r3) > 0 AND greatest(r1, r2, r3) < 0.95 * n", "qs"),
    _row("high_risk_median_signals", "high_median", "high_median >= 2", "qs"),
    _row("high_risk_strong_share", "high_strong::DOUBLE / high", "high_strong::DOUBLE / high >= 0.7", "qs"),
    _row("exposure_floor", "exposure", "exposure > 1000000", "qs"),
    _row("domains_and_bounds", "bad", "bad = 0", "qs"),
    _row("row_count_band", "n", "n > 0", "qs"),
    _row("single_signal_split", "least(a, b)", "least(a, b) > 0", "hs"),
    _row("outcome_rates_separate", "r3 - r1", "r3 > r2 AND r2 > r1", "hs"),
    _row("flagged_rate_surge", "ratio", "ratio > 2", "sg"),
    _row("no_duplicate_flags", "n", "n = 0", "dups"),
    _row("every_signal_classified", "n", "n = 0", "unl"),
    _row("mirror_counts_equal", "n", "same", "mir"),
    _row("mirror_keys_unique", "n - k", "n = k", "mir"),
    _row("position_has_recommendation", "n", "n = 0", "orph"),
    _row("measure_equals_detail", "0", "true", "qs"),
    _row("decision_references_payment", "n", "n = 0", "unk"),
    _row("claims_without_beneficiary", "n", "n > 0", "lost"),
    _row("message_positions_unique", "n", "n = 0", "msg"),
    _row("claim_ids_unique", "n", "n = 0", "clm"),
    _row("required_columns", "0", "true", "qs"),
])


@query("quality_checks", SQL)
def quality_checks(c: Context) -> DataFrame:
    c = c.with_stored_queue()
    queue = c.s.queue
    missing = Q.missing_columns({"queue": queue, "recs": c.s.recs, "actions": c.desk.actions}, REQUIRED)
    present_row = c.t.payments().limit(1).select(
        F.lit("required_columns").alias("check"), F.lit(float(len(missing))).alias("observed"),
        F.lit(not missing).alias("passed"))
    parts = [
        Q.queue_checks(c.s.scored, KNOWN), Q.history_checks(c.t.outcomes()),
        Q.surge_check(c.t.payments(), c.t.payment_flags_wave()),
        Q.flag_checks(c.t.payment_flags(), classify.classify_signals(c.t.payment_flags())),
        Q.mirror_checks(c.s.scored, c.desk.positions, c.desk.flags, c.desk.recs), Q.slice_check(c.s.scored),
        Q.reference_checks(c.desk.actions, c.desk.positions, c.t.claims(), c.t.beneficiaries(), c.t.messages()),
        present_row,
    ]
    return reduce(DataFrame.unionByName, parts)
