"""Silver and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import classify, scoring
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import arr, dbl, txt
from paywarden.sources.tables import ONSET_DATE

E, V = "improper_payment_exposure_usd", "projected_recovery_if_investigated_usd"
LISTS = arr("signal_list", "signal_categories", "signal_category_set")


@query("payment_signal_summary", f"""
    SELECT payment_id, n_signals, {LISTS}, ai_classification_min_confidence, {arr('signal_strengths')},
           has_strong_signal FROM summary""")
def payment_signal_summary(c: Context) -> DataFrame:
    return c.s.summary.drop("signal_rows")


@query("classify_join", """
    SELECT f.payment_id, f.signal, coalesce(l.signal_category, 'unclassified') AS signal_category
    FROM payment_flags f LEFT JOIN (SELECT * FROM signal_classification WHERE signal <> 'manual_review_flag') l
      ON f.signal = l.signal""")
def classify_join(c: Context) -> DataFrame:
    """One label is missing on purpose."""
    labels = c.t.signal_classification().filter(F.col("signal") != "manual_review_flag")
    return scoring.classify_flags(c.t.payment_flags(), labels).select("payment_id", "signal", "signal_category")


@query("silver_payments_flagged", f"""
    SELECT payment_id, beneficiary_id, claim_id, program, state, {dbl('payment_amount_usd')}, {txt('queue_date')},
           payment_status, claim_type, n_signals, {LISTS}, ai_classification_min_confidence, {arr('signal_strengths')},
           risk_level FROM silver""")
def silver_payments_flagged(c: Context) -> DataFrame:
    return c.s.silver


@query("silver_outcomes", f"""
    SELECT case_id, beneficiary_id, program, state, {txt('case_date')}, {dbl('amount_usd')}, n_signals,
           signal_strength_mix, disposition_chosen, was_improper, {dbl('recovery_amount_usd')}, days_to_resolution
    FROM silver_outcomes""")
def silver_outcomes(c: Context) -> DataFrame:
    return c.s.silver_outcomes


@query("gold_open_queue", f"""
    SELECT payment_id, beneficiary_id, program, state, {dbl('payment_amount_usd')}, {txt('queue_date')}, n_signals,
           {LISTS}, ai_classification_min_confidence, {arr('signal_strengths')}, risk_level, {dbl(E, V)}, has_strong
    FROM open_queue""")
def gold_open_queue(c: Context) -> DataFrame:
    return c.s.queue


@query("gold_recommendations", f"""
    SELECT payment_id, program, risk_level, n_signals, {LISTS}, ai_classification_min_confidence, {dbl(E, V)},
           recommended_disposition, confidence_score, {dbl('citizen_delay_cost_usd')}, reasoning, memo_scaffold FROM recs""")
def gold_recommendations(c: Context) -> DataFrame:
    return c.s.recs


@query("gold_queue_scored", f"""
    SELECT payment_id, program, risk_level, state, {dbl('payment_amount_usd')}, {txt('queue_date')}, n_signals, {LISTS},
           ai_classification_min_confidence, {dbl(E, V)}, recommended_disposition, confidence_score FROM scored""")
def gold_queue_scored(c: Context) -> DataFrame:
    return c.s.scored


@query("gold_case_outcomes", f"""
    SELECT case_id, n_signals, signal_strength_mix, {dbl('amount_usd')}, disposition_chosen, was_improper,
           {dbl('recovery_amount_usd')}, days_to_resolution, {dbl('recovery_outcome')} FROM case_outcomes""")
def gold_case_outcomes(c: Context) -> DataFrame:
    return c.s.outcomes


@query("classify_signals", """
    SELECT DISTINCT f.signal, l.signal_category, CAST(NULL AS DOUBLE) AS classification_confidence,
           CAST(NULL AS VARCHAR) AS classification_error
    FROM payment_flags f JOIN signal_classification l ON f.signal = l.signal""")
def classify_signals(c: Context) -> DataFrame:
    return classify.require_all_classified(classify.classify_signals(c.t.payment_flags()))


@query("distinct_signals", """
    SELECT DISTINCT signal, replace(signal, '_', ' ') AS signal_text FROM payment_flags WHERE signal IS NOT NULL""")
def distinct_signals(c: Context) -> DataFrame:
    return classify.distinct_signals(c.t.payment_flags())


@query("flag_inheritance", """
    SELECT DISTINCT p.payment_id, t.signal, CAST(p.queue_date AS VARCHAR) AS queue_date
    FROM payments p JOIN beneficiaries b ON p.beneficiary_id = b.beneficiary_id,
         unnest(string_split(b.signal_tags, ' | ')) t(signal)
    WHERE b.signal_tags IS NOT NULL AND (p.queue_date >= DATE '1999-01-01' OR (p.payment_id * 31) % 100 < 15)""")
def flag_inheritance(c: Context) -> DataFrame:
    draw = F.col("payment_id") * 31 % 100
    return scoring.inherit_flags(c.t.payments(), c.t.beneficiaries(), ONSET_DATE, 15, draw)
