"""Disposition model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import learning as L
from paywarden.plans.registry import Context, query


@query("disposition_features", """
    SELECT 'train' AS part, case_id AS id, n_signals, signal_strength_mix, CAST(amount_usd AS DOUBLE) AS amount_usd,
           coalesce(program, '?') AS program, coalesce(state, '?') AS state, disposition_chosen AS disposition,
           days_to_resolution AS days_estimate FROM silver_outcomes
    UNION ALL
    SELECT 'candidate', q.payment_id, q.n_signals, CASE WHEN q.n_signals >= 3 THEN 'stacked_strong'
           WHEN q.n_signals = 2 THEN 'mixed' WHEN q.n_signals = 1 THEN 'single' ELSE 'none' END,
           CAST(q.payment_amount_usd AS DOUBLE), coalesce(q.program, '?'), coalesce(q.state, '?'), d.disposition, d.days
    FROM open_queue q, (VALUES ('release', 0), ('hold_for_verification', 5), ('refer_to_investigation', 22))
         d(disposition, days)""")
def disposition_features(c: Context) -> DataFrame:
    cols = ["n_signals", "signal_strength_mix", "amount_usd", "program", "state", "disposition", "days_estimate"]
    seen = L.training_rows(c.s.silver_outcomes).select(
        F.lit("train").alias("part"), F.col("case_id").alias("id"), *cols)
    return seen.unionByName(L.candidate_rows(c.s.queue).select(
        F.lit("candidate").alias("part"), F.col("payment_id").alias("id"), *cols))


@query("disposition_model")
def disposition_model(c: Context) -> DataFrame:
    """Recommended disposition per open payment by the trained model."""
    model = L.train(L.training_rows(c.s.silver_outcomes))
    return L.score(model, L.candidate_rows(c.s.queue)).select(
        "payment_id", F.col("disposition").alias("recommended_disposition"),
        F.round("improper_probability", 6).alias("improper_probability"),
        F.round("predicted_recovery_usd", 2).alias("predicted_recovery_usd"),
        F.round("predicted_net_value_usd", 2).alias("predicted_net_value_usd"))
