"""Measures, rollups, trends and top lists over the scored queue and the case history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.operators import desk as K
from paywarden.operators import measures as M
from paywarden.operators.upkeep import PartStore
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import arr, dbl, txt
from paywarden.session import work_dir
from paywarden.sources.tables import ONSET_DATE, QUEUE_AS_OF

E, V = K.EXPOSURE, K.RECOVERY

MEASURES_SQL = f"""count(*) AS payment_count, CAST(sum(payment_amount_usd) AS DOUBLE) AS total_queue_value_usd,
    count(*) AS flagged_payment_count, CAST(sum({E}) AS DOUBLE) AS {E}, CAST(sum({V}) AS DOUBLE) AS {V},
    CAST(sum(payment_amount_usd) AS DOUBLE) / count(*) AS avg_payment_amount_usd,
    CAST(sum(n_signals) AS DOUBLE) / count(*) AS avg_n_signals,
    count(*) FILTER (WHERE confidence_score >= 0.85) AS high_confidence_count,
    count(*) FILTER (WHERE recommended_disposition = 'release') AS release_recommended_count,
    count(*) FILTER (WHERE recommended_disposition = 'hold_for_verification') AS hold_recommended_count,
    count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS investigate_recommended_count"""


@query("metric_view", f"""
    SELECT program, risk_level, recommended_disposition, {MEASURES_SQL} FROM scored
    GROUP BY program, risk_level, recommended_disposition""")
def metric_view(c: Context) -> DataFrame:
    return M.measure(c.s.scored, M.DIMENSIONS)


@query("measure_total", f"""
    SELECT CAST(round(sum({E})) AS DOUBLE) AS improper_exposure_usd, count(*) AS flagged_cases FROM scored""")
def measure_total(c: Context) -> DataFrame:
    return M.measure(c.s.scored, [], [E, "flagged_payment_count"]).select(
        F.round(E).alias("improper_exposure_usd"), F.col("flagged_payment_count").alias("flagged_cases"))


@query("measure_by_risk", f"""
    SELECT risk_level, CAST(round(sum({E})) AS DOUBLE) AS improper_exposure_usd, count(*) AS flagged_cases
    FROM scored GROUP BY risk_level""")
def measure_by_risk(c: Context) -> DataFrame:
    return M.measure(c.s.scored, ["risk_level"], [E, "flagged_payment_count"]).select(
        "risk_level", F.round(E).alias("improper_exposure_usd"),
        F.col("flagged_payment_count").alias("flagged_cases")).orderBy(F.desc("improper_exposure_usd"))


FOUR = [E, "flagged_payment_count", V, "investigate_recommended_count"]


@query("measure_by_program_risk", f"""
    SELECT program, risk_level, CAST(sum({E}) AS DOUBLE) AS {E}, count(*) AS flagged_payment_count,
           CAST(sum({V}) AS DOUBLE) AS {V},
           count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS investigate_recommended_count
    FROM scored GROUP BY ALL""")
def measure_by_program_risk(c: Context) -> DataFrame:
    return M.measure(c.s.scored, ["program", "risk_level"], FOUR)


@query("dashboard_rollup", f"""
    SELECT program, CAST(sum({E}) AS DOUBLE) AS exposure_usd, count(*) AS flagged, CAST(sum({V}) AS DOUBLE) AS recovery_usd,
           count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS investigate
    FROM scored WHERE program IN ('TANF', 'SNAP') AND risk_level IN ('high', 'moderate') GROUP BY ROLLUP (program)""")
def dashboard_rollup(c: Context) -> DataFrame:
    """Counters (program NULL) and bars re-summed from the program × risk rows after the filters."""
    rows = M.measure(c.s.scored, ["program", "risk_level"], FOUR)
    rows = M.dashboard_counters(rows, ["TANF", "SNAP"], ["high", "moderate"])
    return rows.rollup("program").agg(
        F.sum(E).alias("exposure_usd"), F.sum("flagged_payment_count").alias("flagged"), F.sum(V).alias("recovery_usd"),
        F.sum("investigate_recommended_count").alias("investigate"))


@query("aggregate_materialization", " UNION ALL ".join(
    f"SELECT {', '.join((d if d in dims else f'CAST(NULL AS VARCHAR) AS {d}') for d in M.DIMENSIONS)}, "
    f"{sum(1 << i for i, d in enumerate(M.DIMENSIONS) if d in dims)} AS grouping, {MEASURES_SQL} FROM scored"
    + (f" GROUP BY {', '.join(dims)}" if dims else "")
    for dims in ([d for i, d in enumerate(M.DIMENSIONS) if m >> i & 1] for m in range(8))))
def aggregate_materialization(c: Context) -> DataFrame:
    """Parts stored once at the finest grain answer all eight groupings."""
    path = work_dir(c.spark, "measure-parts")
    fine = M.parts(c.s.scored, M.DIMENSIONS)
    fine.write.mode("overwrite").parquet(path)
    stored, out = c.spark.read.schema(fine.schema).parquet(path), None
    for mask in range(8):
        dims = [d for i, d in enumerate(M.DIMENSIONS) if mask >> i & 1]
        one = M.finish(M.coarser(stored, dims), dims).select(
            *[F.col(d) if d in dims else F.lit(None).cast("string").alias(d) for d in M.DIMENSIONS],
            F.lit(mask).alias("grouping"), *M.MEASURES)
        out = one if out is None else out.unionByName(one)
    return out


@query("aggregate_upkeep", f"""
    SELECT program, risk_level, recommended_disposition, {MEASURES_SQL} FROM scored
    GROUP BY program, risk_level, recommended_disposition""")
def aggregate_upkeep(c: Context) -> DataFrame:
    """Measures from parts that three batches of changes kept up to date.

    First the queue as it stood 60 days before its last day; of the payments of the 60 days before that, the first assessment
    (release, no confidence). Then the newer payments come in, then the first assessments are replaced by the final ones.
    """
    rows = c.with_stored_queue().s.scored
    newer = F.col("queue_date") > F.lit(QUEUE_AS_OF - dt.timedelta(days=60))
    early = ~newer & (F.col("queue_date") > F.lit(QUEUE_AS_OF - dt.timedelta(days=120)))
    first = rows.filter(early).withColumn("recommended_disposition", F.lit(R.RELEASE)).withColumn("confidence_score", F.lit(0.0))
    store = PartStore(c.spark, work_dir(c.spark, "measure-upkeep"), M.DIMENSIONS)
    undated = F.col("queue_date").isNull()
    store.apply(0, None, rows.filter(undated | ~newer & ~early).unionByName(first))
    store.apply(1, None, rows.filter(newer))
    store.apply(2, first, rows.filter(early))
    return store.measures(M.DIMENSIONS)


@query("exposure_by_program", f"""
    SELECT program, CAST(round(sum({E})) AS DOUBLE) AS improper_exposure_usd, count(*) AS flagged_cases
    FROM open_queue GROUP BY program""")
def exposure_by_program(c: Context) -> DataFrame:
    return c.s.queue.groupBy("program").agg(
        F.round(F.sum(E)).alias("improper_exposure_usd"), F.count(F.lit(1)).alias("flagged_cases"),
    ).orderBy(F.desc("improper_exposure_usd"))


@query("program_breakdown", f"""
    SELECT coalesce(program, 'Unknown') AS program, count(*) AS flagged_count, CAST(sum({E}) AS DOUBLE) AS {E},
           CASE WHEN min(CASE risk_level WHEN 'high' THEN 0 ELSE 1 END) = 0 THEN 'high' ELSE 'moderate' END AS risk_level
    FROM positions GROUP BY positions.program ORDER BY 3 DESC LIMIT 50""")
def program_breakdown(c: Context) -> DataFrame:
    return K.program_breakdown(c.desk.positions)


@query("queue_summary", f"""
    SELECT CAST(coalesce(sum(p.{E}) FILTER (WHERE a.payment_id IS NULL), 0) AS DOUBLE) AS {E},
           CAST(coalesce(sum(p.{V}) FILTER (WHERE a.payment_id IS NULL), 0) AS DOUBLE) AS projected_recovery_usd,
           count(*) FILTER (WHERE a.payment_id IS NULL) AS flagged_count,
           count(*) FILTER (WHERE a.payment_id IS NULL AND dr.recommended_disposition = 'refer_to_investigation')
             AS refer_recommended_count
    FROM positions p LEFT JOIN (SELECT DISTINCT payment_id FROM case_actions) a ON a.payment_id = p.payment_id
    LEFT JOIN rec_mirror dr ON dr.payment_id = p.payment_id""")
def queue_summary(c: Context) -> DataFrame:
    return K.queue_summary(c.desk.positions_with_recs, c.desk.actions)


@query("disposition_mix", f"""
    SELECT recommended_disposition, count(*) AS case_count, CAST(round(sum({V})) AS DOUBLE) AS projected_recovery_usd
    FROM recs GROUP BY 1""")
def disposition_mix(c: Context) -> DataFrame:
    return c.s.recs.groupBy("recommended_disposition").agg(
        F.count(F.lit(1)).alias("case_count"), F.round(F.sum(V)).alias("projected_recovery_usd"))


@query("disposition_share", f"""
    SELECT recommended_disposition, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS case_share,
           CAST(sum({V}) AS DOUBLE) * 100 / CAST(sum(sum({V})) OVER () AS DOUBLE) AS recovery_share FROM recs GROUP BY 1""")
def disposition_share(c: Context) -> DataFrame:
    per = c.s.recs.groupBy("recommended_disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(V).alias("usd"))
    total = per.agg(F.struct(F.sum("n").alias("n"), F.sum("usd").alias("usd"))).scalar()
    return per.withColumn("t", total).select(
        "recommended_disposition", (F.col("n") * F.lit(100.0) / F.col("t.n")).alias("case_share"),
        (F.col("usd").cast("double") * 100 / F.col("t.usd").cast("double")).alias("recovery_share"))


@query("flag_count_by_program", "SELECT program, count(*) AS flag_count FROM scored GROUP BY program")
def flag_count_by_program(c: Context) -> DataFrame:
    return c.s.scored.groupBy("program").agg(F.count(F.lit(1)).alias("flag_count")).orderBy(F.desc("flag_count"))


@query("weekly_risk_trend", """
    SELECT CAST(CAST(date_trunc('week', queue_date) AS DATE) AS VARCHAR) AS week, risk_level, count(*) AS flagged
    FROM scored WHERE queue_date >= DATE '2001-07-31' - 63 GROUP BY 1, 2""")
def weekly_risk_trend(c: Context) -> DataFrame:
    return M.weekly_trend(c.s.scored, QUEUE_AS_OF)


SIGNAL_COUNTS = """SELECT program, signal, count(DISTINCT payment_id) AS payment_count
    FROM (SELECT program, payment_id, unnest(signal_list) AS signal FROM open_queue) GROUP BY program, signal"""


@query("program_signal_counts", SIGNAL_COUNTS)
def program_signal_counts(c: Context) -> DataFrame:
    return M.program_signal_counts(c.s.queue)


@query("program_signal_counts_text", """
    SELECT p.program, trim(s.signal) AS signal, count(DISTINCT p.payment_id) AS payment_count
    FROM positions p, unnest(string_split(p.signals, ',')) s(signal)
    WHERE p.signals IS NOT NULL AND p.signals <> '' GROUP BY p.program, trim(s.signal)""")
def program_signal_counts_text(c: Context) -> DataFrame:
    return M.program_signal_counts_text(c.desk.positions)


@query("result_parity", "SELECT 0 AS only_left, 0 AS only_right, count(*) AS n_rows FROM (" + SIGNAL_COUNTS + ")")
def result_parity(c: Context) -> DataFrame:
    """Both query paths return the same rows; one pass per path, compared per row as a signed count."""
    c = c.with_stored_queue()
    left, right = M.program_signal_counts(c.s.queue), M.program_signal_counts_text(c.desk.positions)
    return parity(left, right)


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    cols = left.columns
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(-1)))
    diff = both.groupBy(*cols).agg(F.sum("side").alias("d"), F.count_if(F.col("side") == 1).alias("n"))
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_right"),
        F.sum("n").alias("n_rows"))


@query("program_summary", f"""
    SELECT program, count(*) AS flagged_payments, CAST(sum(n_signals) AS BIGINT) AS total_signals,
           round(CAST(sum(n_signals) AS DOUBLE) / count(*), 2) AS avg_signals_per_payment,
           CAST(round(sum({E}), 2) AS DOUBLE) AS total_exposure_usd FROM positions GROUP BY program""")
def program_summary(c: Context) -> DataFrame:
    return c.desk.positions.groupBy("program").agg(
        F.count(F.lit(1)).alias("flagged_payments"), F.sum("n_signals").alias("total_signals"),
        F.round(F.sum("n_signals").cast("double") / F.count(F.lit(1)), 2).alias("avg_signals_per_payment"),
        F.round(F.sum(E), 2).alias("total_exposure_usd"))


@query("outcome_matrix", """
    SELECT disposition_chosen, was_improper, count(*) AS n FROM silver_outcomes GROUP BY ALL""")
def outcome_matrix(c: Context) -> DataFrame:
    return c.t.outcomes().groupBy("disposition_chosen", "was_improper").agg(F.count(F.lit(1)).alias("n"))


RATES = """count(*) AS cases, CAST(count(*) FILTER (WHERE was_improper) AS DOUBLE) / count(*) AS improper_rate,
    round(CAST(sum(CAST(round(CAST(recovery_amount_usd AS DOUBLE) / CAST(amount_usd AS DOUBLE), 9) AS DECIMAL(12,9)))
      FILTER (WHERE was_improper) AS DOUBLE) / nullif(count(*) FILTER (WHERE was_improper), 0), 6) AS avg_recovery_share,
    CAST(sum(days_to_resolution) AS DOUBLE) / count(*) AS avg_days"""


@query("outcome_rates", f"""
    SELECT disposition_chosen, CAST(NULL AS BIGINT) AS n_signals, {RATES} FROM silver_outcomes GROUP BY 1
    UNION ALL SELECT disposition_chosen, n_signals, {RATES} FROM silver_outcomes GROUP BY 1, 2""")
def outcome_rates(c: Context) -> DataFrame:
    rows = c.t.outcomes()
    coarse = M.outcome_rates(rows, ["disposition_chosen"]).withColumn("n_signals", F.lit(None).cast("int"))
    return coarse.unionByName(M.outcome_rates(rows, ["disposition_chosen", "n_signals"]))


@query("recovery_by_disposition", """
    SELECT recommended_disposition, count(*) AS case_count, CAST(sum(predicted_recovery_usd) AS DOUBLE) AS recovery_usd
    FROM rec_mirror GROUP BY 1""")
def recovery_by_disposition(c: Context) -> DataFrame:
    return c.desk.recs.groupBy("recommended_disposition").agg(
        F.count(F.lit(1)).alias("case_count"), F.sum("predicted_recovery_usd").alias("recovery_usd"))


@query("signals_in_high_risk", """
    SELECT f.signal, count(DISTINCT f.payment_id) AS payment_count
    FROM payment_flags f JOIN open_queue q ON f.payment_id = q.payment_id WHERE q.risk_level = 'high' GROUP BY f.signal""")
def signals_in_high_risk(c: Context) -> DataFrame:
    high = c.s.queue.filter(F.col("risk_level") == "high").select("payment_id")
    return c.t.payment_flags().join(high, "payment_id").groupBy("signal").agg(
        F.countDistinct("payment_id").alias("payment_count"))


@query("semi_high_risk", """
    SELECT signal, count(DISTINCT payment_id) AS payment_count FROM payment_flags
    WHERE payment_id IN (SELECT payment_id FROM open_queue WHERE risk_level = 'high') GROUP BY signal""")
def semi_high_risk(c: Context) -> DataFrame:
    high = c.s.queue.filter(F.col("risk_level") == "high").select("payment_id")
    return c.t.payment_flags().join(high, "payment_id", "left_semi").groupBy("signal").agg(
        F.countDistinct("payment_id").alias("payment_count"))


@query("signal_recovery", f"""
    SELECT signal, count(DISTINCT payment_id) AS payment_count, CAST(sum({V}) AS DOUBLE) AS recovery_usd
    FROM (SELECT payment_id, {V}, unnest(signal_list) AS signal FROM open_queue WHERE risk_level = 'high') GROUP BY signal""")
def signal_recovery(c: Context) -> DataFrame:
    """The queue row already holds its distinct signals, so no second join to the flags is needed."""
    rows = c.s.queue.filter(F.col("risk_level") == "high").select(
        "payment_id", V, F.explode("signal_list").alias("signal"))
    return rows.groupBy("signal").agg(F.count("payment_id").alias("payment_count"), F.sum(V).alias("recovery_usd"))


@query("daily_flag_rate", """
    SELECT CAST(p.queue_date AS VARCHAR) AS queue_date, count(*) AS payments, count(f.payment_id) AS flagged,
           CAST(count(f.payment_id) AS DOUBLE) / count(*) AS rate
    FROM payments p LEFT JOIN (SELECT DISTINCT payment_id FROM payment_flags_wave) f ON p.payment_id = f.payment_id
    GROUP BY p.queue_date""")
def daily_flag_rate(c: Context) -> DataFrame:
    return M.flagged_rate(c.t.payments(), c.t.payment_flags_wave()).withColumn(
        "rate", F.col("flagged").cast("double") / F.col("payments"))


@query("surge_ratio", """
    WITH d AS (SELECT p.queue_date < DATE '1999-01-01' AS early, count(*) AS n, count(f.payment_id) AS k
               FROM payments p LEFT JOIN (SELECT DISTINCT payment_id FROM payment_flags_wave) f
                 ON p.payment_id = f.payment_id GROUP BY 1),
    r AS (SELECT CAST(max(k) FILTER (WHERE early) AS DOUBLE) / max(n) FILTER (WHERE early) AS rate_before,
                 CAST(max(k) FILTER (WHERE NOT early) AS DOUBLE) / max(n) FILTER (WHERE NOT early) AS rate_after FROM d)
    SELECT rate_before, rate_after, rate_after / rate_before AS surge_ratio FROM r""")
def surge_ratio(c: Context) -> DataFrame:
    return M.surge(M.flagged_rate(c.t.payments(), c.t.payment_flags_wave()), ONSET_DATE)


@query("high_risk_profile", """
    SELECT CAST(median(n_signals) AS DOUBLE) AS median_signals,
           CAST(sum(has_strong) AS DOUBLE) / count(*) AS strong_share FROM open_queue WHERE risk_level = 'high'""")
def high_risk_profile(c: Context) -> DataFrame:
    high = c.s.queue.filter(F.col("risk_level") == "high")
    return high.agg(F.median("n_signals").alias("median_signals"),
                    F.try_divide(F.sum("has_strong").cast("double"), F.count(F.lit(1))).alias("strong_share"))


@query("high_risk_recovery", f"SELECT CAST(sum({V}) AS DOUBLE) AS recovery_usd FROM open_queue WHERE risk_level = 'high'")
def high_risk_recovery(c: Context) -> DataFrame:
    return c.s.queue.filter(F.col("risk_level") == "high").agg(F.sum(V).alias("recovery_usd"))


@query("low_confidence_exposure", f"""
    SELECT count(*) AS cases, CAST(sum({E}) AS DOUBLE) AS exposure_usd FROM scored WHERE confidence_score < 0.85""")
def low_confidence_exposure(c: Context) -> DataFrame:
    return c.s.scored.filter(F.col("confidence_score") < 0.85).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(E).alias("exposure_usd"))


@query("high_risk_refer_share", """
    SELECT 100.0::DOUBLE * count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') / count(*) AS share
    FROM scored WHERE risk_level = 'high'""")
def high_risk_refer_share(c: Context) -> DataFrame:
    return c.s.scored.filter(F.col("risk_level") == "high").agg(
        F.try_divide(F.count_if(F.col("recommended_disposition") == R.REFER) * F.lit(100.0), F.count(F.lit(1))).alias("share"))


@query("ops_kpis", f"""
    SELECT CAST(sum({E}) AS DOUBLE) AS exposure_usd, count(*) AS flagged_count,
           CAST(sum({V}) FILTER (WHERE recommended_disposition <> 'release') AS DOUBLE) AS recovery_usd,
           count(*) FILTER (WHERE recommended_disposition = 'release') AS release_count,
           count(*) FILTER (WHERE recommended_disposition = 'hold_for_verification') AS hold_count,
           count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS refer_count
    FROM scored WHERE risk_level IN ('high', 'moderate') AND program IN ('TANF', 'SNAP', 'Disability')""")
def ops_kpis(c: Context) -> DataFrame:
    d = F.col("recommended_disposition")
    rows = M.dashboard_counters(c.s.scored, ["TANF", "SNAP", "Disability"], ["high", "moderate"])
    return rows.agg(
        F.sum(E).alias("exposure_usd"), F.count(F.lit(1)).alias("flagged_count"),
        F.sum(F.when(d != R.RELEASE, F.col(V))).alias("recovery_usd"), F.count_if(d == R.RELEASE).alias("release_count"),
        F.count_if(d == R.HOLD).alias("hold_count"), F.count_if(d == R.REFER).alias("refer_count"))


# -- top lists ------------------------------------------------------------------------------------

@query("worst_20", f"""
    SELECT payment_id, program, risk_level, n_signals, {arr('signal_list')}, {dbl(E)},
           CAST({V} AS DOUBLE) AS projected_recovery_usd
    FROM scored WHERE risk_level = 'high' ORDER BY scored.{E} DESC NULLS LAST, payment_id LIMIT 20""")
def worst_20(c: Context) -> DataFrame:
    return c.s.scored.filter(F.col("risk_level") == "high").orderBy(F.desc_nulls_last(E), "payment_id").limit(20).select(
        "payment_id", "program", "risk_level", "n_signals", "signal_list", E, F.col(V).alias("projected_recovery_usd"))


@query("top5_scored", f"""
    SELECT payment_id, program, risk_level, state, {dbl('payment_amount_usd')}, {txt('queue_date')}, n_signals,
           {arr('signal_list')}, {dbl(E)}, recommended_disposition, confidence_score
    FROM scored ORDER BY scored.{E} DESC, payment_id LIMIT 5""")
def top5_scored(c: Context) -> DataFrame:
    return c.s.scored.orderBy(F.desc(E), "payment_id").limit(5).select(
        "payment_id", "program", "risk_level", "state", "payment_amount_usd", "queue_date", "n_signals", "signal_list",
        E, "recommended_disposition", "confidence_score")


@query("top_recovery_10", f"""
    SELECT payment_id, program, {dbl(V)} FROM scored ORDER BY scored.{V} DESC NULLS LAST, payment_id LIMIT 10""")
def top_recovery_10(c: Context) -> DataFrame:
    return c.s.scored.orderBy(F.desc_nulls_last(V), "payment_id").limit(10).select("payment_id", "program", V)
