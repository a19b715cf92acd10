"""Reading, writing and publishing tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import desk as K
from paywarden.operators import search
from paywarden.operators.classify import classify_signals
from paywarden.plans.registry import Context, query
from paywarden.plans.twin import dbl, txt
from paywarden.session import work_dir
from paywarden.sources import sinks

RAW = ["beneficiaries", "claims", "payments", "payment_flags", "outcomes"]


def raw_views(c: Context) -> list[str]:
    """Expose the five raw datasets unchanged under their names."""
    for name in RAW:
        getattr(c.t, name)().createOrReplaceTempView(f"raw_{name}")
    return [f"raw_{name}" for name in RAW]


@query("raw_scan", """
    SELECT 'raw_beneficiaries' AS dataset, count(*) AS n_rows FROM beneficiaries
    UNION ALL SELECT 'raw_claims', count(*) FROM claims UNION ALL SELECT 'raw_payments', count(*) FROM payments
    UNION ALL SELECT 'raw_payment_flags', count(*) FROM payment_flags
    UNION ALL SELECT 'raw_outcomes', count(*) FROM outcomes_raw""")
def raw_scan(c: Context) -> DataFrame:
    out = None
    for view in raw_views(c):
        one = c.spark.table(view).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(view).alias("dataset"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("parquet_sink_count", """
    SELECT 'claims' AS dataset, count(*) AS rows_written, count(*) AS rows_read FROM claims
    UNION ALL SELECT 'payments', count(*), count(*) FROM payments""")
def parquet_sink_count(c: Context) -> DataFrame:
    out = None
    for name in ("claims", "payments"):
        df, path = getattr(c.t, name)(), work_dir(c.spark, name)
        written = sinks.write_counted(df, path)
        back = c.spark.read.schema(df.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows_read")) \
            .select(F.lit(name).alias("dataset"), F.lit(written).cast("bigint").alias("rows_written"), "rows_read")
        out = back if out is None else out.unionByName(back)
    return out


@query("typed_rows", f"""
    SELECT payment_id, {txt('queue_date')}, {dbl('payment_amount_usd')}, beneficiary_id % 2 = 0 AS even FROM payments""")
def typed_rows(c: Context) -> DataFrame:
    """Rows that arrive as text become a typed table under a DDL schema; ISO text becomes a date."""
    text = c.t.payments().select(
        F.col("payment_id").cast("string").alias("payment_id"),
        F.date_format("queue_date", "yyyy-MM-dd").alias("queue_date"),
        F.col("payment_amount_usd").cast("string").alias("payment_amount_usd"),
        (F.col("beneficiary_id") % 2 == 0).cast("string").alias("even"))
    return sinks.typed(text, "payment_id bigint, queue_date date, payment_amount_usd decimal(18,2), even boolean")


@query("clustered_table", f"""
    SELECT CAST(date_trunc('month', queue_date) AS DATE)::VARCHAR AS month, count(*) AS n_rows,
           CAST(sum(payment_amount_usd) AS DOUBLE) AS amount_usd
    FROM silver WHERE queue_date >= DATE '2000-01-01' GROUP BY 1""")
def clustered_table(c: Context) -> DataFrame:
    path = work_dir(c.spark, "silver")
    silver = c.s.silver
    sinks.write_clustered(silver, path, "queue_date", "payment_id")
    stored = c.spark.read.schema(silver.schema).parquet(path).filter(F.col("queue_date") >= F.lit(dt.date(2000, 1, 1)))
    return stored.groupBy(F.trunc("queue_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("payment_amount_usd").alias("amount_usd"))


@query("replace_lookup_table", """
    SELECT DISTINCT f.signal, l.signal_category, CAST(NULL AS DOUBLE) AS classification_confidence,
           CAST(NULL AS VARCHAR) AS classification_error
    FROM payment_flags f JOIN signal_classification l ON f.signal = l.signal""")
def replace_lookup_table(c: Context) -> DataFrame:
    path = work_dir(c.spark, "signal_classification")
    lookup = classify_signals(c.t.payment_flags())
    lookup.write.mode("overwrite").parquet(path)
    lookup.write.mode("overwrite").parquet(path)  # replacing an existing table leaves the same rows
    return c.spark.read.schema(lookup.schema).parquet(path)


@query("mirror_payment_position", f"""
    SELECT payment_id, program, state, queue_date, n_signals, signals, risk_level,
           {dbl('payment_amount_usd', K.EXPOSURE, K.RECOVERY)} FROM positions""")
def mirror_payment_position(c: Context) -> DataFrame:
    return c.desk.positions


@query("mirror_open_queue", f"SELECT payment_id, n_signals, signal_list, risk_level, {dbl(K.EXPOSURE)} FROM flag_mirror")
def mirror_open_queue(c: Context) -> DataFrame:
    return c.desk.flags


@query("mirror_dispo_recs", f"""
    SELECT r.payment_id, r.recommended_disposition, r.confidence_score,
           CAST(r.recommended_hold_hours AS BIGINT) AS recommended_hold_hours,
           {dbl('r.predicted_recovery_usd', 'r.predicted_cost_usd')}, r.reasoning, 3 AS n_options,
           CAST(o.best AS DOUBLE) AS best_net_usd
    FROM rec_mirror r JOIN (SELECT payment_id, max(predicted_net_value_usd) AS best FROM action_options GROUP BY 1) o
      ON r.payment_id = o.payment_id""")
def mirror_dispo_recs(c: Context) -> DataFrame:
    return c.desk.recs.select(
        "payment_id", "recommended_disposition", "confidence_score", "recommended_hold_hours", "predicted_recovery_usd",
        "predicted_cost_usd", "reasoning", F.size("action_ranking").alias("n_options"),
        F.array_max(F.transform("action_ranking", lambda o: o["predicted_net_value_usd"])).alias("best_net_usd"))


@query("insert_if_absent", f"""
    SELECT payment_id, CASE WHEN payment_id % 3 = 0 THEN 'stored' ELSE risk_level END AS risk_level,
           {dbl(K.EXPOSURE)} FROM flag_mirror""")
def insert_if_absent(c: Context) -> DataFrame:
    """A mirror that already holds every third payment keeps those rows and gains the others."""
    c = c.with_stored_queue()
    incoming = c.desk.flags.select("payment_id", "risk_level", K.EXPOSURE)
    stored = incoming.filter(F.col("payment_id") % 3 == 0).withColumn("risk_level", F.lit("stored"))
    return sinks.insert_if_absent(stored, incoming, "payment_id")


@query("snapshot_publish", f"""
    SELECT count(*) AS n_rows, count(DISTINCT payment_id) AS n_keys, CAST(sum({K.EXPOSURE}) AS DOUBLE) AS exposure_usd
    FROM scored""")
def snapshot_publish(c: Context) -> DataFrame:
    path = work_dir(c.spark, "snapshot")
    scored = c.s.scored
    sinks.publish_snapshot(scored, path, "payment_id")
    return c.spark.read.schema(scored.schema).parquet(path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("payment_id").alias("n_keys"),
        F.sum(K.EXPOSURE).alias("exposure_usd"))


@query("reset_and_reload", f"""
    SELECT CAST(sum({K.EXPOSURE}) AS DOUBLE) AS {K.EXPOSURE}, CAST(sum({K.RECOVERY}) AS DOUBLE) AS projected_recovery_usd,
           count(*) AS flagged_count,
           count(*) FILTER (WHERE recommended_disposition = 'refer_to_investigation') AS refer_recommended_count
    FROM scored""")
def reset_and_reload(c: Context) -> DataFrame:
    """Emptied decision log, reloaded mirrors: every flagged payment is open again."""
    emptied = sinks.empty_like(c.desk.actions)
    return K.queue_summary(c.desk.positions_with_recs, emptied)


@query("keyed_upsert", f"""
    WITH stored AS (SELECT guide_id, summary AS content, 'kept' AS vec, TIMESTAMP '2024-01-01' AS updated_at
                    FROM playbooks WHERE CAST(substring(guide_id, 7) AS BIGINT) % 5 <> 0),
    incoming AS (SELECT guide_id, CASE WHEN CAST(substring(guide_id, 7) AS BIGINT) % 3 = 0 THEN summary || ' (revised)'
                        ELSE summary END AS content
                 FROM playbooks WHERE CAST(substring(guide_id, 7) AS BIGINT) % 7 <> 0)
    SELECT coalesce(s.guide_id, i.guide_id) AS guide_id, coalesce(i.content, s.content) AS content,
           s.guide_id IS NOT NULL AND (i.guide_id IS NULL OR s.content IS NOT DISTINCT FROM i.content) AS has_vector,
           strftime(CASE WHEN s.guide_id IS NOT NULL AND (i.guide_id IS NULL OR s.content IS NOT DISTINCT FROM i.content)
                THEN s.updated_at ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
    FROM stored s FULL JOIN incoming i ON s.guide_id = i.guide_id""")
def keyed_upsert(c: Context) -> DataFrame:
    number = F.substring("guide_id", 7, 20).cast("bigint")
    guides = c.t.playbooks().select("guide_id", F.col("summary").alias("content"))
    stored = guides.filter(number % 5 != 0).select(
        "*", F.array(F.lit(1.0).cast("float")).alias("search_embedding"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    incoming = guides.filter(number % 7 != 0).withColumn(
        "content", F.when(number % 3 == 0, F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content")))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    merged = sinks.upsert_by_key(stored, incoming, "guide_id", "content", "search_embedding", "updated_at", now)
    return merged.select("guide_id", "content", F.col("search_embedding").isNotNull().alias("has_vector"), "updated_at")


# Allow-listed named queries; the table name is composed from a bound parameter when the query runs.
NAMED = {
    "position_mix": "SELECT program, CAST(COUNT(*) AS BIGINT) AS flag_count "
                    "FROM IDENTIFIER(:prefix || 'queue_scored') GROUP BY program",
    "mix_above": "SELECT program, CAST(COUNT(*) AS BIGINT) AS flag_count FROM IDENTIFIER(:prefix || 'queue_scored') "
                 "WHERE improper_payment_exposure_usd >= :floor GROUP BY program",
}


def run_named(c: Context, name: str, **args) -> DataFrame:
    if name not in NAMED:
        raise KeyError(f"unknown query {name}")
    return c.spark.sql(NAMED[name], args=args)


@query("param_table_query", f"""
    SELECT program, count(*) AS flag_count FROM scored WHERE {K.EXPOSURE} >= 50000 GROUP BY program""")
def param_table_query(c: Context) -> DataFrame:
    c.s.scored.createOrReplaceTempView("bound_queue_scored")
    return run_named(c, "mix_above", prefix="bound_", floor=50000)


@query("playbook_content", """
    SELECT guide_id, concat_ws(chr(10), title, 'Agency: ' || agency, 'Program: ' || program, 'Scenario: ' || scenario,
           summary, 'Verification steps: ' || array_to_string(verification_steps, '; '),
           'Required documents: ' || array_to_string(required_documents, '; '),
           'Hold guidance: ' || hold_guidance, 'Authority: ' || authority_citation) AS content FROM playbooks""")
def playbook_content(c: Context) -> DataFrame:
    return c.t.playbooks().select("guide_id", search.playbook_content().alias("content"))


