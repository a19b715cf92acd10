"""Raw tables → flagged payments → scored queue → recommendations."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.operators.joins import salted_join, sized_join
from paywarden.session import work_dir
from paywarden.sources.tables import SNAPSHOT_DATE, Tables, quoted


def classify_flags(flags: DataFrame, classification: DataFrame, bounded: bool = False) -> DataFrame:
    """Flags with category and confidence; a signal without a label is 'unclassified'."""
    lookup = classification.select("signal", "signal_category", "classification_confidence")
    return sized_join(flags, lookup, ["signal"], "left", bounded=bounded).withColumn(
        "signal_category", F.coalesce("signal_category", F.lit("unclassified")))


VOCABULARY_LIMIT = 64


def signal_vocabulary(flags: DataFrame) -> list[str] | None:
    """The distinct signals when there are few (a bounded look), else None. Runs one job over one column."""
    found = flags.filter(F.col("signal").isNotNull()).select("signal").distinct().limit(VOCABULARY_LIMIT + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= VOCABULARY_LIMIT else None


def signal_summary(flags: DataFrame, classification: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """One row per flagged payment.

    ``n_signals`` counts every flag row; each list names a signal once, in sorted order, with its row
    count in ``signal_rows``. ``vocabulary`` holds every signal that can occur; it is looked up when not
    given. With few signals the summary is one hash aggregate of counters, combined on the map side, so
    a payment with very many flag rows is one row per task; the lists are then built inside the row.
    """
    words = sorted(vocabulary) if vocabulary is not None else signal_vocabulary(flags)
    if not words:
        return _summary_by_pairs(flags, classification)
    names = [quoted(w) for w in words]
    counts = flags.groupBy("payment_id").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.max(R.is_strong(F.col("signal"))).alias("has_strong_signal"),
        F.count_if(F.col("signal").isNull()).alias("unnamed"),
        *[F.expr(f"count_if(signal = {w}) AS c{i}") for i, w in enumerate(names)])
    label = classification.filter(F.col("signal").isin(words)).groupBy("signal").agg(
        F.min("signal_category").alias("category"), F.min("classification_confidence").alias("confidence"))
    labels = label.agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("category", "confidence"))))).scalar()

    strength = ["strong" if w in R.STRONG else "moderate" if w in R.MODERATE else "weak" for w in words]
    entries = ", ".join(
        f"if(c{i} > 0, named_struct('signal', {w}, 'n', c{i}, 'category', coalesce(try_element_at(labels, {w}).category, "
        f"'unclassified'), 'confidence', try_element_at(labels, {w}).confidence, 'strength', '{strength[i]}'), NULL)"
        for i, w in enumerate(names))
    # a flag without a signal counts, and is an unclassified weak entry
    return counts.withColumn("labels", labels).withColumn("e", F.expr(f"array_compact(array({entries}))")).select(
        "payment_id", "n_signals", F.col("e.signal").alias("signal_list"), F.col("e.n").alias("signal_rows"),
        F.expr("if(unnamed > 0, array_append(e.category, 'unclassified'), e.category) AS signal_categories"),
        F.expr("if(unnamed > 0, array_append(e.strength, 'weak'), e.strength) AS signal_strengths"),
        F.array_min("e.confidence").alias("ai_classification_min_confidence"), "has_strong_signal",
    ).select(
        "payment_id", "n_signals", "signal_list", "signal_rows", "signal_categories",
        F.sort_array(F.array_distinct("signal_categories")).alias("signal_category_set"),
        "ai_classification_min_confidence", "signal_strengths", "has_strong_signal")


def _summary_by_pairs(flags: DataFrame, classification: DataFrame) -> DataFrame:
    """The summary for an open vocabulary: first per (payment, signal), then per payment."""
    pairs = flags.groupBy("payment_id", "signal").agg(F.count(F.lit(1)).alias("n_rows"))
    labelled = classify_flags(pairs, classification)
    entry = F.struct(
        F.col("signal").isNull().alias("last"), F.col("signal"), F.col("n_rows"),
        F.col("signal_category").alias("category"), R.signal_strength(F.col("signal")).alias("strength"))
    named = F.filter("e", lambda x: x["signal"].isNotNull())
    return labelled.groupBy("payment_id").agg(
        F.sum("n_rows").alias("n_signals"), F.sort_array(F.collect_list(entry)).alias("e"),
        F.min("classification_confidence").alias("ai_classification_min_confidence"),
        F.max(R.is_strong(F.col("signal"))).alias("has_strong_signal"),
    ).select(
        "payment_id", "n_signals", F.transform(named, lambda x: x["signal"]).alias("signal_list"),
        F.transform(named, lambda x: x["n_rows"]).alias("signal_rows"), F.col("e.category").alias("signal_categories"),
        F.sort_array(F.array_distinct("e.category")).alias("signal_category_set"), "ai_classification_min_confidence",
        F.col("e.strength").alias("signal_strengths"), "has_strong_signal")


def payments_scored(payments: DataFrame, beneficiaries: DataFrame, summary: DataFrame) -> DataFrame:
    """Flagged payments with beneficiary, signals and risk level.

    The summary join comes first: it is inner, one row per payment on both sides, and leaves only
    flagged rows for the next join. Payments repeat beneficiaries, so that join salts heavy keys.
    """
    flagged = payments.join(summary, "payment_id")
    people = beneficiaries.select("beneficiary_id", "program", "state")
    known = salted_join(flagged, people, "beneficiary_id", "payment_id", payments)
    return known.select(
        "payment_id", "beneficiary_id", "claim_id", "program", "state", "payment_amount_usd", "queue_date",
        "payment_status", "n_signals", "signal_list", "signal_categories", "signal_category_set",
        "ai_classification_min_confidence", "signal_strengths",
        R.risk_level(F.col("n_signals"), F.col("has_strong_signal")).alias("risk_level"),
    )


def payments_flagged(payments: DataFrame, beneficiaries: DataFrame, claims: DataFrame, summary: DataFrame) -> DataFrame:
    """Current status of every flagged payment, with its claim type."""
    return payments_scored(payments, beneficiaries, summary).join(
        claims.select("claim_id", "claim_type"), "claim_id", "left").select(
        "payment_id", "beneficiary_id", "claim_id", "program", "state", "payment_amount_usd", "queue_date",
        "payment_status", "claim_type", "n_signals", "signal_list", "signal_categories", "signal_category_set",
        "ai_classification_min_confidence", "signal_strengths", "risk_level")


def disposition_outcomes(outcomes: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    people = beneficiaries.select("beneficiary_id", "program", "state")
    return salted_join(outcomes, people, "beneficiary_id", "case_id", outcomes, "left").select(
        "case_id", "beneficiary_id", "program", "state", "case_date", "amount_usd", "n_signals",
        R.signal_strength_mix(F.col("n_signals")).alias("signal_strength_mix"),
        "disposition_chosen", "was_improper", "recovery_amount_usd", "days_to_resolution",
    )


def open_queue(silver: DataFrame, snapshot: dt.date = SNAPSHOT_DATE) -> DataFrame:
    exposure = R.improper_exposure(F.col("payment_amount_usd"), F.col("risk_level"))
    return (
        silver.filter(F.col("queue_date") <= F.lit(snapshot))
        .drop("claim_id", "payment_status", "claim_type")
        .withColumn("improper_payment_exposure_usd", exposure)
        .withColumn("projected_recovery_if_investigated_usd",
                    R.projected_recovery(F.col("improper_payment_exposure_usd")))
        .withColumn("has_strong", R.has_strong(F.col("signal_strengths")))
    )


def _recommend(queue: DataFrame) -> DataFrame:
    n, strong = F.col("n_signals"), F.col("has_strong")
    return (
        queue.withColumn("recommended_disposition", R.recommended_disposition(n, strong))
        .withColumn("confidence_score", R.confidence_score(n, strong))
        .withColumn("citizen_delay_cost_usd", R.citizen_delay_cost(F.col("payment_amount_usd")))
    )


def recommendations(queue: DataFrame) -> DataFrame:
    c = F.col
    text = R.reasoning(
        c("risk_level"), c("n_signals"), c("has_strong"), c("payment_amount_usd"), c("program"),
        c("improper_payment_exposure_usd"), c("projected_recovery_if_investigated_usd"), c("citizen_delay_cost_usd"))
    memo = R.memo(
        c("payment_id"), c("program"), c("payment_amount_usd"), c("n_signals"), c("has_strong"), c("signal_list"),
        c("risk_level"), c("improper_payment_exposure_usd"))
    return _recommend(queue).select(
        "payment_id", "program", "risk_level", "n_signals", "signal_list", "signal_categories", "signal_category_set",
        "ai_classification_min_confidence", "improper_payment_exposure_usd",
        "projected_recovery_if_investigated_usd", "recommended_disposition", "confidence_score",
        "citizen_delay_cost_usd", text.alias("reasoning"), memo.alias("memo_scaffold"),
    )


SCORED = [
    "payment_id", "program", "risk_level", "state", "payment_amount_usd", "queue_date", "n_signals", "signal_list",
    "signal_categories", "signal_category_set", "ai_classification_min_confidence", "improper_payment_exposure_usd",
    "projected_recovery_if_investigated_usd", "recommended_disposition", "confidence_score",
]


def queue_scored(queue: DataFrame) -> DataFrame:
    """Queue with its recommendation.

    The recommendation is a function of the queue row, so the 1:1 join on payment is a projection.
    """
    return _recommend(queue).select(*SCORED)


def queue_scored_join(queue: DataFrame, recs: DataFrame) -> DataFrame:
    """The same table from a queue and a recommendation table that were stored separately."""
    return queue.join(recs.select("payment_id", "recommended_disposition", "confidence_score"), "payment_id") \
        .select(*SCORED)


def case_outcomes(silver_outcomes: DataFrame) -> DataFrame:
    return silver_outcomes.select(
        "case_id", "n_signals", "signal_strength_mix", "amount_usd", "disposition_chosen", "was_improper",
        "recovery_amount_usd", "days_to_resolution",
        R.recovery_outcome(F.col("was_improper"), F.col("recovery_amount_usd")).alias("recovery_outcome"),
    )


def inherit_flags(payments: DataFrame, beneficiaries: DataFrame, onset: dt.date, share: int,
                  draw: Column) -> DataFrame:
    """Payments inherit their beneficiary's tags: every tag from the onset on, a fixed share before it.

    The share is decided by ``draw`` (0..99 per row), so the same rows come out on every run.
    """
    tagged = salted_join(
        payments.select("payment_id", "beneficiary_id", "queue_date"),
        beneficiaries.filter(F.col("signal_tags").isNotNull()).select("beneficiary_id", "signal_tags"),
        "beneficiary_id", "payment_id", payments)
    return (
        tagged.select("payment_id", "queue_date", F.explode(F.split("signal_tags", " \\| ")).alias("signal"))
        .filter((F.col("queue_date") >= F.lit(onset)) | (draw < share))
        .select("payment_id", "signal", "queue_date").distinct()
    )


class Scored:
    """The scored tables over one data folder, built lazily and shared between consumers."""

    def __init__(self, tables: Tables):
        self.t = tables

    def stored(self) -> Scored:
        """The same tables with the queue written once to the shared folder.

        For consumers that read the queue several times: they scan the written table instead of running
        the joins behind it again.
        """
        spark, path = self.t.spark, work_dir(self.t.spark, "queue")
        self.queue.write.parquet(path)
        twin = Scored(self.t)
        twin.__dict__["queue"] = spark.read.schema(self.queue.schema).parquet(path)
        return twin

    @cached_property
    def summary(self) -> DataFrame:
        return signal_summary(self.t.payment_flags(), self.t.signal_classification())

    @cached_property
    def silver(self) -> DataFrame:
        return payments_flagged(self.t.payments(), self.t.beneficiaries(), self.t.claims(), self.summary)

    @cached_property
    def flagged(self) -> DataFrame:
        """Silver rows without the claim type.

        The queue needs nothing from the claims and a claim id names at most one claim (the quality
        report checks that), so it is built without that join.
        """
        return payments_scored(self.t.payments(), self.t.beneficiaries(), self.summary)

    @cached_property
    def silver_outcomes(self) -> DataFrame:
        return disposition_outcomes(self.t.outcomes(), self.t.beneficiaries())

    @cached_property
    def queue(self) -> DataFrame:
        return open_queue(self.flagged)

    @cached_property
    def recs(self) -> DataFrame:
        return recommendations(self.queue)

    @cached_property
    def scored(self) -> DataFrame:
        return queue_scored(self.queue)

    @cached_property
    def outcomes(self) -> DataFrame:
        return case_outcomes(self.silver_outcomes)
