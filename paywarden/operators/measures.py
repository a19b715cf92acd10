"""Named dimensions and measures, and the rollups built from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R

DIMENSIONS = ["program", "risk_level", "recommended_disposition"]
E, V = "improper_payment_exposure_usd", "projected_recovery_if_investigated_usd"


def values() -> dict[str, Column]:
    """What each row adds to each part."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "payment_count": F.lit(1),
        "total_queue_value_usd": F.col("payment_amount_usd"),
        "n_signals_total": F.col("n_signals"),
        E: F.col(E),
        V: F.col(V),
        "high_confidence_count": one(F.col("confidence_score") >= 0.85),
        "release_recommended_count": one(F.col("recommended_disposition") == R.RELEASE),
        "hold_recommended_count": one(F.col("recommended_disposition") == R.HOLD),
        "investigate_recommended_count": one(F.col("recommended_disposition") == R.REFER),
    }


# Additive parts, then measures derived from parts. Averages stay a sum and a count until the end, so a
# stored table of parts answers any coarser grouping.
PARTS: dict[str, Column] = {}
MEASURES: dict[str, Column] = {}


def _define() -> None:
    PARTS.update({n: F.sum(v) for n, v in values().items()} | {"payment_count": F.count(F.lit(1))})
    n = F.col("payment_count")
    MEASURES.update({
        "payment_count": n,
        "total_queue_value_usd": F.col("total_queue_value_usd"),
        "flagged_payment_count": n,
        E: F.col(E),
        V: F.col(V),
        "avg_payment_amount_usd": F.col("total_queue_value_usd").cast("double") / n,
        "avg_n_signals": F.col("n_signals_total").cast("double") / n,
        "high_confidence_count": F.col("high_confidence_count"),
        "release_recommended_count": F.col("release_recommended_count"),
        "hold_recommended_count": F.col("hold_recommended_count"),
        "investigate_recommended_count": F.col("investigate_recommended_count"),
    })


def parts(scored: DataFrame, dims: list[str]) -> DataFrame:
    if not PARTS:
        _define()
    return scored.groupBy(*dims).agg(*[c.alias(n) for n, c in PARTS.items()])


def coarser(stored: DataFrame, dims: list[str]) -> DataFrame:
    """Stored parts re-aggregated to a subset of their dimensions; every part is additive."""
    if not PARTS:
        _define()
    return stored.groupBy(*dims).agg(*[F.sum(n).alias(n) for n in PARTS])


def finish(part_rows: DataFrame, dims: list[str], names: list[str] | None = None) -> DataFrame:
    if not MEASURES:
        _define()
    return part_rows.select(*dims, *[MEASURES[n].alias(n) for n in names or MEASURES])


def measure(scored: DataFrame, dims: list[str], names: list[str] | None = None) -> DataFrame:
    """Evaluate measures over any subset of the dimensions; unused parts are pruned by the optimizer."""
    return finish(parts(scored, dims), dims, names)


def dashboard_counters(rows: DataFrame, programs: list[str] | None = None, risks: list[str] | None = None) -> DataFrame:
    """Counters over a program × risk pre-aggregate after the dashboard's filters."""
    if programs:
        rows = rows.filter(F.col("program").isin(programs))
    if risks:
        rows = rows.filter(F.col("risk_level").isin(risks))
    return rows


def weekly_trend(scored: DataFrame, as_of: dt.date, days: int = 63) -> DataFrame:
    return (
        scored.filter(F.col("queue_date") >= F.lit(as_of - dt.timedelta(days=days)))
        .groupBy(F.date_trunc("week", "queue_date").cast("date").alias("week"), "risk_level")
        .agg(F.count(F.lit(1)).alias("flagged"))
    )


def program_signal_counts(queue: DataFrame) -> DataFrame:
    return queue.select("program", "payment_id", F.explode("signal_list").alias("signal")) \
        .groupBy("program", "signal").agg(F.countDistinct("payment_id").alias("payment_count"))


def program_signal_counts_text(positions: DataFrame) -> DataFrame:
    rows = positions.filter(F.col("signals").isNotNull() & (F.col("signals") != ""))
    return rows.select("program", "payment_id", F.explode(F.split("signals", ",")).alias("raw")) \
        .groupBy("program", F.trim("raw").alias("signal")).agg(F.countDistinct("payment_id").alias("payment_count"))


def flagged_rate(payments: DataFrame, flags: DataFrame) -> DataFrame:
    """Payments per day with the number and share that carry a flag; days are combined on the map side."""
    flagged = flags.select("payment_id").distinct().withColumn("hit", F.lit(1))
    return payments.select("payment_id", "queue_date").join(flagged, "payment_id", "left").groupBy("queue_date").agg(
        F.count(F.lit(1)).alias("payments"), F.count("hit").alias("flagged"))


def surge(daily: DataFrame, onset: dt.date) -> DataFrame:
    before = F.col("queue_date") < F.lit(onset)

    def rate(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("flagged"))).cast("double") / F.sum(F.when(cond, F.col("payments")))

    return daily.agg(rate(before).alias("rate_before"), rate(~before).alias("rate_after")).withColumn(
        "surge_ratio", F.col("rate_after") / F.col("rate_before"))


def outcome_rates(outcomes: DataFrame, dims: list[str]) -> DataFrame:
    """Improper rate, average recovered share of the amount when improper, mean days to resolution."""
    share = F.try_divide(F.col("recovery_amount_usd").cast("double"), F.col("amount_usd").cast("double"))
    # shares are summed as decimals so that the result does not depend on the order of the rows
    share_sum = F.sum(F.when(F.col("was_improper"), F.round(share, 9).cast("decimal(27,9)")))
    return outcomes.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("cases"),
        (F.count_if("was_improper").cast("double") / F.count(F.lit(1))).alias("improper_rate"),
        F.round(F.try_divide(share_sum.cast("double"), F.count_if("was_improper")), 6).alias("avg_recovery_share"),
        (F.sum("days_to_resolution").cast("double") / F.count(F.lit(1))).alias("avg_days"))
