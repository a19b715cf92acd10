"""The working desk: serving mirrors, the decision log and the queue reads over both."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.operators.joins import salted_join, sized_join
from paywarden.operators.ranking import distributed_rank

EXPOSURE, RECOVERY = "improper_payment_exposure_usd", "projected_recovery_if_investigated_usd"

POSITION = [
    "payment_id", "program", "state", "payment_amount_usd", "queue_date", "n_signals", "signals", "risk_level",
    EXPOSURE, RECOVERY,
]


def mirror_positions(scored: DataFrame) -> DataFrame:
    return scored.select(
        "payment_id", "program", "state", "payment_amount_usd", F.col("queue_date").cast("string").alias("queue_date"),
        "n_signals", F.array_join("signal_list", ", ").alias("signals"), "risk_level", EXPOSURE, RECOVERY,
    )


def mirror_flags(queue: DataFrame) -> DataFrame:
    return queue.select(
        "payment_id", "n_signals", F.array_join("signal_list", ", ").alias("signal_list"), EXPOSURE, "risk_level")


# hold cost / 3 × 10, rounded half-up in whole cents
_REFER_COST = """cast(((cast(coalesce(predicted_cost_usd, 0BD) * 100 as bigint) * 20 + 3) div 6)
                 * 0.01BD as decimal(18,2))"""


def action_ranking() -> Column:
    """The three options of a recommendation row, in fixed order, with their net value."""
    zero = F.lit(0).cast(R.MONEY)
    recovery = F.coalesce("predicted_recovery_usd", zero)
    cost = F.coalesce("predicted_cost_usd", zero)
    exposure = F.coalesce(EXPOSURE, zero)
    refer_cost = F.expr(_REFER_COST)

    def option(disposition: str, hours: int, c: Column, r: Column) -> Column:
        return F.struct(
            F.lit(disposition).alias("disposition"), F.lit(hours).alias("hold_hours"),
            c.cast(R.MONEY).alias("cost_usd"), r.cast(R.MONEY).alias("predicted_recovery_usd"),
            (r - c).cast(R.MONEY).alias("predicted_net_value_usd"),
        )

    return F.array(
        option(R.RELEASE, 0, zero, zero),
        option(R.HOLD, R.HOLD_HOURS, cost, recovery),
        option(R.REFER, R.REFER_HOURS, refer_cost, exposure),
    )


def mirror_recommendations(recs: DataFrame) -> DataFrame:
    disposition = R.in_domain(F.col("recommended_disposition"), R.DISPOSITIONS)
    return recs.select(
        "payment_id", disposition.alias("recommended_disposition"), "confidence_score",
        R.hold_hours(F.col("recommended_disposition")).alias("recommended_hold_hours"),
        F.col(RECOVERY).alias("predicted_recovery_usd"), F.col("citizen_delay_cost_usd").alias("predicted_cost_usd"),
        EXPOSURE, "reasoning",
    ).withColumn("action_ranking", action_ranking())


def ranked_options(recs: DataFrame) -> DataFrame:
    """One row per payment and option, ranked by net value.

    The three options live in the row, so ranking them needs neither a shuffle nor a window.
    """
    keyed = F.transform("action_ranking", lambda o: F.struct(
        (-o["predicted_net_value_usd"]).alias("k"), o["hold_hours"].alias("h"), o.alias("o")))
    return recs.select(
        "payment_id", "recommended_disposition", F.posexplode(F.sort_array(keyed)).alias("pos", "x"),
    ).select("payment_id", "recommended_disposition", "x.o.*", (F.col("pos") + 1).alias("net_rank"))


def what_if_release(recs: DataFrame) -> DataFrame:
    """Value of the recommended option over releasing now."""
    def net(which: Column) -> Column:
        return F.get(F.filter("action_ranking", lambda o: o["disposition"] == which), F.lit(0))
    chosen, release = net(F.col("recommended_disposition")), net(F.lit(R.RELEASE))
    return recs.select(
        "payment_id", "recommended_disposition",
        chosen["predicted_net_value_usd"].alias("recommended_net_usd"),
        release["predicted_net_value_usd"].alias("release_net_usd"),
        (chosen["predicted_net_value_usd"] - release["predicted_net_value_usd"]).alias("net_gain_usd"),
        (chosen["predicted_recovery_usd"] - release["predicted_recovery_usd"]).alias("recovery_forgone_usd"),
        (chosen["cost_usd"] - release["cost_usd"]).alias("delay_cost_avoided_usd"),
    )


LATEST = ["id", "action_type", "status", "approved_by", "decided_at", "hold_duration_hours", "created_at"]


def latest_actions(actions: DataFrame) -> DataFrame:
    """Newest decision per payment, ties broken by id.

    ``max_by`` keeps one row per payment on the map side: no sort, and a payment with very many
    decisions reaches the reducer as one row per task.
    """
    newest = F.max_by(F.struct(*LATEST), F.struct("created_at", "id"))
    return actions.groupBy("payment_id").agg(newest.alias("a")).select("payment_id", "a.*")


def live_queue(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions (already carrying their recommendation) with the live decision."""
    la = latest_actions(actions).select(
        "payment_id", F.col("action_type").alias("live_disposition"), F.col("status").alias("action_status"),
        "approved_by", "decided_at", "hold_duration_hours", "created_at")
    return positions.join(la, "payment_id", "left")


def queue_filter(queue: DataFrame, status_group: str = "all", risk: str | None = None, program: str | None = None,
                 payment=None) -> DataFrame:
    wanted: list[Column] = []
    if status_group == "open":
        wanted.append(F.col("live_disposition").isNull())
    if risk:
        wanted.append(F.col("risk_level") == risk)
    if program:
        wanted.append(F.col("program") == program)
    if payment is not None:
        wanted.append(F.col("payment_id") == payment)
    return queue.filter(reduce(lambda a, b: a & b, wanted)) if wanted else queue


def queue_list(queue: DataFrame, sort: str = "exposure", limit=None, default: int = 300, cap: int | None = None,
               **filters) -> DataFrame:
    by = RECOVERY if sort == "recovery" else EXPOSURE
    return queue_filter(queue, **filters).orderBy(F.desc_nulls_last(by), "payment_id") \
        .limit(R.clamp_limit(limit, default, cap))


def text_search(queue: DataFrame, text: str) -> DataFrame:
    needle = (text or "").strip().lower()
    if not needle:
        return queue
    hit = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
           for c in ("payment_id", "program", "signals")]
    return queue.filter(hit[0] | hit[1] | hit[2])


def queue_summary(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Header figures over payments without a decision."""
    acted = actions.select(F.col("payment_id").alias("acted")).distinct()
    unacted = F.col("acted").isNull()
    joined = positions.join(acted, F.col("payment_id") == F.col("acted"), "left")
    zero = F.lit(0).cast(R.MONEY)
    return joined.agg(
        F.coalesce(F.sum(F.when(unacted, F.col(EXPOSURE))), zero).alias(EXPOSURE),
        F.coalesce(F.sum(F.when(unacted, F.col(RECOVERY))), zero).alias("projected_recovery_usd"),
        F.count_if(unacted).alias("flagged_count"),
        F.count_if(unacted & (F.col("recommended_disposition") == R.REFER)).alias("refer_recommended_count"),
    )


def program_breakdown(positions: DataFrame, risk: str | None = None, limit: int = 50) -> DataFrame:
    rows = positions.filter(F.col("risk_level") == risk) if risk else positions
    return (
        rows.groupBy("program").agg(
            F.count(F.lit(1)).alias("flagged_count"),
            F.coalesce(F.sum(EXPOSURE), F.lit(0).cast(R.MONEY)).alias(EXPOSURE),
            F.min(F.when(F.col("risk_level") == "high", 0).otherwise(1)).alias("worst"),
        )
        .select(F.coalesce("program", F.lit("Unknown")).alias("program"), "flagged_count", EXPOSURE,
                F.when(F.col("worst") == 0, "high").otherwise("moderate").alias("risk_level"))
        .orderBy(F.desc(EXPOSURE), "program").limit(limit)
    )


def worst_flags(flags: DataFrame, limit: int = 1) -> DataFrame:
    """Highest exposure first. Payments that already have a decision are not excluded."""
    return flags.withColumn("risk_level", R.flag_risk(F.col("risk_level"))) \
        .orderBy(F.desc_nulls_last(EXPOSURE), "payment_id").limit(limit)


def flag_enrichment(flags: DataFrame, live: DataFrame, payment=None) -> DataFrame:
    """The named open flag, or the worst one, with its position and live decision."""
    one = worst_flags(flags) if payment is None else flags.filter(F.col("payment_id") == payment).limit(1)
    flag = one.select("payment_id", "n_signals", F.col("signal_list").alias("signals"), "risk_level", EXPOSURE)
    extra = live.select("payment_id", "program", "state", "payment_amount_usd", RECOVERY, "live_disposition",
                        "action_status")
    return flag.join(extra, "payment_id", "left")


def payment_detail(live: DataFrame, actions: DataFrame, payment) -> DataFrame:
    """One payment with its recommendation and every decision on it, newest first, one row each."""
    head = live.filter(F.col("payment_id") == payment).select(*POSITION, "recommended_disposition",
                                                               "recommended_hold_hours", "live_disposition")
    log = actions.filter(F.col("payment_id") == payment).select(
        F.col("payment_id").alias("k"), F.col("id").alias("action_id"), "action_type",
        F.col("status"), F.col("created_at").alias("action_created_at"), F.to_json("audit_trail").alias("audit"))
    return head.join(log, F.col("payment_id") == F.col("k"), "left").drop("k") \
        .orderBy(F.desc_nulls_last("action_created_at"), F.desc_nulls_last("action_id"))


def clean_action_log(actions: DataFrame) -> DataFrame:
    return actions.withColumn("action_type", R.in_domain(F.col("action_type"), R.DISPOSITIONS, R.HOLD)) \
        .withColumn("status", R.in_domain(F.col("status"), R.STATUSES, "approved"))


def recent_activity(actions: DataFrame, limit=None) -> DataFrame:
    at = F.coalesce("decided_at", "created_at")
    return clean_action_log(actions).select(
        F.lit("action").alias("kind"), F.col("id").alias("action_id"), "payment_id", at.alias("at"),
        F.coalesce("approved_by", F.lit("system")).alias("by"), "action_type", "status", "hold_duration_hours",
        "predicted_recovery_usd", F.col("drafted_request").alias("notes"),
    ).orderBy(F.desc_nulls_last("at"), F.desc("action_id")).limit(R.clamp_limit(limit, 20, 100))


def primary_signal(signals: Column) -> Column:
    first = F.trim(F.get(F.split(F.coalesce(signals, F.lit("")), ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unspecified"))


def record_decisions(requests: DataFrame, positions: DataFrame, allow_list: str | None = None,
                     supervisors: DataFrame | None = None) -> DataFrame:
    """Approved requests as decision-log rows.

    A batch is recorded whole or not at all: it is left out when any of its requests names a payment
    that is not in the queue or comes from someone who is not a supervisor: not on the allow-list, or not among
    the ``supervisors`` (identity), a table of any size.
    """
    known = positions.select("payment_id", "signals", F.lit(True).alias("known"))
    looked_up = salted_join(requests, known, "payment_id", "id", requests, "left")
    wrong = F.col("known").isNull()
    if allow_list is not None:
        wrong = wrong | (role_of(F.col("requested_by"), allow_list) != "supervisor")
    if supervisors is not None:
        named = supervisors.select(normalise_identity(F.col("identity")).alias("identity")).distinct().withColumn("supervises", F.lit(True))
        looked_up = sized_join(looked_up.withColumn("identity", normalise_identity(F.col("requested_by"))), named, ["identity"], "left", spread=F.xxhash64("id"))
        wrong = wrong | F.col("supervises").isNull()
    refused = looked_up.filter(wrong).select("batch_id", F.lit(True).alias("refused")).distinct()
    accepted = salted_join(looked_up, refused, "batch_id", "id", requests, "left").filter(F.col("refused").isNull())
    notes = F.concat(
        F.lit("Examiner-approved "), F.col("action_type"),
        F.when(F.coalesce(F.col("hold_duration_hours"), F.lit(0)) != 0,
               F.concat(F.lit(" — hold "), F.col("hold_duration_hours").cast("string"), F.lit("h")))
        .otherwise(""), F.lit("."))
    audit = F.struct(
        F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("requested_by").alias("by"),
        F.lit("approved").alias("action"), notes.alias("notes"), F.lit("execute_case_action").alias("tool"))
    return accepted.select(
        "id", "payment_id", primary_signal(F.col("signals")).alias("signal_type"), "action_type",
        "hold_duration_hours", "drafted_request", "predicted_recovery_usd", F.lit("approved").alias("status"),
        F.col("requested_by").alias("approved_by"), F.lit("supervisor").alias("reviewed_by_role"),
        F.array(audit).alias("audit_trail"), F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("decided_at"),
    )


def normalise_identity(c: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f\v")))


def parse_allow_list(text: str | None) -> list[str]:
    return list(dict.fromkeys(x for x in (p.strip().lower() for p in (text or "").split(",")) if x))


def role_of(identity: Column, allow_list: str | None) -> Column:
    norm = normalise_identity(identity)
    return F.when((norm != "") & norm.isin(parse_allow_list(allow_list)), "supervisor").otherwise("examiner")


def capacity_batches(queue: DataFrame, per_day: int = 50) -> DataFrame:
    """The queue cut into daily batches, worst exposure first; ranks span all ranges without one global sort."""
    ranked = distributed_rank(
        queue.select("payment_id", "program", EXPOSURE), [], [F.desc_nulls_last(EXPOSURE), F.asc("payment_id")], "rank")
    return ranked.withColumn("batch", F.ceil(F.col("rank") / per_day).cast("bigint"))


class Desk:
    """Mirrors over one data folder."""

    def __init__(self, tables, scored):
        self.t, self.s = tables, scored

    @cached_property
    def positions(self) -> DataFrame:
        return mirror_positions(self.s.scored)

    @cached_property
    def flags(self) -> DataFrame:
        return mirror_flags(self.s.queue)

    @cached_property
    def recs(self) -> DataFrame:
        return mirror_recommendations(self.s.recs)

    @cached_property
    def actions(self) -> DataFrame:
        return self.t.case_actions()

    @cached_property
    def positions_with_recs(self) -> DataFrame:
        """Position and recommendation come from the same queue row: a projection instead of a join."""
        return self.s.scored.select(
            "payment_id", "program", "state", "payment_amount_usd",
            F.col("queue_date").cast("string").alias("queue_date"), "n_signals",
            F.array_join("signal_list", ", ").alias("signals"), "risk_level", EXPOSURE, RECOVERY,
            "recommended_disposition", "confidence_score",
            R.hold_hours(F.col("recommended_disposition")).alias("recommended_hold_hours"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return live_queue(self.positions_with_recs, self.actions)
