"""Data-quality checks: one row per check with the observed figure and whether it passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.operators import desk as K
from paywarden.operators import measures as M
from paywarden.sources.tables import ONSET_DATE

E, V = K.EXPOSURE, K.RECOVERY


@dataclass(frozen=True)
class KnownPayment:
    """A payment whose scored values are known in advance."""
    payment_id: int
    program: str
    amount: str
    signals: tuple[str, ...]
    exposure: str
    disposition: str
    recovery: str


def report(stats: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row of statistics turned into check rows (check, observed, passed)."""
    rows = [F.struct(F.lit(name).alias("check"), F.round(seen.cast("double"), 6).alias("observed"),
                     F.coalesce(ok, F.lit(False)).alias("passed")) for name, (seen, ok) in checks.items()]
    return stats.select(F.inline(F.array(*rows)))


def queue_checks(scored: DataFrame, known: KnownPayment) -> DataFrame:
    """All checks on the scored queue in one aggregation."""
    c = F.col
    d, high = c("recommended_disposition"), c("risk_level") == "high"
    is_known = (
        (c("payment_id") == known.payment_id) & (c("program") == known.program)
        & (c("payment_amount_usd") == F.lit(known.amount).cast(R.MONEY))
        & (c("signal_list") == F.array(*[F.lit(s) for s in known.signals]))
        & (c(E) == F.lit(known.exposure).cast(R.MONEY)))
    known_rec = (c("payment_id") == known.payment_id) & (d == known.disposition) & (
        c(V) == F.lit(known.recovery).cast(R.MONEY))
    strong = F.exists("signal_list", lambda s: s.isin(R.STRONG))
    bad = (
        ~c("risk_level").isin(R.RISKS) | ~d.isin(R.DISPOSITIONS) | (F.size("signal_list") == 0)
        | (c(E) < 0) | (c(V) > c(E)))
    stats = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_known).alias("known"), F.count_if(known_rec).alias("known_rec"),
        *[F.count_if(d == x).alias(x) for x in R.DISPOSITIONS],
        F.count_if(high).alias("high"), F.count_if(high & strong).alias("high_strong"),
        F.median(F.when(high, c("n_signals"))).alias("high_median"),
        F.sum(E).alias("exposure"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"),
        F.sum(F.when(high, c(E))).alias("high_detail"))
    top_share = F.try_divide(F.greatest(*R.DISPOSITIONS), c("n"))
    return report(stats, {
        "known_payment": (c("known"), c("known") == 1),
        "known_recommendation": (c("known_rec"), c("known_rec") == 1),
        "three_way_mix": (top_share, (F.least(*R.DISPOSITIONS) > 0) & (top_share < 0.95)),
        "high_risk_median_signals": (c("high_median"), c("high_median") >= 2),
        "high_risk_strong_share": (F.try_divide(c("high_strong"), c("high")), F.try_divide(c("high_strong"), c("high")) >= 0.7),
        "exposure_floor": (c("exposure"), c("exposure") > 1_000_000),
        "domains_and_bounds": (c("bad"), c("bad") == 0),
        "row_count_band": (c("n"), c("n") > 0),
    })


def history_checks(outcomes: DataFrame) -> DataFrame:
    c = F.col
    d = c("disposition_chosen")

    def rate(which: str) -> Column:
        return F.try_divide(F.count_if((d == which) & c("was_improper")), F.count_if(d == which))

    single = c("n_signals") == 1
    stats = outcomes.agg(
        F.count_if(single & (d == R.RELEASE)).alias("a"), F.count_if(single & (d == R.HOLD)).alias("b"),
        *[rate(x).alias(x) for x in R.DISPOSITIONS])
    return report(stats, {
        "single_signal_split": (F.least("a", "b"), F.least("a", "b") > 0),
        "outcome_rates_separate": (c(R.REFER) - c(R.RELEASE), (c(R.REFER) > c(R.HOLD)) & (c(R.HOLD) > c(R.RELEASE))),
    })


def _counted(df: DataFrame, name: str, passes) -> DataFrame:
    return report(df.agg(F.count(F.lit(1)).alias("n")), {name: (F.col("n"), passes(F.col("n")))})


def surge_check(payments: DataFrame, flags: DataFrame) -> DataFrame:
    stats = M.surge(M.flagged_rate(payments, flags), ONSET_DATE)
    return report(stats, {"flagged_rate_surge": (F.col("surge_ratio"), F.col("surge_ratio") > 2)})


def flag_checks(flags: DataFrame, labels: DataFrame) -> DataFrame:
    pairs = flags.groupBy("payment_id", "signal").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    unlabelled = labels.filter(F.col("signal_category").isNull())
    return _counted(pairs, "no_duplicate_flags", lambda n: n == 0).unionByName(
        _counted(unlabelled, "every_signal_classified", lambda n: n == 0))


def mirror_checks(scored: DataFrame, positions: DataFrame, flags: DataFrame, recs: DataFrame) -> DataFrame:
    """Row counts, key uniqueness and key agreement of gold and its mirrors, in one pass over the keys."""
    sides = {"gold": scored, "position": positions, "flag": flags, "rec": recs}
    keys = None
    for side, df in sides.items():
        one = df.select("payment_id", *[F.lit(int(side == s)).alias(s) for s in sides])
        keys = one if keys is None else keys.unionByName(one)
    per = keys.groupBy("payment_id").agg(*[F.sum(s).alias(s) for s in sides])
    stats = per.agg(
        *[F.sum(s).alias(s) for s in sides], F.count_if(F.greatest(*sides) > 1).alias("dup"),
        F.count_if((F.col("position") > 0) & (F.col("rec") == 0)).alias("orphan"))
    same = (F.col("gold") == F.col("position")) & (F.col("gold") == F.col("flag")) & (F.col("gold") > 0)
    return report(stats, {
        "mirror_counts_equal": (F.col("position"), same),
        "mirror_keys_unique": (F.col("dup"), F.col("dup") == 0),
        "position_has_recommendation": (F.col("orphan"), F.col("orphan") == 0),
    })


def slice_check(scored: DataFrame) -> DataFrame:
    """The governed measure for one slice equals the sum of its detail rows."""
    measured = M.measure(scored, ["risk_level"], [E]).filter(F.col("risk_level") == "high").select(F.col(E).alias("m"))
    detail = scored.filter(F.col("risk_level") == "high").agg(F.sum(E)).scalar()
    return report(measured.withColumn("d", detail), {
        "measure_equals_detail": (F.col("m") - F.col("d"), F.col("m") == F.col("d"))})


def reference_checks(actions: DataFrame, positions: DataFrame, claims: DataFrame, beneficiaries: DataFrame,
                     messages: DataFrame) -> DataFrame:
    """References and keys. Repeated keys are combined before the joins, so a hot key is one row there."""
    decided = actions.groupBy("payment_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = decided.join(positions.select("payment_id"), "payment_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    claimed = claims.groupBy("beneficiary_id").agg(F.count(F.lit(1)).alias("n"))
    lost = claimed.join(beneficiaries.select("beneficiary_id"), "beneficiary_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    repeated = messages.groupBy("conversation_id", "position").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    reused = claims.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    zero = F.col("n") == 0
    return _counted(reused, "claim_ids_unique", lambda n: n == 0).unionByName(report(unknown, {"decision_references_payment": (F.col("n"), zero)})).unionByName(
        report(lost, {"claims_without_beneficiary": (F.col("n"), F.col("n") > 0)})).unionByName(
        _counted(repeated, "message_positions_unique", lambda n: n == 0))


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """Required tables and columns that are absent; looks at schemas only."""
    return [f"{t}.{c}" for t, cols in required.items() for c in cols if t not in tables or c not in tables[t].columns]
