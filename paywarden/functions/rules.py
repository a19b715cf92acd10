"""Business rules as Column expressions.

Money is DECIMAL throughout, so sums do not depend on the order in which executors add them and
rounding is exact half-up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal vocabulary, in index order.
SIGNALS = [
    "duplicate_identity",
    "deceased_payee",
    "income_mismatch",
    "benefit_overlap",
    "cross_agency_fraud_flag",
    "employment_mismatch",
    "residence_mismatch",
    "manual_review_flag",
]
# Strength classes; every other signal is weak.
STRONG = ["duplicate_identity", "deceased_payee", "cross_agency_fraud_flag"]
MODERATE = ["income_mismatch", "benefit_overlap", "employment_mismatch"]
# Dispositions, statuses, risk levels.
RELEASE, HOLD, REFER = "release", "hold_for_verification", "refer_to_investigation"
DISPOSITIONS = [RELEASE, HOLD, REFER]
STATUSES = ["proposed", "approved", "executed", "overridden"]
RISKS = ["high", "moderate", "low"]
# Rates.
EXPOSURE_RATE = {"high": "0.80", "moderate": "0.15", "low": "0.02"}
RECOVERY_RATE = "0.65"
DAILY_DELAY_RATE = "0.005"
HOLD_DAYS, REFER_DAYS = 3, 10
HOLD_HOURS, REFER_HOURS = 72, 240

MONEY = "decimal(18,2)"


def dec(text: str) -> Column:
    """Exact decimal literal."""
    scale = len(text.partition(".")[2])
    return F.lit(text).cast(f"decimal({max(len(text.replace('.', '')), scale + 1)},{scale})")


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def signal_strength(signal: Column) -> Column:
    return F.when(signal.isin(STRONG), "strong").when(signal.isin(MODERATE), "moderate").otherwise("weak")


def is_strong(signal: Column) -> Column:
    return F.when(signal.isin(STRONG), 1).otherwise(0)


def risk_level(n: Column, strong: Column) -> Column:
    return F.when((n >= 2) & (strong == 1), "high").when(n >= 1, "moderate").otherwise("low")


def improper_exposure(amount: Column, risk: Column) -> Column:
    rate = (
        F.when(risk == "high", dec(EXPOSURE_RATE["high"]))
        .when(risk == "moderate", dec(EXPOSURE_RATE["moderate"]))
        .otherwise(dec(EXPOSURE_RATE["low"]))
    )
    return money(amount * rate)


def projected_recovery(exposure: Column) -> Column:
    """Works on the already rounded exposure, so the result is rounded twice on purpose."""
    return money(exposure * dec(RECOVERY_RATE))


def citizen_delay_cost(amount: Column) -> Column:
    return money(amount * dec(DAILY_DELAY_RATE) * HOLD_DAYS)


def has_strong(strengths: Column) -> Column:
    return F.when(F.array_contains(strengths, "strong"), 1).otherwise(0)


def _three_way(n: Column, strong: Column, refer, hold, release) -> Column:
    return F.when(n >= 3, refer).when((n == 2) | (strong == 1), hold).otherwise(release)


def recommended_disposition(n: Column, strong: Column) -> Column:
    return _three_way(n, strong, REFER, HOLD, RELEASE)


def confidence_score(n: Column, strong: Column) -> Column:
    return F.when((n >= 2) & (strong == 1), 0.95).when(n == 1, 0.70).otherwise(0.40)


def signal_strength_mix(n: Column) -> Column:
    return F.when(n >= 3, "stacked_strong").when(n == 2, "mixed").when(n == 1, "single").otherwise("none")


def recovery_outcome(improper: Column, recovery: Column) -> Column:
    return F.when(improper & (recovery > 0), recovery).otherwise(F.lit(0).cast(MONEY))


def hold_hours(disposition: Column) -> Column:
    return F.when(disposition == HOLD, HOLD_HOURS)


def in_domain(c: Column, domain: list[str], default: str | None = None) -> Column:
    """Values outside the domain, and NULL, become the default."""
    return F.when(c.isin(domain), c).otherwise(F.lit(default).cast("string"))


def queue_risk(c: Column) -> Column:
    """Queue reads know two risk levels: anything that is not high counts as moderate."""
    return F.when(c == "high", "high").otherwise("moderate")


def flag_risk(c: Column) -> Column:
    """The open-flag read keeps only the two known levels and turns the rest into NULL."""
    return F.when(c.isin("high", "moderate"), c)


def case_status(action: Column) -> Column:
    return (
        F.when(action == HOLD, "held").when(action == RELEASE, "released")
        .when(action == REFER, "investigating").otherwise("pre-disbursement")
    )


def _dollars(c: Column) -> Column:
    return F.format_number(c.cast("double"), 0)


def reasoning(risk, n, strong, amount, program, exposure, recovery, delay) -> Column:
    # Fixed text: wording of the explanation.
    advice = _three_way(
        n, strong,
        F.lit("Recommend refer-to-investigation: stacked signals justify a full investigation."),
        F.concat(
            F.lit("Recommend hold-for-verification: verification (~$"), _dollars(delay),
            F.lit(" delay cost over 3 days) confirms before disbursement. "
                  "If improper, recovery is preserved pre-disbursement."),
        ),
        F.lit("Recommend release: single weak signal; citizen-delay cost of holding a likely-legitimate "
              "payment outweighs the low projected recovery."),
    )
    return F.concat(
        F.upper(F.substring(risk, 1, 1)), F.substring(risk, 2, 64),
        F.lit("-risk: "), n.cast("string"), F.lit(" fraud signal(s) on a $"), _dollars(amount),
        F.lit(" "), program, F.lit(" payment → estimated $"), _dollars(exposure),
        F.lit(" improper exposure, $"), _dollars(recovery),
        F.lit(" projected recovery if investigated. "), advice,
    )


def memo(payment_id, program, amount, n, strong, signals, risk, exposure) -> Column:
    # Fixed text: wording of the case memo.
    return F.concat(
        F.lit("Case memo — Payment "), payment_id.cast("string"), F.lit(" ("), program, F.lit(", $"),
        _dollars(amount), F.lit("): "), n.cast("string"), F.lit(" fraud signal(s) ["),
        F.array_join(signals, ", "), F.lit("]. Risk level "), risk, F.lit(". Improper exposure $"),
        _dollars(exposure), F.lit(". Prescribed disposition: "),
        _three_way(n, strong, "refer to investigation.", "hold for verification.", "release."),
    )


def clamp_limit(value, default: int, cap: int | None = None) -> int:
    """Row limit from an untrusted parameter: default when missing or not positive, floored, capped."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    if number != number or number in (float("inf"), float("-inf")) or number < 1:
        return default
    return int(number) if cap is None else min(int(number), cap)
