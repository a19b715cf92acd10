"""Known values of the scoring rules on literal rows."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.functions import text as X
from paywarden.operators import desk as K
from paywarden.operators import scoring as S


def score(spark, amount, signals, program="TANF"):
    """One payment with the given flag rows through the whole chain."""
    flags = spark.createDataFrame([(1, s) for s in signals], "payment_id long, signal string")
    labels = spark.createDataFrame([("income_mismatch", "eligibility", None, None)],
                                   "signal string, signal_category string, classification_confidence double, "
                                   "classification_error string")
    payments = spark.sql(f"select 1L payment_id, 7L beneficiary_id, 1L claim_id, cast({amount} as decimal(18,2)) "
                         "payment_amount_usd, date'2001-01-01' queue_date, 'pre_disbursement' payment_status")
    people = spark.createDataFrame([(7, program, "MN")], "beneficiary_id long, program string, state string")
    claims = spark.createDataFrame([], "claim_id long, claim_type string")
    silver = S.payments_flagged(payments, people, claims, S.signal_summary(flags, labels))
    queue = S.open_queue(silver)
    rec = K.mirror_recommendations(S.recommendations(queue)).collect()[0]
    return queue.collect()[0], S.recommendations(queue).collect()[0], rec


def test_stacked_strong_payment(spark):
    q, r, m = score(spark, "3227.73", ["cross_agency_fraud_flag", "income_mismatch"])
    assert (q.risk_level, q.improper_payment_exposure_usd) == ("high", D("2582.18"))
    assert q.projected_recovery_if_investigated_usd == D("1678.42")  # from the rounded exposure
    assert (r.citizen_delay_cost_usd, r.recommended_disposition, r.confidence_score) == (
        D("48.42"), "hold_for_verification", 0.95)
    assert q.signal_category_set == ["eligibility", "unclassified"]
    assert r.reasoning.startswith("High-risk: 2 fraud signal(s) on a $3,228 TANF payment → estimated $2,582 improper")
    assert "[cross_agency_fraud_flag, income_mismatch]" in r.memo_scaffold
    assert [(o.disposition, o.hold_hours, o.cost_usd, o.predicted_net_value_usd) for o in m.action_ranking] == [
        ("release", 0, D("0.00"), D("0.00")), ("hold_for_verification", 72, D("48.42"), D("1630.00")),
        ("refer_to_investigation", 240, D("161.40"), D("2420.78"))]
    assert m.recommended_hold_hours == 72


@pytest.mark.parametrize("amount, signals, risk, exposure, disposition, confidence", [
    ("3341.51", ["duplicate_identity"], "moderate", "501.23", "hold_for_verification", 0.70),
    ("3172.29", ["residence_mismatch"], "moderate", "475.84", "release", 0.70),
    ("100.00", ["residence_mismatch", "manual_review_flag"], "moderate", "15.00", "hold_for_verification", 0.40),
    ("100.00", ["residence_mismatch", "manual_review_flag", "income_mismatch"], "moderate", "15.00",
     "refer_to_investigation", 0.40),
])
def test_branches(spark, amount, signals, risk, exposure, disposition, confidence):
    q, r, _ = score(spark, amount, signals)
    assert (q.risk_level, q.improper_payment_exposure_usd, r.recommended_disposition, r.confidence_score) == (
        risk, D(exposure), disposition, confidence)


def test_repeated_flag_counts_but_is_named_once(spark):
    q, _, _ = score(spark, "100.00", ["income_mismatch", "income_mismatch"])
    assert q.n_signals == 2 and q.signal_list == ["income_mismatch"]


def test_no_signals(spark):
    row = spark.range(1).select(
        R.risk_level(F.lit(0), F.lit(0)).alias("risk"),
        R.improper_exposure(F.lit("1000.00").cast(R.MONEY), F.lit("low")).alias("exposure"),
        R.recommended_disposition(F.lit(0), F.lit(0)).alias("d"), R.confidence_score(F.lit(0), F.lit(0)).alias("c"),
        R.signal_strength_mix(F.lit(0)).alias("mix")).collect()[0]
    assert tuple(row) == ("low", D("20.00"), "release", 0.40, "none")


@pytest.mark.parametrize("amount, rounded", [("1.005", "1.01"), ("2.675", "2.68"), ("0.5", "0.50")])
def test_money_rounds_half_up(spark, amount, rounded):
    assert spark.range(1).select(R.money(F.lit(amount).cast("decimal(18,6)"))).collect()[0][0] == D(rounded)


def test_dollars_round_half_even(spark):
    got = spark.createDataFrame([(2582.5,), (2583.5,), (3227.73,)], "x double").select(F.format_number("x", 0)).collect()
    assert [r[0] for r in got] == ["2,582", "2,584", "3,228"]


@pytest.mark.parametrize("value, want", [
    (None, 20), ("abc", 20), (0, 20), (-3, 20), ("7.9", 7), (5000, 100), (float("nan"), 20), (float("inf"), 20)])
def test_clamp_limit(value, want):
    assert R.clamp_limit(value, 20, 100) == want


def test_string_list(spark):
    rows = spark.createDataFrame([('["a","b"]',), ('["valid", 7, null]',), ("not json",), ('{"k": 1}',), (None,)], "t string")
    assert [r[0] for r in rows.select(X.string_list(F.col("t"))).collect()] == [["a", "b"], ["valid"], [], [], []]


@pytest.mark.parametrize("text, blocked", [
    ("show me all payments", True), ("dump the whole queue", True), ("SELECT  * from t", True),
    ("every record please", True), ("list all data", True), ("give me everything", True),
    ("the entire claims table", True), ("a query without a limit", True), ("unrestricted access", True),
    ("why is payment 17 flagged?", False), ("all signals on payment 17", False), ("rank the options for payment 42", False),
    ("find similar cross-agency fraud cases", False), ("hold payment 17 for verification", False), (None, False)])
def test_request_screen(spark, text, blocked):
    row = spark.createDataFrame([(text,)], "t string").select(X.screen_match(F.col("t")).alias("m")).collect()[0]
    assert (row.m is not None) == blocked
    if blocked:
        assert row.m.matched and row.m.reason


def test_roles(spark):
    assert K.parse_allow_list(" A@EXAMPLE.COM, b@example.com, ,a@example.com ") == ["a@example.com", "b@example.com"]
    allow = "lead@example.com, SUPERVISOR@EXAMPLE.COM"
    who = spark.createDataFrame([(" supervisor@example.com\n",), ("visor@example.com",), ("",), (None,)], "w string")
    assert [r[0] for r in who.select(K.role_of(F.col("w"), allow)).collect()] == [
        "supervisor", "examiner", "examiner", "examiner"]


def test_primary_signal(spark):
    rows = spark.createDataFrame([("b, a",), ("",), (" , x",), (None,)], "s string")
    assert [r[0] for r in rows.select(K.primary_signal(F.col("s"))).collect()] == [
        "b", "unspecified", "unspecified", "unspecified"]


def test_age_label(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' now, explode(array(timestamp_ntz'2024-01-01 23:59:30', "
                     "timestamp_ntz'2024-01-01 23:15:00', timestamp_ntz'2024-01-01 20:30:00', "
                     "timestamp_ntz'2023-12-30 23:00:00')) at")
    assert [r[0] for r in rows.select(X.age_label(F.col("at"), F.col("now"))).collect()] == [
        "just now", "45m ago", "3h ago", "2d ago"]


def test_open_vocabulary_gives_the_same_summary(spark):
    rows = [(1, "income_mismatch"), (1, "income_mismatch"), (1, "deceased_payee"), (2, None), (2, "unheard_of"), (3, None)]
    flags = spark.createDataFrame(rows, "payment_id long, signal string")
    labels = spark.createDataFrame([("income_mismatch", "eligibility", 0.9, None), ("deceased_payee", "fraud", 0.4, None)],
                                   "signal string, signal_category string, classification_confidence double, "
                                   "classification_error string")
    counted, paired = S.signal_summary(flags, labels), S._summary_by_pairs(flags, labels)
    assert sorted(map(repr, counted.collect())) == sorted(map(repr, paired.select(*counted.columns).collect()))
    got = {r.payment_id: r for r in counted.collect()}
    assert got[1].n_signals == 3 and got[1].signal_rows == [1, 2] and got[1].ai_classification_min_confidence == 0.4
    assert got[2].signal_list == ["unheard_of"] and got[2].signal_categories == ["unclassified", "unclassified"]
    assert got[3].signal_list == [] and got[3].signal_strengths == ["weak"]
