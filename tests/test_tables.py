"""Sinks and the decision desk on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paywarden.operators import desk as K
from paywarden.operators import timeline as T
from paywarden.plans.measures import parity
from paywarden.session import work_dir
from paywarden.sources import sinks

T0 = dt.datetime(2024, 1, 1)
RECS = ("payment_id long, recommended_disposition string, confidence_score double, projected_recovery_if_investigated_usd "
        "decimal(18,2), citizen_delay_cost_usd decimal(18,2), improper_payment_exposure_usd decimal(18,2), reasoning string")


def test_upsert_clears_the_vector_only_when_content_changes(spark):
    ddl = "k string, content string, vec array<float>, at timestamp_ntz"
    stored = spark.createDataFrame([("same", "x", [1.0], T0), ("changed", "x", [1.0], T0), ("gone", "x", [1.0], T0),
                                    ("null", None, [1.0], T0)], ddl)
    incoming = spark.createDataFrame([("same", "x"), ("changed", "y"), ("new", "z"), ("null", None)], "k string, content string")
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    got = {r.k: (r.content, r.vec, r.at.month) for r in sinks.upsert_by_key(
        stored, incoming, "k", "content", "vec", "at", now).collect()}
    assert got == {"same": ("x", [1.0], 1), "changed": ("y", None, 2), "gone": ("x", [1.0], 1), "new": ("z", None, 2),
                   "null": (None, [1.0], 1)}


def test_insert_if_absent_is_idempotent(spark):
    a = spark.createDataFrame([(1, "old")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    once = sinks.insert_if_absent(a, b, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "old"), (2, "new")]
    assert sorted(map(tuple, sinks.insert_if_absent(once, b, "k").collect())) == sorted(map(tuple, once.collect()))
    assert sinks.load_if_empty(a, b, "k").count() == 1
    assert sinks.load_if_empty(sinks.empty_like(a), b, "k").count() == 2


def test_snapshot_needs_a_unique_key(spark):
    good = spark.createDataFrame([(1,), (2,)], "k int")
    assert sinks.publish_snapshot(good, work_dir(spark, "t"), "k") == 2
    with pytest.raises(ValueError):
        sinks.publish_snapshot(good.union(good), work_dir(spark, "t"), "k")


def test_missing_optional_table_is_empty(spark):
    df = sinks.optional_table(spark, "no_such_table", "k int")
    assert df.columns == ["k"] and df.isEmpty()
    recs = sinks.optional_table(spark, "no_such_recs", RECS)
    assert K.mirror_recommendations(recs).isEmpty()


def actions(spark, rows):
    return spark.createDataFrame(
        [(i, p, a, "approved", "u", t, None, t) for i, p, a, t in rows],
        "id long, payment_id long, action_type string, status string, approved_by string, decided_at timestamp_ntz, "
        "hold_duration_hours int, created_at timestamp_ntz")


def test_latest_decision_breaks_ties_by_id(spark):
    log = actions(spark, [(1, 5, "release", T0), (3, 5, "refer_to_investigation", T0), (2, 5, "hold_for_verification", T0),
                          (9, 6, "release", T0 - dt.timedelta(days=1)), (8, 6, "hold_for_verification", T0)])
    assert {r.payment_id: r.id for r in K.latest_actions(log).collect()} == {5: 3, 6: 8}


def test_text_search(spark):
    q = spark.createDataFrame([(17, None, "income_mismatch"), (2, "TANF", None), (3, "SNAP", "x")],
                              "payment_id long, program string, signals string")
    found = {t: sorted(r.payment_id for r in K.text_search(q, t).collect()) for t in (" tAnF ", "17", "INCOME", "", None)}
    assert found == {" tAnF ": [2], "17": [17], "INCOME": [17], "": [2, 3, 17], None: [2, 3, 17]}


def test_a_batch_is_recorded_whole_or_not_at_all(spark):
    req = spark.createDataFrame(
        [(1, 10, "hold_for_verification", 48, 100), (2, 99, "release", None, 100), (3, 11, "release", None, 200)],
        "id long, payment_id long, action_type string, hold_duration_hours int, batch_id long").select(
        "*", F.lit("memo").alias("drafted_request"), F.lit(1).cast("decimal(18,2)").alias("predicted_recovery_usd"),
        F.lit("lead").alias("requested_by"), F.lit(T0).cast("timestamp_ntz").alias("requested_at"))
    pos = spark.createDataFrame([(10, "a, b"), (11, "")], "payment_id long, signals string")
    got = K.record_decisions(req, pos).collect()
    assert [(r.id, r.signal_type, r.audit_trail[0].notes) for r in got] == [(3, "unspecified", "Examiner-approved release.")]
    assert K.record_decisions(req, pos, "LEAD ").count() == 1
    assert K.record_decisions(req, pos, "other").count() == 0
    for names, n in ([("user9",), (" LEAD ",), ("lead",), ("user123456",)], 1), ([("user9",)], 0):
        assert K.record_decisions(req, pos, supervisors=req.sparkSession.createDataFrame(names, "identity string")).count() == n


def test_parity_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert tuple(parity(a, b).collect()[0]) == (1, 1, 3)


def test_clean_history_drops_blank_and_foreign_messages(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", " \n\t"), (1, 2, "system", "x"),
                               (2, 0, "user", "hi"), (2, 1, "assistant", "yo")],
                              "conversation_id long, position long, role string, content string")
    assert {r.conversation_id: (r.kept, r.last_role, r.sendable) for r in T.clean_history(m).collect()} == {
        1: (1, "user", True), 2: (2, "assistant", False)}


def test_ranking_treats_missing_figures_as_zero_and_unknown_dispositions_as_none(spark):
    rows = spark.createDataFrame([(1, "escalate", 0.4, None, None, None, "x")], RECS)
    r = K.mirror_recommendations(rows).collect()[0]
    assert r.recommended_disposition is None and r.recommended_hold_hours is None
    assert [float(o.predicted_net_value_usd) for o in r.action_ranking] == [0.0, 0.0, 0.0]


def test_positions_continue_after_the_stored_maximum(spark):
    stored = spark.createDataFrame([(1, 0), (1, 4)], "conversation_id long, position long")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1), (2, "d", 2)], "conversation_id long, content string, seq long")
    got = T.append_positions(stored, new, [F.asc("seq")])
    assert sorted((r.conversation_id, r.position, r.content) for r in got.collect()) == [
        (1, 5, "a"), (1, 6, "b"), (2, 0, "c"), (2, 1, "d")]


def test_work_dir_on_a_cluster_needs_the_shared_folder(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError):
        work_dir(Session(spark_master="yarn"), "x")
    assert work_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
