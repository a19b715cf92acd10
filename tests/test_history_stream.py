"""Validity intervals from a stream: the same as from the whole feed for any order of files, after a restart, and with old versions removed."""

import datetime as dt
import random

import pytest

from paywarden.operators import changes
from paywarden.session import work_dir
from paywarden.streaming import history

T0 = dt.datetime(2024, 1, 1)
DDL = ("id long, status string, action_type string, _pg_change_type string, _pg_lsn long, _pg_xid int, "
       "_timestamp timestamp_ntz, _sort_by long")
COLUMNS = ["id", "status", "action_type", "valid_from", "valid_to", "is_current", "version"]


def feed(n=40, seed=1):
    pick, rows, at = random.Random(seed), [], {}
    for s in range(1, n):
        i = pick.choice([1, 1, 1, 2, 3])
        kind = "insert" if i not in at else pick.choice(["update_postimage", "update_postimage", "delete"])
        at[i] = kind
        if kind == "update_postimage":
            rows.append((i, "old", "old", "update_preimage", s, s, T0 + dt.timedelta(hours=s), 2 * s))
        rows.append((i, f"s{s}", f"a{s % 3}", kind, s, s, T0 + dt.timedelta(hours=s), 2 * s + 1))
    return rows


def write(spark, rows, path, per_file):
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k:k + per_file], DDL).coalesce(1).write.mode("append").parquet(path)


def listed(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_late_changes_correct_intervals_and_a_restart_goes_on(spark, order):
    rows = feed()
    want = listed(changes.history(spark.createDataFrame(rows, DDL)))
    rows = rows[::-1] if order == "backward" else random.Random(2).sample(rows, len(rows)) if order == "mixed" else rows
    path, out, state = (work_dir(spark, n) for n in ("feed", "history", "state"))
    schema = spark.createDataFrame([], DDL).schema
    write(spark, rows[:30], path, 10)
    history.stream_history(spark, path, schema, out, state, "40 days", files_per_trigger=1)
    write(spark, rows[25:], path, 15)  # five changes come again
    assert listed(history.stream_history(spark, path, schema, out, state, "40 days", files_per_trigger=1)) == want


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PLAIN = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_a_session_with_sparks_default_state_store_streams_too_and_keeps_its_setting(spark):
    rows, before = feed(), spark.conf.get(PROVIDER)
    path, out, state = (work_dir(spark, n) for n in ("feed", "history", "state"))
    write(spark, rows, path, 20)
    spark.conf.set(PROVIDER, PLAIN)
    try:
        got = listed(history.stream_history(spark, path, spark.createDataFrame([], DDL).schema, out, state, "40 days", files_per_trigger=1))
        assert spark.conf.get(PROVIDER) == PLAIN
    finally:
        spark.conf.set(PROVIDER, before)
    assert got == listed(changes.history(spark.createDataFrame(rows, DDL)))


def micros(**since):
    return dt.timedelta(**since) // dt.timedelta(microseconds=1)


class Handle:
    """A state store of one list, and no timers."""

    def __init__(self):
        self.rows = []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def registerTimer(self, at):
        self.timer = at


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at // 1000


def test_passed_versions_leave_the_state_but_the_last(spark):
    from pyspark.sql import Row
    handle, p = Handle(), history.Intervals()
    p.init(handle)
    rows = [Row(_sort_by=s, at=micros(hours=s), status="x", action_type="y", _pg_change_type="insert") for s in range(10)]
    assert len(list(p.handleInputRows((1,), iter(rows), None))) == 10
    assert list(p.handleInputRows((1,), iter(rows[3:5]), None)) == []  # repeats
    assert list(p.handleExpiredTimer((1,), Clock(micros(hours=6)), None)) == []
    assert [v[0] for v in handle.rows] == [5, 6, 7, 8, 9]
    list(p.handleExpiredTimer((1,), Clock(micros(days=9)), None))
    assert [v[0] for v in handle.rows] == [9]
    later = Row(_sort_by=20, at=micros(days=10), status="z", action_type="y", _pg_change_type="insert")
    assert [(r._sort_by, r.valid_to) for r in p.handleInputRows((1,), iter([later]), None)] == [(9, later.at), (20, None)]
