"""Change feed and streams: end state equals the batch form, whatever the file order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paywarden.operators import changes
from paywarden.session import work_dir
from paywarden.streaming import feeds

T0 = dt.datetime(2024, 1, 1)
DDL = ("id long, status string, action_type string, _pg_change_type string, _pg_lsn long, _pg_xid int, "
       "_timestamp timestamp_ntz, _sort_by long")


def change(i, kind, status, n):
    return (i, status, "release", kind, n // 2 * 64, n // 2, T0 + dt.timedelta(minutes=n), n)


ROWS = [
    change(1, "insert", "proposed", 2), change(1, "update_preimage", "proposed", 4), change(1, "update_postimage", "approved", 5),
    change(2, "insert", "proposed", 6), change(2, "delete", "proposed", 8), change(3, "insert", "proposed", 10),
]


def test_apply_and_history(spark):
    feed = spark.createDataFrame(ROWS, DDL)
    assert sorted((r.id, r.status) for r in changes.apply_latest(feed).collect()) == [(1, "approved"), (3, "proposed")]
    hist = sorted((r.id, r.version, r.valid_to is None, r.is_current) for r in changes.history(feed).collect())
    assert hist == [(1, 1, False, False), (1, 2, True, True), (2, 1, False, False), (3, 1, True, True)]
    diff = changes.update_diffs(feed).collect()
    assert [(r.id, r.changed_columns) for r in diff] == [(1, ["status"])]


def files(spark, rows, ddl, reverse=False):
    """One file per row, written oldest or newest first."""
    path = work_dir(spark, "feed")
    for row in (reversed(rows) if reverse else rows):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("reverse", [False, True])
def test_late_changes_do_not_bring_rows_back(spark, reverse):
    schema = spark.createDataFrame([], DDL).schema
    path = files(spark, ROWS, DDL, reverse)
    got = feeds.stream_latest(spark, path, schema, work_dir(spark, "o"), work_dir(spark, "c"), files_per_trigger=2)
    want = changes.apply_latest(spark.createDataFrame(ROWS, DDL))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_continues_from_its_checkpoint(spark):
    schema = spark.createDataFrame([], DDL).schema
    path, out, state = work_dir(spark, "feed"), work_dir(spark, "o"), work_dir(spark, "c")
    spark.createDataFrame(ROWS[:4], DDL).write.parquet(path)
    first = feeds.stream_latest(spark, path, schema, out, state)
    assert sorted(r.id for r in first.collect()) == [1, 2]
    spark.createDataFrame(ROWS[4:], DDL).write.mode("append").parquet(path)
    again = feeds.stream_latest(spark, path, schema, out, state)
    assert sorted(r.id for r in again.collect()) == [1, 3]


def test_windowed_counts(spark):
    schema = spark.createDataFrame([], DDL).schema
    path = files(spark, ROWS, DDL, reverse=True)
    got = feeds.stream_change_counts(spark, path, schema, work_dir(spark, "o"), work_dir(spark, "c"), "1 day",
                                     "5 minutes", files_per_trigger=1)
    want = changes.change_counts(spark.createDataFrame(ROWS, DDL).withColumn("_timestamp", F.col("_timestamp").cast("timestamp")),
                                 "5 minutes").select("w.start", "_pg_change_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("horizon", [None, "30 days"])
def test_repeated_flags_count_once(spark, horizon):
    ddl = "payment_id long, signal string, flagged_at timestamp"
    rows = [(1, "a", T0), (1, "a", T0 + dt.timedelta(days=2)), (1, "b", T0), (2, "a", T0 + dt.timedelta(days=1))]
    path = files(spark, rows, ddl)
    got = feeds.stream_flag_pairs(spark, path, spark.createDataFrame([], ddl).schema, work_dir(spark, "o"),
                                  work_dir(spark, "c"), horizon, files_per_trigger=1)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "a")]
