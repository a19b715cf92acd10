"""Every registered query on the smallest data folder, next to its SQL; plan shape of the main ones."""

import os
import re

import pytest

import __spark_entry__ as entry
from check import rows_of
from paywarden.plans import load
from paywarden.plans.registry import Context
from paywarden.schemas import TABLES

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test data")
QUERIES = load()
ORACLE = {key: e.sql for key, e in QUERIES.items() if e.sql}
ROWS_ONLY = {"vector_index_hits", "disposition_model"}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{PATH}/{name}.parquet')")
    return con


def test_only_model_and_index_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, PATH)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if key in ROWS_ONLY:
        assert got[1]
        return
    cur = duck.execute(ORACLE[key])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "gold_open_queue", "metric_view", "latest_action_join", "queue_summary", "program_signal_counts", "priced_usage",
    "usage_overview", "governance_spend", "discount_or_join", "workflow_state", "daily_flag_rate", "disposition_features"])
def test_no_nested_loops_or_cross_products(spark, key):
    text = plan(QUERIES[key](spark, PATH))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_predicates_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["exposure_by_program"](spark, PATH))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "lineitem" in line)
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_returnflag,R\)", scan)
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan


def test_stored_queue_equals_the_lazy_one(spark):
    c = Context(spark, PATH)
    assert sorted(map(repr, c.with_stored_queue().s.scored.collect())) == sorted(map(repr, c.s.scored.collect()))


def test_projection_equals_the_join_of_stored_tables(spark):
    from paywarden.operators.scoring import queue_scored_join
    s = Context(spark, PATH).s
    assert sorted(map(repr, queue_scored_join(s.queue, s.recs).collect())) == sorted(map(repr, s.scored.collect()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["program", "improper_exposure_usd", "flagged_cases"]
