"""Price intervals, discounts and report parts on literal rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from paywarden.operators import usage as U

DAY = dt.datetime(2024, 1, 16)


def facts(spark, rows):
    return spark.createDataFrame(
        [(i, sku, product, "DBU", D("10"), t, t.date(), "w0") for i, (sku, product, t) in enumerate(rows)],
        "usage_id long, sku_name string, billing_origin_product string, usage_unit string, usage_quantity decimal(18,4), "
        "usage_end_time timestamp_ntz, usage_date date, workspace_id string")


@pytest.fixture
def prices(spark):
    return spark.createDataFrame(
        [("A", "DBU", dt.datetime(2024, 1, 1), DAY, D("0.1")), ("A", "DBU", DAY, None, D("0.2"))],
        "sku_name string, usage_unit string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, "
        "unit_price_usd decimal(38,18)")


def test_usage_on_the_boundary(spark, prices):
    u = facts(spark, [("A", "P", DAY), ("Z", "P", DAY)])
    half = sorted((r.usage_id, r.unit_price_usd) for r in U.price_half_open(u, prices).collect())
    assert [(i, p and float(p)) for i, p in half] == [(0, 0.2), (1, None)]
    closed = U.price_closed(u, prices, dt.date(2024, 1, 30)).filter("usage_id = 0")
    assert sorted(float(r.unit_price_usd) for r in closed.collect()) == [0.1, 0.2]


def test_discount_text(spark):
    rows = U.discount_table(spark, "A=0.1;b = 0.2 ;bad;C=x;*=0.05").collect()
    assert sorted((r.product, r.discount) for r in rows) == [("*", D("0.050")), ("A", D("0.100")), ("B", D("0.200")),
                                                            ("C", None)]
    assert [r.combination for r in sorted(rows, key=lambda r: r.order_id)] == ["*=0.05", "A=0.1", "B=0.2", "C=X"]


@pytest.mark.parametrize("plan", ["lookup", "joins"])
def test_or_join_multiplicity(spark, plan):
    u = facts(spark, [("A", "P", DAY), ("B", "B", DAY), ("X", "Y", DAY), ("A", "Q", DAY)])
    d = U.discount_table(spark, "A=0.1;P=0.2;B=0.3;B=0.4")
    got = U.with_discounts(u, d, bounded=True) if plan == "lookup" else U._discount_joins(u, d)
    want = u.join(d, (F.col("product") == F.col("sku_name")) | (F.col("product") == F.col("billing_origin_product")), "left")
    key = [F.col("usage_id"), F.col("discount")]
    assert sorted(map(tuple, got.select(*key).collect()), key=repr) == sorted(map(tuple, want.select(*key).collect()), key=repr)


@pytest.mark.parametrize("plan", ["lookup", "joins"])
def test_or_join_keeps_repeated_entries(spark, plan):
    u = facts(spark, [("A", "P", DAY), ("B", "B", DAY), ("X", "Y", DAY), (None, "A", DAY), (None, None, DAY)])
    d = U.discount_table(spark, "A=0.1;P=0.2;B=0.3")
    d = d.union(d)
    got = U.with_discounts(u, d, bounded=True) if plan == "lookup" else U._discount_joins(u, d)
    rows = sorted(((r.usage_id, r.discount) for r in got.select("usage_id", "discount").collect()), key=repr)
    assert rows == sorted([(0, D("0.100")), (0, D("0.200")), (1, D("0.300")), (3, D("0.100"))] * 2 + [(2, None), (4, None)], key=repr)


def test_global_discount_wins(spark, prices):
    u = facts(spark, [("A", "P", dt.datetime(2024, 1, 2))])
    cost = {text: float(U.priced_usage(u, prices, text, dt.date(2024, 1, 30)).collect()[0].usage_usd)
            for text in ("", "A=0.5", "A=0.5; * = .25")}
    assert cost == {"": 1.0, "A=0.5": 0.5, "A=0.5; * = .25": 0.75}


def test_top_n_with_remaining(spark):
    per = spark.createDataFrame([("a", D("5")), ("b", D("3")), ("c", D("2"))], "group_key string, spend_usd decimal(18,2)")
    assert sorted(map(tuple, U.top_n_with_remaining(per, 1).collect())) == [("a", D("5.00"), 1), ("remaining", D("5.00"), 2)]
    assert len(U.top_n_with_remaining(per, 3).collect()) == 3


def test_absent_products_show_zero(spark, prices):
    report = U.governance_spend(facts(spark, [("A", "APPS", dt.datetime(2024, 1, 2))]), prices, dt.date(2024, 1, 30))
    got = {r["product"]: (float(r.list_price_cost_usd), r.usage_records, float(r.total_list_price_cost_usd))
           for r in report.collect()}
    assert got == {"APPS": (1.0, 1, 1.0), "GENIE": (0.0, 0, 1.0), "AI_GATEWAY": (0.0, 0, 1.0), "MODEL_SERVING": (0.0, 0, 1.0)}


def test_unknown_keys_fall_back(spark):
    u = facts(spark, [("A", "P", DAY)])
    row = u.select(U.time_key("Fortnight").alias("t"), U.group_key("Nope").alias("g")).collect()[0]
    assert (row.t, row.g) == (DAY.date(), None)
