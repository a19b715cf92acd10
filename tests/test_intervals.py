"""Points and validity intervals by dyadic nodes against plain comparison, and a price list of 100,000 intervals on one SKU."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paywarden.operators import intervals as T
from paywarden.operators import usage as U

ZERO = dt.datetime(2024, 1, 1)
RANGES = "sku string, s timestamp_ntz, e timestamp_ntz, price int"


def test_cover_is_exact_and_small(spark):
    pick = random.Random(4)
    spans = [(a, a + pick.randint(-1, 70)) for a in [pick.randint(0, 200) for _ in range(300)]]
    for r in spark.createDataFrame(spans, "a bigint, b bigint").withColumn("n", T.cover(F.col("a"), F.col("b"), 9)).collect():
        steps = sorted(s for n in r.n for s in range(n.node << n.level, (n.node + 1) << n.level))
        assert steps == list(range(r.a, r.b)) and len(r.n) <= 18


@pytest.mark.parametrize("unit", [dt.timedelta(days=1), dt.timedelta(seconds=7), dt.timedelta(microseconds=13)])
@pytest.mark.parametrize("closed", [False, True])
def test_join_equals_comparison(spark, unit, closed):
    pick = random.Random(int(unit.total_seconds() * 1e6) + closed)
    ranges = []
    for i in range(200):
        a = pick.randint(0, 60)
        b = None if pick.random() < 0.1 and not closed else ZERO + unit * (a + pick.randint(-2, 20))
        ranges.append((pick.choice("xy"), None if pick.random() < 0.03 else ZERO + unit * a, b, i))
    facts = [(i, pick.choice(["x", "y", "z", None]), None if pick.random() < 0.05 else ZERO + unit * pick.randint(-3, 90) + pick.choice([0, 0, 1]) * dt.timedelta(microseconds=1))
             for i in range(300)]
    want = []
    for i, sku, t in facts:
        mine = [p for s, a, b, p in ranges if s == sku and t is not None and a is not None and a <= t and (b is None or (t <= b if closed else t < b))]
        want += [(i, p) for p in mine] or [(i, None)]
    frame = spark.createDataFrame(facts, "id bigint, sku string, t timestamp_ntz")
    for size in ({}, {"max_rows": 10, "floor": 5, "salts": 4}):
        got = T.interval_join(frame, "id", ["sku"], "t", spark.createDataFrame(ranges, RANGES), "s", F.col("e"), closed, **size)
        assert sorted(map(repr, ((r.id, r.price) for r in got.collect()))) == sorted(map(repr, want))
        assert got.columns == ["id", "sku", "t", "s", "e", "price"]


def test_no_ranges_and_no_facts(spark):
    facts, none = spark.createDataFrame([(1, "x", ZERO)], "id bigint, sku string, t timestamp_ntz"), spark.createDataFrame([], RANGES)
    assert [r.price for r in T.interval_join(facts, "id", ["sku"], "t", none, "s", F.col("e"), False).collect()] == [None]
    one = spark.createDataFrame([("x", ZERO, None, 5)], RANGES)
    assert T.interval_join(facts.limit(0), "id", ["sku"], "t", one, "s", F.col("e"), False).count() == 0
    assert T.interval_join(facts, "id", ["sku"], "t", one, "s", F.col("e"), False).first().price == 5


def test_a_long_price_list_makes_a_row_for_each_match(spark):
    minute, n = "INTERVAL 1 MINUTE", 100_000
    prices = spark.range(n).select(
        F.lit("A").alias("sku_name"), F.lit("DBU").alias("usage_unit"), F.expr(f"TIMESTAMP_NTZ '2024-01-01' + id * {minute}").alias("price_start_time"),
        F.expr(f"TIMESTAMP_NTZ '2024-01-01' + (id + 1) * {minute}").alias("price_end_time"), F.col("id").cast("decimal(38,18)").alias("unit_price_usd"))
    usage = spark.range(50_000).select(
        F.col("id").alias("usage_id"), F.lit("A").alias("sku_name"), F.lit("DBU").alias("usage_unit"),
        F.expr(f"TIMESTAMP_NTZ '2024-01-01' + (id * 37 % {n}) * {minute} + INTERVAL 30 SECOND").alias("usage_end_time"))
    got = U.price_half_open(usage, prices)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString() and "price_start_time#" in got._jdf.queryExecution().toString()
    row = got.agg(F.count("*").alias("rows"), F.count_if(F.col("unit_price_usd") == F.col("usage_id") * 37 % n).alias("right")).first()
    assert (row.rows, row.right) == (50_000, 50_000)
    both = U.price_closed(usage.withColumn("usage_end_time", F.expr(f"usage_end_time + INTERVAL 30 SECOND")), prices, dt.date(2024, 6, 1)).count()
    assert both == 100_000 - usage.filter(f"usage_id * 37 % {n} = {n - 1}").count()
