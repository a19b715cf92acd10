"""Stored measure parts after inserts, changes and deletes, against parts computed anew; heavy keys from a sketch."""

import itertools
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paywarden.operators import measures as M
from paywarden.operators.joins import heavy_keys
from paywarden.operators.upkeep import PartStore

SCORED = ("payment_id bigint, program string, risk_level string, recommended_disposition string, payment_amount_usd decimal(18,2), n_signals bigint, "
          "improper_payment_exposure_usd decimal(18,2), projected_recovery_if_investigated_usd decimal(18,2), confidence_score double")


def scored(k, version=0):
    kind = ["release", "hold_for_verification", "refer_to_investigation"][(k + version) % 3]
    amount = None if k % 5 == 0 else Decimal(100 * k + version) / 7
    return (k, ["SNAP", "TANF", None][k % 3 if k < 50 else 0], ["high", "low"][(k // 3 + version) % 2], kind,
            amount and amount.quantize(Decimal("0.01")), k % 4, None if k % 2 else Decimal(k), Decimal(k * 2), [0.9, 0.5, None][k % 3])


def test_upkeep_equals_recomputation(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(list(rows), SCORED)
    now, store = {}, PartStore(spark, str(tmp_path / "parts"), M.DIMENSIONS)
    batches = [({}, {k: 0 for k in range(40)}), ({k: 0 for k in range(10)}, {k: 1 for k in range(10)}),
               ({k: 0 for k in range(10, 25)}, {}), ({k: 1 for k in range(5)}, {**{k: 2 for k in range(5)}, **{k: 0 for k in range(60, 70)}}),
               ({k: 0 for k in range(60, 70)}, {})]

    def check(part_store):
        for size in range(4):
            for dims in map(list, itertools.combinations(M.DIMENSIONS, size)):
                rows = frame(scored(*x) for x in now.items())
                assert sorted(map(str, part_store.measures(dims).collect())) == sorted(map(str, M.measure(rows, dims).collect()))

    for n, (before, after) in enumerate(batches):
        old = {f: os.stat(f).st_mtime_ns for f in tmp_path.rglob("*.parquet")}
        for _ in range(2 if n == 2 else 1):  # a repeated batch counts once
            store.apply(n, frame(scored(*x) for x in before.items()) if before else None, frame(scored(*x) for x in after.items()) if after else None)
        assert all(os.stat(f).st_mtime_ns == t for f, t in old.items())
        for k in before:
            now.pop(k)
        now |= after
    check(store)
    small = store.compact(str(tmp_path / "compacted"))
    small.apply(9, None, frame([scored(99)]))
    now[99] = 0
    check(small)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_planted_hot_key_is_found_without_a_shuffle_by_key(spark, kind):
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).when(F.col("id") % 50 == 2, -1).otherwise(F.col("id"))
    facts = spark.range(0, 60_000, 1, 12).select(k.cast(kind).alias("k"))
    got = spark.range(1).select(heavy_keys(facts, "k", share=0.01, floor=10).alias("hot"))
    assert {str(x) for x in got.first().hot} == {"7", "-1"}
    assert "hashpartitioning(k" not in got._jdf.queryExecution().toString()
    assert spark.range(1).select(heavy_keys(facts.limit(0), "k").alias("hot")).first().hot == []
