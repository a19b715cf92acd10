"""Joins, ranks and aggregates with one key holding most rows, against the plain form."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paywarden.operators.joins import salted_join, sized_join
from paywarden.operators.ranking import distributed_rank, with_neighbour


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 facts: key 1 holds half, some keys are NULL or unknown."""
    k = F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50)
    return spark.range(4000).select("id", k.cast("long").alias("k"), (F.col("id") * 37 % 1000).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, hot, how):
    dim = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    got = salted_join(hot, dim, "k", "id", hot, how, salts=8, share=0.01, floor=10)
    want = hot.join(dim, "k", how)
    assert rows(got.select("id", "k", "v", "name")) == rows(want.select("id", "k", "v", "name"))


@pytest.mark.parametrize("limit", [0, 1000])
def test_sized_join_is_the_same_beyond_the_bound(spark, hot, limit):
    dim = spark.createDataFrame([(1, 0, 500, "a"), (1, 500, 2000, "b"), (3, 0, 2000, "c")], "k long, lo int, hi int, tag string")
    residual = (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))
    got = sized_join(hot, dim, ["k"], "left", residual, spread=F.xxhash64("id"), max_rows=limit, salts=8, share=0.01,
                     floor=10)
    d = dim.alias("d")
    want = hot.alias("h").join(d, (F.col("h.k") == F.col("d.k")) & residual, "left").select("id", F.col("h.k"), "v", "tag")
    assert rows(got.select("id", "k", "v", "tag")) == rows(want)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_distributed_rank_equals_window(hot, keys):
    order = [F.desc("v"), F.asc("id")]
    got = distributed_rank(hot, keys, order, ranges=7).select("id", "rank")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    assert rows(got) == rows(hot.select("id", F.row_number().over(w).cast("long").alias("rank")))


def test_neighbours_equal_lag_and_lead(hot):
    data = hot.filter(F.col("k").isNotNull())
    ranked = distributed_rank(data, ["k"], [F.asc("id")], ranges=5)
    got = with_neighbour(with_neighbour(ranked, ["k"], "rank", ["v"], 1, "next_"), ["k"], "rank", ["v"], -1, "prev_")
    w = Window.partitionBy("k").orderBy("id")
    want = data.select("id", F.lead("v").over(w).alias("next_v"), F.lag("v").over(w).alias("prev_v"))
    assert rows(got.select("id", "next_v", "prev_v")) == rows(want)
