"""Join helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 64
HEAVY_SHARE = 0.002
HEAVY_FLOOR = 100_000
#: Sketches of input partitions that are joined into one.
SKETCHES = 64


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Runs a bounded count: reads at most ``max_rows + 1`` rows of the small side."""
    return df.limit(max_rows + 1).count() <= max_rows


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> Column:
    """Array of the keys holding more than ``share`` of the rows (and more than ``floor``), as a scalar subquery.

    At most ``1 / share`` such keys can exist, whatever the data. They are found by a frequent-items sketch of bounded
    size: one for every few input partitions, then one of all, so nothing is shuffled by the key and no key is counted
    exactly. The sketch misses none, as its error is a fraction of ``share``; a key a little below it may come along.
    """
    most, tracked = math.ceil(1 / share) + 1, math.ceil(16 / share)
    kind = df.schema[key].dataType
    # One row without a key, so that an empty frame has a sketch as well.
    keys = df.select(F.col(key).alias("k"), F.lit(1).alias("n")).union(
        df.sparkSession.range(1).select(F.lit(None).cast(kind).alias("k"), F.lit(0).alias("n")))
    parts = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("sketch"), F.sum("n").alias("n"))
    whole = parts.agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("n").alias("n"))
    found = whole.select(F.expr(f"approx_top_k_estimate(sketch, {most})").alias("found"), "n")
    least = F.greatest(F.col("n") * F.lit(share * 0.75), F.lit(float(floor)))
    return found.select(F.transform(F.filter("found", lambda x: x["item"].isNotNull() & (x["count"] > least)), lambda x: x["item"])).scalar()


def _salted(big: DataFrame, small: DataFrame, key_of_big: Column, key_of_small: Column, hot: Column, spread: Column,
            salts: int) -> tuple[DataFrame, DataFrame]:
    """Salt the big rows of hot keys and repeat only the small rows they meet.

    A NULL key matches nothing, so an outer join may scatter those rows as it likes.
    """
    scattered = key_of_big.isNull() | F.array_contains(hot, key_of_big)
    left = big.withColumn("__salt", F.when(scattered, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(F.array_contains(hot, key_of_small), F.sequence(F.lit(0), F.lit(salts - 1)))
    right = small.withColumn("__copy", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
    return left, right


def salted_join(big: DataFrame, dim: DataFrame, key: str, spread: str, counted: DataFrame, how: str = "inner",
                salts: int = SALTS, **heavy) -> DataFrame:
    """Join facts with a dimension of any size on its key, spreading the heavy keys.

    ``counted`` is the cheapest frame that holds the fact keys (a raw scan), so finding the heavy keys
    does not run the plan behind ``big`` a second time. Facts of a heavy key draw a salt from the
    ``spread`` column and only those dimension rows are repeated; everything else joins unsalted.
    """
    hot = heavy_keys(counted, key, **heavy)
    left, right = _salted(big, dim, F.col(key), F.col(key), hot, F.xxhash64(spread), salts)
    return left.join(right.withColumnRenamed("__copy", "__salt"), [key, "__salt"], how).drop("__salt")


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", residual: Column | None = None,
               spread: Column | None = None, max_rows: int = BROADCAST_ROWS, salts: int = SALTS, bounded: bool = False,
               **heavy) -> DataFrame:
    """Equi-join ``big`` with a dimension on few, possibly hot, keys.

    The dimension is broadcast while a bounded count shows it fits. Beyond that bound the join shuffles
    with the heavy key combinations salted as in ``salted_join``. ``residual`` is a further condition,
    such as a validity interval. ``bounded`` skips the count for a dimension whose size is fixed by
    construction (a literal table, a vocabulary). Key columns of ``small`` are dropped.
    """
    right = small.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in small.columns])
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    left = big
    if bounded or fits_broadcast(small, max_rows):
        right = F.broadcast(right)
    else:
        of_big, of_small = F.xxhash64(*keys), F.xxhash64(*[f"__{k}" for k in keys])
        hot = heavy_keys(big.select(of_big.alias("__h")), "__h", **heavy)
        seed = spread if spread is not None else F.xxhash64(*big.columns)
        left, right = _salted(big, right, of_big, of_small, hot, seed, salts)
        on.append(F.col("__salt") == F.col("__copy"))
    condition = on[0]
    for extra in [*on[1:], *([residual] if residual is not None else [])]:
        condition = condition & extra
    return left.join(right, condition, how).drop(*[f"__{k}" for k in keys], "__salt", "__copy")
