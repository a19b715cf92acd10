"""Ranks and neighbours over ordered groups without a single-task sort.

Rows are laid out once in sorted ranges of (keys, order) and written to the shared folder with their
range and their place in it. A hot key, or the whole table when there are no keys, therefore spans many
ranges. The rank of a row is its place among the rows of its key in the range plus the rows of that key
in earlier ranges. Reading the written layout keeps places fixed when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.session import work_dir

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, row number in the low 33 bits


def distributed_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank",
                     ranges: int | None = None) -> DataFrame:
    """1-based row number per ``keys`` in ``order``; ``order`` must be total. Runs one write job."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_dir(spark, "ranges")
    by = [*[F.col(k) for k in keys], *order]
    laid = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    laid.write.parquet(path)
    stored = spark.read.schema(laid.schema).parquet(path).select(
        *df.columns, F.shiftright("__at", _PLACE_BITS).alias("__range"),
        F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("__place"))
    pieces = stored.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    # at most one row per key and range
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
    )
    on = F.col("__range") == F.col("__r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return stored.join(offsets, on).withColumn(name, F.col("__place") + F.col("__shift")).drop(
        "__range", "__r", "__place", "__shift", *[f"__k_{k}" for k in keys])


def with_neighbour(ranked: DataFrame, keys: list[str], rank: str, columns: list[str], offset: int,
                   prefix: str) -> DataFrame:
    """Adds ``<prefix><column>`` from the row of the same key ranked ``offset`` later (negative: earlier).

    An equi-join on (keys, rank): every pair is unique, so no task ever holds a whole group.
    """
    other = ranked.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], (F.col(rank) - offset).alias("__r"),
        *[F.col(c).alias(f"{prefix}{c}") for c in columns],
    )
    on = F.col(rank) == F.col("__r")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return ranked.join(other, on, "left").drop("__r", *[f"__k_{k}" for k in keys])
