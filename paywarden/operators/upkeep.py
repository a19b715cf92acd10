"""Upkeep of the stored measure parts by signed deltas.

The parts of a batch of changes are the parts of the new rows less those of the rows that they replace. Each batch is a
folder of its own below the store; nothing stored before is read or written for it, and a batch that is written again replaces
itself. All measures are sums and counts, so the sum over all batches equals the parts computed anew. A sum keeps the number
of its values that are not null beside it, so that it is null again when the last of them goes.

Cases: inserted rows have no row before, deleted rows none after. Groups without rows vanish. Null dimensions are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators import measures as M

KNOWN = "__known"


def signed_parts(before: DataFrame | None, after: DataFrame | None, dims: list[str]) -> DataFrame:
    """Parts of ``after`` less those of ``before`` by ``dims``; groups that stay as they are have no row."""
    values = M.values()
    sides = [side.select(*dims, F.lit(sign).cast("bigint").alias("sign"), *[v.alias(n) for n, v in values.items()])
             for side, sign in ((before, -1), (after, 1)) if side is not None]
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    sums = [F.sum(F.when(F.col("sign") > 0, F.col(n)).otherwise(-F.col(n))).alias(n) for n in values]
    known = [F.sum(F.when(F.col(n).isNotNull(), F.col("sign")).otherwise(0)).alias(n + KNOWN) for n in values]
    delta = rows.groupBy(*dims).agg(*sums, *known)
    same = F.lit(True)
    for n in values:
        same = same & (F.coalesce(F.col(n), F.lit(0)) == 0) & (F.col(n + KNOWN) == 0)
    return delta.filter(~same)


class PartStore:
    """Parts at the finest grain below one folder, a sub-folder for each batch of changes."""

    def __init__(self, spark, path: str, dims: list[str]):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        self._schema = None

    def apply(self, batch: int, before: DataFrame | None, after: DataFrame | None) -> None:
        delta = signed_parts(before, after, self.dims)
        self._schema = delta.schema
        # The delta has a row for each group at most; one file a batch keeps the store small.
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def folded(self) -> DataFrame:
        """The parts that are in force: all batches summed, groups without rows left out."""
        names = list(M.values())
        stored = self.spark.read.option("basePath", self.path).parquet(self.path)
        total = stored.groupBy(*self.dims).agg(*[F.sum(n).alias(n) for n in [*names, *(n + KNOWN for n in names)]])
        return total.filter(F.col("payment_count") > 0).select(
            *self.dims, *[F.when(F.col(n + KNOWN) != 0, F.col(n)).alias(n) for n in names])

    def compact(self, path: str) -> PartStore:
        """A new store at ``path`` with everything up to now as its batch 0; this one stays as it is for its readers."""
        names = list(M.values())
        stored = self.spark.read.option("basePath", self.path).parquet(self.path)
        stored.groupBy(*self.dims).agg(*[F.sum(n).cast(stored.schema[n].dataType).alias(n) for n in [*names, *(n + KNOWN for n in names)]]).coalesce(
            1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch=0")
        return PartStore(self.spark, path, self.dims)

    def measures(self, dims: list[str]) -> DataFrame:
        """All measures by a subset of the dimensions, from the stored parts alone."""
        return M.finish(M.coarser(self.folded(), dims), dims)
