"""Helpers of the package: written tables, size checks, and modules that travel with their functions."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.session import work_dir


def travels(module: str) -> None:
    """Send a module's functions to the executors by value, so that these need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)

#: Bytes of a batch that a worker has in hand at a time.
IN_HAND = 4 << 20


def in_hand(batches):
    """Each batch in slices of a few megabytes: what a worker makes of the texts beside them is as small, however many rows a batch has."""
    for batch in batches:
        rows = max(1, batch.num_rows * IN_HAND // max(batch.nbytes, IN_HAND))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: What limits the bytes of a batch of rows on its way to a worker.
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of a few megabytes (a longer row alone), unless it has a limit of its own.

    Spark's 64 MB are made by doubling, in memory beside the heap and in each task, and lie in the worker whole. Queries are run after
    they are returned, so the setting stays; it changes no result.
    """
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, str(IN_HAND))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once below the cluster's shared folder and read again; this cuts the lineage."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The frame marked for broadcast if it has at most ``rows`` rows, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from every training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
