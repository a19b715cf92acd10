"""Streams over the decision change feed, the decision log and the flag files.

Each job writes one folder per micro-batch and overwrites that folder when a batch is repeated, so a
restart after a failure neither loses nor doubles rows. Readers fold the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.functions import rules as R
from paywarden.operators import changes
from paywarden.operators.desk import EXPOSURE, RECOVERY
from paywarden.operators.joins import fits_broadcast


#: What one micro-batch reads, unless a number of files is asked for; a batch writes one folder, so their number follows the input's size.
BATCH_BYTES = 16 << 30


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    limit = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", BATCH_BYTES)
    return reader.option(*limit).parquet(path)


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return write


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; a stream keeps those that it was started with."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_available(stream: DataFrame, mode: str, sink, checkpoint: str, conf: dict[str, str] | None = None) -> None:
    """Process everything that is there, in as many micro-batches as the source asks for, then stop."""
    with settings(stream.sparkSession, conf or {}):
        handle = (
            stream.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    handle.awaitTermination()


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(out)


def stream_latest(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Current decisions from the change feed, whatever order its files arrive in.

    State keeps the version with the highest ``_sort_by`` per entity, deletes included, so a late older
    change never brings a row back. Each batch appends the entities it changed.
    """
    newest = changes.newest_version(file_stream(spark, source, schema, files_per_trigger))
    flat = newest.select("id", "v.*")
    run_available(flat, "update", batch_sink(out), checkpoint)
    return changes.apply_latest(read_batches(spark, out, flat.schema).drop("batch"))


def stream_change_counts(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                         lateness: str, width: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """Changes per type and window; windows older than ``lateness`` behind the newest change are closed."""
    feed = file_stream(spark, source, schema, files_per_trigger).withColumn(
        "_timestamp", F.col("_timestamp").cast("timestamp")).withWatermark("_timestamp", lateness)
    counts = changes.change_counts(feed, width).select(F.col("w.start").alias("start"), "_pg_change_type", "n")
    run_available(counts, "update", batch_sink(out), checkpoint)
    return read_batches(spark, out, counts.schema).groupBy("start", "_pg_change_type").agg(
        F.max_by("n", "batch").alias("n"))


def stream_queue_kpis(spark: SparkSession, source: str, schema: T.StructType, queue: DataFrame, out: str,
                      checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Header figures kept current as decisions arrive.

    State remembers which payments have a decision. A batch only looks up the payments decided for the
    first time and writes what they take off the totals; the queue is scanned but not shuffled while the
    batch fits a broadcast.
    """
    def taken_off(decided: DataFrame) -> DataFrame:
        return queue.join(decided, "payment_id").agg(
            F.coalesce(F.sum(EXPOSURE), F.lit(0)).cast("decimal(28,2)").alias("exposure"),
            F.coalesce(F.sum(RECOVERY), F.lit(0)).cast("decimal(28,2)").alias("recovery"),
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("recommended_disposition") == R.REFER).alias("refer"))

    write = batch_sink(out)

    def sink(df: DataFrame, batch: int) -> None:
        df.persist()  # looked at twice: its size, then its rows
        try:
            write(taken_off(F.broadcast(df) if fits_broadcast(df) else df), batch)
        finally:
            df.unpersist()

    first = file_stream(spark, source, schema, files_per_trigger).select("payment_id").dropDuplicates(["payment_id"])
    run_available(first, "append", sink, checkpoint)
    deltas = read_batches(spark, out, T.StructType.fromDDL("exposure decimal(28,2), recovery decimal(28,2), n long, refer long"))
    off = deltas.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exposure", "recovery", "n", "refer")])
    off = off.agg(F.struct(*[F.first(c).alias(c) for c in off.columns])).scalar()
    return queue.agg(
        F.sum(EXPOSURE).alias("exposure"), F.sum(RECOVERY).alias("recovery"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("recommended_disposition") == R.REFER).alias("refer"),
    ).withColumn("off", off).select(
        (F.col("exposure") - F.col("off.exposure")).alias(EXPOSURE),
        (F.col("recovery") - F.col("off.recovery")).alias("projected_recovery_usd"),
        (F.col("n") - F.col("off.n")).alias("flagged_count"),
        (F.col("refer") - F.col("off.refer")).alias("refer_recommended_count"))


def stream_flag_pairs(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                      horizon: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Each (payment, signal) pair once, from flag files that repeat matches.

    Without a horizon the state keeps every pair, which is exact; with one, state older than the horizon
    behind the newest flag is released and a repeat after that counts again.
    """
    flags = file_stream(spark, source, schema, files_per_trigger)
    if horizon:
        once = flags.withWatermark("flagged_at", horizon).dropDuplicatesWithinWatermark(["payment_id", "signal"])
    else:
        once = flags.dropDuplicates(["payment_id", "signal"])
    pairs = once.select("payment_id", "signal")
    run_available(pairs, "append", batch_sink(out), checkpoint)
    return read_batches(spark, out, pairs.schema).drop("batch")
