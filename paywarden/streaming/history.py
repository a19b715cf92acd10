"""Validity intervals kept up to date by a stream of changes that come in any order.

The state of an entity is the list of its versions, sorted. A batch puts its versions in their places and sends out every interval that this
changes: the new ones and those before them, whose end has moved. Sent rows are known by entity and ``_sort_by``, so that readers take
the newest sending of each. Versions that the watermark has passed can't get a neighbour any more; a timer removes them from the state,
all but the last, which still waits for its end. The state of an entity is thus bounded by its changes within the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paywarden.operators import changes
from paywarden.operators.ranking import distributed_rank
from paywarden.streaming.feeds import batch_sink, file_stream, read_batches, run_available

#: Instants are microseconds, which no time zone changes on the way to a worker and back.
VERSION = "_sort_by long, at long, status string, action_type string, kind string"
INTERVAL = f"id long, {VERSION}, valid_to long"
#: Lists and timers of one key lie in a store with column families, which the session's own store need not be; Spark's default has none.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Intervals(StatefulProcessor):
    """Versions of one entity; repeated changes count once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.versions = handle, handle.getListState("versions", VERSION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(v) for v in self.versions.get()]
        known = {v[0] for v in held}
        fresh = {r._sort_by: (r._sort_by, r.at, r.status, r.action_type, r._pg_change_type) for r in rows}
        fresh = [v for s, v in fresh.items() if s not in known]
        if not fresh:
            return
        new = {v[0] for v in fresh}
        held = sorted(held + fresh)
        self.versions.put(held)
        self.handle.registerTimer(max(v[1] for v in held) // 1000 + 1)
        for here, after in zip(held, [*held[1:], None]):
            if here[0] in new or (after is not None and after[0] in new):
                yield Row(id=key[0], _sort_by=here[0], at=here[1], status=here[2], action_type=here[3], kind=here[4], valid_to=after and after[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(v) for v in self.versions.get()]
        self.versions.put([v for v, after in zip(held, [*held[1:], None]) if after is None or after[1] >= passed])
        return iter(())

    def close(self) -> None:
        pass


def stream_history(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, lateness: str,
                   files_per_trigger: int | None = None) -> DataFrame:
    """The validity interval of every version, as ``changes.history`` gives for the whole feed."""
    feed = file_stream(spark, source, schema, files_per_trigger).filter(F.col("_pg_change_type") != changes.PRE).withColumn(
        "_timestamp", F.col("_timestamp").cast("timestamp")).withWatermark("_timestamp", lateness)
    sent = feed.select("id", "_sort_by", "_timestamp", F.unix_micros("_timestamp").alias("at"), "status", "action_type", "_pg_change_type").groupBy("id").transformWithState(
        Intervals(), INTERVAL, "Update", "EventTime")
    run_available(sent, "update", batch_sink(out), checkpoint, STORE)
    rows = read_batches(spark, out, sent.schema).groupBy("id", "_sort_by").agg(
        F.max_by(F.struct("at", "status", "action_type", "kind", "valid_to"), "batch").alias("v")).select("id", "_sort_by", "v.*")
    ranked = distributed_rank(rows, ["id"], [F.asc("_sort_by")], "version")
    local = [F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("at", "valid_from"), ("valid_to", "valid_to"))]
    return ranked.filter(F.col("kind") != changes.DELETE).select(
        "id", "status", "action_type", *local, F.col("valid_to").isNull().alias("is_current"), "version")
