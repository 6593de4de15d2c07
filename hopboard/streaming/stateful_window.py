"""The window kept in the state of the stream itself, with exact counts and eviction by timers.

Every source counts in the newest bucket it was seen in, which is enough: it is in the window of a clock at or after
that bucket if, and only if, that bucket is. State is keyed by query and part, a part being the sources of one hash
remainder, so that a popular query is spread over tasks and its counts add up. A key holds, for each bucket, the
sources whose newest bucket it is, and their number; a batch reads and writes only the key's own few buckets.

Before the shuffle each task removes repeats among its rows, so that a source that repeats a query is one row for each
task's batch of rows. A bucket's timer goes off when the clock, the arrival times seen so far, has left its
window behind by a spare bucket; it removes the bucket from state. Between two events the window slides on by itself,
since boards count the live buckets of the instant they are asked for.

State needs the RocksDB store, which is set on the session while the query starts. A query started again from its
checkpoint goes on with the state as of the last complete batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hopboard.functions.selecting import keep_where
from hopboard.operators.counting import live_rows
from hopboard.operators.ingest import CONSUMED, ingest
from hopboard.operators.ranking import Ban, rank_counts
from hopboard.params import NANOS_PER_MILLI, BoardParams
from hopboard.sources.storage import matching_paths

PARTS = 64
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowState(StatefulProcessor):
    """Sources of one query and part by the newest bucket each was seen in."""

    def __init__(self, bucket_count: int, width_nanos: int) -> None:
        self.bucket_count = bucket_count
        self.width_nanos = width_nanos

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "bucket_id bigint", "sources array<string>")
        self.counts = handle.getMapState("counts", "bucket_id bigint", "sources bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[str, int] = {}
        for row in rows:
            newest[row["source"]] = max(row["bucket_id"], newest.get(row["source"], row["bucket_id"]))
        held = {bucket: set(sources) for bucket, sources in self._members()}
        known = {source: bucket for bucket, sources in held.items() for source in sources}
        before = {bucket: len(sources) for bucket, sources in held.items()}
        changed: set[int] = set()
        for source, bucket in newest.items():
            earlier = known.get(source)
            if earlier is not None and earlier >= bucket:
                continue
            if earlier is not None:
                held[earlier].discard(source)
                changed.add(earlier)
            held.setdefault(bucket, set()).add(source)
            changed.add(bucket)
        for bucket in sorted(changed):
            if held[bucket]:
                self.members.updateValue((bucket,), (sorted(held[bucket]),))
                self.counts.updateValue((bucket,), (len(held[bucket]),))
            else:
                self._forget(bucket)
            if bucket not in before:
                self.handle.registerTimer(self.expiry_millis(bucket))
            yield Row(query=key[0], part=key[1], bucket_id=bucket, sources=len(held[bucket]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        for bucket in [bucket for bucket, _ in self._members()]:
            if self.expiry_millis(bucket) <= expired:
                self._forget(bucket)
                yield Row(query=key[0], part=key[1], bucket_id=bucket, sources=0)

    def close(self) -> None:
        pass

    def expiry_millis(self, bucket: int) -> int:
        """First millisecond of the clock at which the bucket is in no window any more."""
        return -(-(bucket + self.bucket_count) * self.width_nanos // NANOS_PER_MILLI)

    def _members(self) -> Iterator[tuple[int, list[str]]]:
        """Buckets with their sources; both come as rows of one value."""
        for (bucket,), (sources,) in self.members.iterator():
            yield bucket, sources

    def _forget(self, bucket: int) -> None:
        self.members.removeKey((bucket,))
        self.counts.removeKey((bucket,))


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each batch once; only the latest arrival is kept, which moves the clock as all would."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["bucket_id", "query", "source"]).aggregate([("arrival", "max")])
        table = table.rename_columns([name.removesuffix("_max") for name in table.column_names])
        yield from table.select(batch.schema.names).cast(batch.schema).to_batches()


def windowed_state(
    messages: DataFrame, params: BoardParams, arrival: Column | datetime | None = None, value: str = "value", parts: int = PARTS
) -> DataFrame:
    """Stream of the changes of state (query, part, bucket_id, sources) that a stream of messages causes."""
    clock = F.lit(arrival) if isinstance(arrival, datetime) else F.current_timestamp() if arrival is None else arrival
    stamped = messages.withColumn("_arrival", clock)
    judged = ingest(stamped, params, arrival if isinstance(arrival, datetime) else F.col("_arrival"), value)
    rows = keep_where(
        judged, F.col("outcome") == CONSUMED, "bucket_id", F.col("norm_query").alias("query"), "source", F.col("_arrival").alias("arrival")
    )
    distinct = rows.mapInArrow(_without_repeats, rows.schema)
    # Arrival never goes back, but a row at the clock itself must not count as late.
    spare = f"{max(1, params.width_nanos // 1000)} microseconds"
    part = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    return (
        distinct.withColumn("part", part)
        .withWatermark("arrival", spare)
        .groupBy("query", "part")
        .transformWithState(
            WindowState(params.bucket_count, params.width_nanos), "query string, part int, bucket_id bigint, sources bigint", "Update", "EventTime"
        )
    )


def start_windowed(
    messages: DataFrame,
    params: BoardParams,
    checkpoint: str,
    arrival: Column | datetime | None = None,
    trigger: dict | None = None,
    value: str = "value",
    parts: int = PARTS,
) -> StreamingQuery:
    """Keep the window of a stream of messages in its checkpoint, for `board_of` to read."""
    conf = messages.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKS)
    try:
        writer = windowed_state(messages, params, arrival, value, parts).writeStream.format("noop").outputMode("update")
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        if before is None:
            conf.unset(_STORE)
        else:
            conf.set(_STORE, before)


def state_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sources of each query, part and bucket (query, part, bucket_id, sources) as of the last complete batch."""
    if not matching_paths(spark, f"{checkpoint}/commits/[0-9]*"):
        return spark.createDataFrame([], "query string, part int, bucket_id bigint, sources bigint")
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counts").load()
    return state.select("key.query", "key.part", "user_map_key.bucket_id", "user_map_value.sources")


def board_of(
    spark: SparkSession, params: BoardParams, checkpoint: str, as_of: datetime, stoplist: DataFrame | None = None, ban: Ban | None = None
) -> DataFrame:
    """The board at an instant not before the newest event, from the state of the stream."""
    live = live_rows(state_counts(spark, checkpoint), *params.live_range(as_of))
    return rank_counts(live.groupBy("query").agg(F.sum("sources").alias("count")), params, stoplist, ban)
