"""The two running jobs: take in events, and rebuild the board on a clock."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hopboard.functions.selecting import keep_where
from hopboard.operators.bounds import top_bounded
from hopboard.operators.ingest import CONSUMED, accepted, ingest, outcome_counters
from hopboard.operators.ranking import Ban, top_as_of
from hopboard.params import BoardParams
from hopboard.sources.storage import delete_tree, written_at
from hopboard.streaming.bucket_store import BucketStore
from hopboard.streaming.counter_store import CounterStore
from hopboard.streaming.snapshot_store import SnapshotStore

logger = logging.getLogger(__name__)

RESTART_DELAY_SECONDS = 3.0

Sink = Callable[[DataFrame, str], None]
StoplistProvider = Callable[[], DataFrame | None]
Gauges = Callable[[dict[str, float]], None]


def start_ingest(
    messages: DataFrame,
    params: BoardParams,
    sink: Sink,
    checkpoint: str,
    arrival: Column | datetime | None = None,
    trigger: dict | None = None,
    value: str = "value",
    counters: CounterStore | None = None,
) -> StreamingQuery:
    """Classify a stream of messages and hand the accepted events of each batch to the sink.

    Events are judged by the time of their batch unless `arrival` says otherwise; Spark records
    that time with the batch, so a batch run again admits the same events. Refused messages are
    counted and passed over. The counters are in the query's progress, as `ingest_outcomes`.

    The sink gets the batch's accepted events and a name for the batch that stays the same when
    the batch is run again; `BucketStore.write` is one.

    The counters in the progress may count a stage twice that runs again. With a counter store they are
    also kept exactly, under the name of the batch: each batch is classified once into its different events with
    their numbers, written to the shared folder, and both the sink and the counters read these.
    """
    clock = F.current_timestamp() if arrival is None else arrival
    stamped = messages if isinstance(clock, datetime) else messages.withColumn("_arrival", clock)
    judged_by = clock if isinstance(clock, datetime) else F.col("_arrival")
    classified = ingest(stamped, params, judged_by, value).observe("ingest_outcomes", *outcome_counters())
    rows = accepted(classified) if counters is None else _with_outcome(classified)

    def take_in(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{query_id}-{batch_id}"
        if counters is None:
            sink(batch, name)
            return
        different = batch.groupBy(*batch.columns).agg(F.count(F.lit(1)).alias("events"))
        path, counted = written_at(different, f"counted-{name}")
        sink(counted.where(F.col("outcome") == CONSUMED).select("bucket_id", "query", "source"), name)
        counters.write(counted.groupBy("outcome").agg(F.sum("events").alias("events")), name)
        delete_tree(batch.sparkSession, path)

    writer = rows.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _with_outcome(classified: DataFrame) -> DataFrame:
    """Outcome, and what goes into the window of consumed events; refused ones of an outcome are all alike."""
    consumed = F.col("outcome") == CONSUMED
    columns = {"bucket_id": "bucket_id", "query": "norm_query", "source": "source"}
    return keep_where(classified, F.lit(True), "outcome", *[F.when(consumed, F.col(held)).alias(name) for name, held in columns.items()])


def rebuild(
    spark: SparkSession,
    params: BoardParams,
    buckets: BucketStore,
    boards: SnapshotStore,
    as_of: datetime,
    stoplist: StoplistProvider | None = None,
    ban: Ban | None = None,
    bounded: bool = False,
) -> None:
    """Build and publish the board of one instant. The stop-list is read anew, and only applied here.

    A `bounded` board from sketches is first cut by their stored estimates, so that few are opened. That takes a
    second job, and pays where very many queries have large sketches.
    """
    if bounded and params.counter == "exact":
        raise ValueError("exact counts have no bounds")
    live = buckets.read(spark, *params.live_range(as_of))
    ranked = top_bounded if bounded else top_as_of
    boards.publish(ranked(live, params, as_of, stoplist() if stoplist else None, ban), as_of)


def start_rebuilding(
    spark: SparkSession,
    params: BoardParams,
    buckets: BucketStore,
    boards: SnapshotStore,
    checkpoint: str,
    interval: str = "1 second",
    stoplist: StoplistProvider | None = None,
    ban: Ban | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    keep_boards: int = 100,
    spare_buckets: int | None = None,
    on_gauges: Gauges | None = None,
    bounded: bool = False,
) -> StreamingQuery:
    """Rebuild the board again and again, whether or not events come in.

    Buckets are deleted once they are as far behind the window as `spare_buckets` says, which
    defaults to the length of the window, so that none is deleted that a batch still writes to.
    Boards are deleted but for the newest `keep_boards`; a reader of an older one would fail.
    `on_gauges` is called after every tick with the size of the board and of the stop-list and the
    seconds that the rebuild took. `bounded` is for `rebuild`.
    """
    spare = params.bucket_count if spare_buckets is None else spare_buckets

    def on_tick(_: DataFrame, __: int) -> None:
        as_of, started = clock(), time.monotonic()
        oldest, current = params.live_range(as_of)
        rebuild(spark, params, buckets, boards, as_of, stoplist, ban, bounded)
        seconds = time.monotonic() - started
        if on_gauges:
            words = stoplist() if stoplist else None
            on_gauges({
                "snapshot_size": boards.latest(spark, as_of).select(F.size("items")).first()[0],
                "stoplist_words": 0 if words is None else words.count(),
                "rebuild_seconds": seconds,
            })
        buckets.drop_before(spark, oldest - spare)
        boards.keep_newest(spark, keep_boards)

    return _every(spark, interval, on_tick, checkpoint)


def start_compacting(
    spark: SparkSession,
    params: BoardParams,
    buckets: BucketStore,
    checkpoint: str,
    interval: str = "1 minute",
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    grace_seconds: float = 600.0,
) -> StreamingQuery:
    """Fold the batches of all buckets of the window again and again, beside the rebuilding job and not within it.

    The current bucket is folded by levels, those before it into one batch each. The grace period must be longer
    than a rebuild takes. One such job at a time.
    """

    def on_tick(_: DataFrame, __: int) -> None:
        oldest, current = params.live_range(clock())
        buckets.compact(spark, oldest, current, grace_seconds, open_from=current)

    return _every(spark, interval, on_tick, checkpoint)


def _every(spark: SparkSession, interval: str, on_tick: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A query that does something on a clock, whether or not events come in."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()


def keep_running(
    start: Callable[[], StreamingQuery],
    stopped: threading.Event,
    delay_seconds: float = RESTART_DELAY_SECONDS,
) -> int:
    """Run a job until it ends by itself or `stopped` is set; restart it after a failure.

    A restart goes on from the checkpoint. Returns the number of restarts.
    """
    restarts = 0
    while not stopped.is_set():
        query = start()
        try:
            while not query.awaitTermination(1):
                if stopped.is_set():
                    query.stop()
            return restarts
        except StreamingQueryException as error:
            restarts += 1
            logger.warning("streaming job failed, restarting in %s s: %s", delay_seconds, error)
            stopped.wait(delay_seconds)
    return restarts
