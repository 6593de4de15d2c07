"""Every operator as a query over the supplied tables: (session, folder) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from threading import Event
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.functions.messages import decode_events, encode_event
from hopboard.functions.text import normalize_query
from hopboard.operators import bounds, canonical, counting, hopping, ingest, ranking, stoplist, upkeep
from hopboard.operators.pruning import before_window
from hopboard.operators.sketch_replay import sketch_levels
from hopboard.params import parse_top_limit
from hopboard.plans.sample import (
    AS_OF,
    EVENTS_SCHEMA,
    PARAMS,
    messages,
    millis_of,
    odd_messages,
    query_names,
    read_table,
    search_events,
    stopword_changes,
    stored_stopwords,
    window_rows,
)
from hopboard.sources import generator
from hopboard.sources.files import stream_messages
from hopboard.sources.generator import FLOOD_QUERY, FLOOD_SOURCE, MIX_QUERIES
from hopboard.sources.message_log import append_messages, committed_offsets, read_log
from hopboard.sources.storage import shared_folder
from hopboard.streaming.bucket_store import BucketStore
from hopboard.streaming.counter_store import CounterStore
from hopboard.streaming.jobs import Sink, keep_running, rebuild, start_ingest
from hopboard.streaming.snapshot_store import SnapshotStore
from hopboard.streaming.stateful_window import board_of, start_windowed
from hopboard.streaming.stoplist_store import StoplistStore

Query = Callable[[SparkSession, str], DataFrame]

# The last one lies beyond the year 2262, where nanoseconds no longer fit a long.
ARRIVAL_LAG_HOURS = [0, 1, 12, 240, -12, 2_500_000]
SKETCH_PARAMS = replace(PARAMS, counter="hll")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(_events(spark, sf_dir))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(_messages(spark, sf_dir), PARAMS, AS_OF)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all valid events, whatever their age."""
    return ingest.valid_events(search_events(_events(spark, sf_dir)).where("well_formed"), PARAMS)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("id", millis_of(F.col("ts")).alias("arrival_ms"), "value")


def decode_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_events(_messages(spark, sf_dir))
    reason = F.coalesce(ingest.reject_reason(F.col("well_formed")), F.lit("valid"))
    return decoded.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def decode_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_events(odd_messages(_events(spark, sf_dir)))
    reason = ingest.reject_reason(F.col("well_formed"))
    return decoded.select("id", "query", "source", "ts_ms", "event_id", reason.alias("reason"))


def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text"
    )
    turns = read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    typed = search_events(_events(spark, sf_dir)).select(
        F.lit("events").alias("origin"), "id", F.lit(0).cast("bigint").alias("part"), F.col("query").alias("text")
    )
    texts = documents.unionByName(turns).unionByName(typed)
    normalized = normalize_query(F.col("text"))
    return texts.select("origin", "id", "part", normalized.alias("query"), normalized.isNotNull().alias("kept"))


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outcome_counts(_ingested(spark, sf_dir))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.quarantined(_ingested(spark, sf_dir)).select("id", "value", "outcome", "reject_reason")


def late_future_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = F.array(*[F.lit(hours) for hours in ARRIVAL_LAG_HOURS])
    lag = F.get(lags, (F.col("id") % len(ARRIVAL_LAG_HOURS)).cast("int"))
    arriving = _messages(spark, sf_dir).select(
        "value",
        lag.alias("lag_hours"),
        F.timestamp_millis(millis_of(F.col("ts")) + lag.cast("bigint") * 3_600_000).alias("arrival_ts"),
    )
    classified = ingest.ingest(arriving, PARAMS, F.col("arrival_ts"))
    return classified.groupBy("lag_hours", "outcome").agg(F.count(F.lit(1)).alias("rows"))


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.bucket_counts(_history(spark, sf_dir))


def _beside_exact(exact: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counts, and whether the estimates are within three percent of them."""
    close = F.abs(F.col("estimate") - F.col("count")) <= F.greatest(F.lit(0.5), F.col("count") * 0.03)
    both = exact.join(estimates.withColumnRenamed("count", "estimate"), keys, "full_outer")
    return both.select(*keys, "count", F.coalesce(close, F.lit(False)).alias("within_tolerance"))


def bucket_counts_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = counting.bucket_estimates(counting.bucket_sketches(_history(spark, sf_dir), SKETCH_PARAMS))
    return _beside_exact(bucket_counts(spark, sf_dir), estimates, ["bucket_id", "query"])


def top_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_as_of(window_rows(spark, sf_dir), PARAMS, AS_OF)


def top_from_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_as_of(ingest.accepted(_ingested(spark, sf_dir)), PARAMS, AS_OF)


def top_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of the whole board from merged bucket sketches, beside the exact counts."""
    rows = window_rows(spark, sf_dir)
    everything = replace(SKETCH_PARAMS, top_k=2**31 - 1)
    board = ranking.top_as_of(counting.bucket_sketches(rows, SKETCH_PARAMS), everything, AS_OF)
    return _beside_exact(counting.query_counts(rows), board.drop("rank"), ["query"])


def top_approx_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_rows(spark, sf_dir)
    return _beside_exact(counting.query_counts(rows), counting.query_estimates(rows, SKETCH_PARAMS), ["query"])


def sketch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    exact = counting.query_counts(rows)
    merged = counting.query_counts(counting.bucket_sketches(rows, SKETCH_PARAMS))
    return _beside_exact(exact, merged, ["query"])


def top_stoplist(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stoplist.active_words(stored_stopwords(_events(spark, sf_dir)))
    return ranking.top_as_of(window_rows(spark, sf_dir), PARAMS, AS_OF, words)


def top_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.prefix(top_exact(spark, sf_dir), parse_top_limit("5"))


def top_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = ranking.as_snapshot(top_exact(spark, sf_dir), PARAMS, AS_OF)
    return ranking.as_document(snapshot, parse_top_limit(""))


def hopping_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hopping.top_per_tick(_history(spark, sf_dir), replace(PARAMS, top_k=5))


def hopping_top_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of every query at every tick from united sketches, beside the exact counts."""
    rows = _history(spark, sf_dir)
    exact = hopping.each_tick(hopping.levels_of(rows, PARAMS))
    return _beside_exact(exact, hopping.each_tick(sketch_levels(rows, SKETCH_PARAMS)), ["tick", "query"])


def top_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board from a store of sketches, of which only those of contenders are opened.

    The folder stays, since the result reads it.
    """
    buckets = BucketStore(f"{shared_folder(spark)}/top_bounded-{uuid4()}", SKETCH_PARAMS)
    buckets.write(window_rows(spark, sf_dir), "all")
    return bounds.top_bounded(buckets.read(spark, *PARAMS.live_range(AS_OF)), SKETCH_PARAMS, AS_OF)


def top_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board from sketches, with what their error leaves open, and whether it holds for the exact counts."""
    rows = window_rows(spark, sf_dir)
    estimates = counting.query_counts(counting.bucket_sketches(rows, SKETCH_PARAMS))
    exact = counting.query_counts(rows).withColumnRenamed("count", "exact")
    enclosed = F.col("exact").between(F.col("low"), F.col("high"))
    certain = bounds.with_certainty(estimates, SKETCH_PARAMS).join(exact, "query")
    return certain.select("rank", "query", "count", "low", "high", "in_top", "at_rank", enclosed.alias("enclosed"))


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that each query of a table of names stands under in the end."""
    return canonical.resolved_names(canonical.normalized_names(query_names(_history(spark, sf_dir))))


def top_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board with queries counted under their canonical names."""
    rows = counting.bucket_sources(window_rows(spark, sf_dir))
    return ranking.top_as_of(canonical.canonical_rows(rows, canonical_names(spark, sf_dir)), PARAMS, AS_OF)


def expired_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = before_window(_events(spark, sf_dir), PARAMS, AS_OF)
    rows = ingest.valid_events(search_events(old).where("well_formed"), PARAMS)
    return upkeep.expired_buckets(rows, PARAMS, AS_OF)


def stoplist_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stoplist.active_words(stored_stopwords(_events(spark, sf_dir)))


def stoplist_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stoplist.sorted_words(stored_stopwords(_events(spark, sf_dir)))


def _new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to add or delete: the texts of all events of high weight."""
    return search_events(_events(spark, sf_dir)).where(F.col("weight") >= 20).select(F.col("query").alias("word"))


def stoplist_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    created_at = F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")
    merged = stoplist.merged_words(stored_stopwords(_events(spark, sf_dir)), _new_words(spark, sf_dir), created_at)
    return merged.select("word", "status")


def stoplist_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored_stopwords(_events(spark, sf_dir))
    return stoplist.delete_words(table, _new_words(spark, sf_dir)).select("word")


def stoplist_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    log = stoplist.normalized_changes(stopword_changes(events))
    statuses = stoplist.change_statuses(stored_stopwords(events), log)
    return statuses.select("seq", "op", "word", "norm_word", "status", "echo")


def stoplist_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    log = stoplist.normalized_changes(stopword_changes(events))
    final = stoplist.changed_table(stored_stopwords(events), log)
    return final.select("word", millis_of(F.col("created_at")).alias("created_ms"))


def stoplist_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list after a change log, by way of the store: written, changed and read back.

    The folder stays, since the result reads it; the shared folder is cleared by whoever owns it.
    """
    store = StoplistStore(spark, f"{shared_folder(spark)}/stoplist-{uuid4()}")
    events = _events(spark, sf_dir)
    store.replace(stored_stopwords(events))
    store.apply(stopword_changes(events))
    return store.list()


def pipeline_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.gauges(top_exact(spark, sf_dir), stoplist_clean(spark, sf_dir))


def bot_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    organic = _messages(spark, sf_dir)
    bot = search_events(_events(spark, sf_dir)).select(
        F.lit(FLOOD_QUERY).alias("query"), F.lit(FLOOD_SOURCE).alias("source"),
        millis_of(F.col("ts")).alias("ts_ms"), "event_id",
    ).select(encode_event().alias("value"))
    flooded = ingest.ingest(organic.select("value").unionByName(bot), PARAMS, AS_OF)
    return ranking.top_as_of(ingest.accepted(flooded), replace(PARAMS, top_k=1000), AS_OF)


def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivered = _messages(spark, sf_dir).select("value")
    again = delivered.select(F.regexp_replace("value", '"event_id":"', '"event_id":"again-').alias("value"))
    rows = ingest.accepted(ingest.ingest(delivered.unionByName(again), PARAMS, AS_OF))
    return ranking.top_as_of(rows, PARAMS, AS_OF)


def event_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = search_events(_events(spark, sf_dir)).where(ingest.reject_reason().isNull())
    return decode_events(events.select(encode_event().alias("value"))).select(
        "query", "source", "ts_ms", "event_id", "well_formed"
    )


def stream_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board by way of the running jobs: stream in, store buckets, compact, rebuild, publish, read.

    The folder stays, since the result reads the board in it.
    """
    folder = f"{shared_folder(spark)}/stream_top-{uuid4()}"
    table = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    buckets = BucketStore(f"{folder}/buckets", PARAMS)
    boards = SnapshotStore(f"{folder}/boards", PARAMS)
    query = start_ingest(
        messages(table).select("value"), PARAMS, buckets.write, f"{folder}/checkpoint", AS_OF, {"availableNow": True}
    )
    query.awaitTermination()
    buckets.compact(spark, *PARAMS.live_range(AS_OF), grace_seconds=0)
    rebuild(spark, PARAMS, buckets, boards, AS_OF)
    return boards.top(spark, "20", AS_OF).select("rank", "query", "count")


def _deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All messages in two deliveries, cut in the middle of the window."""
    delivered = _messages(spark, sf_dir)
    middle = F.expr("TIMESTAMP_NTZ'2024-01-17 00:00:00'")
    return [delivered.where(F.col("ts") < middle), delivered.where(F.col("ts") >= middle)]


def _failing_once(sink: Sink) -> Sink:
    """A sink that fails after its first batch is stored, so that the batch is delivered again."""
    failed = []

    def store(batch: DataFrame, name: str) -> None:
        sink(batch, name)
        if not failed:
            failed.append(name)
            raise RuntimeError("failed after the batch was stored")

    return store


def stateful_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board from the state of a stream that is stopped in the middle and started again.

    The folder stays, since the result reads the state in it.
    """
    folder = f"{shared_folder(spark)}/stateful_top-{uuid4()}"
    for delivery in _deliveries(spark, sf_dir):
        delivery.select("value").write.mode("append").text(f"{folder}/messages")
        stream = stream_messages(spark, f"{folder}/messages")
        start_windowed(stream, PARAMS, f"{folder}/checkpoint", AS_OF, {"availableNow": True}).awaitTermination()
    return board_of(spark, PARAMS, f"{folder}/checkpoint", AS_OF)


def scripted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board from a log with offsets, by a job that fails and starts again, and how many messages it has committed.

    The folder stays, since the result reads the buckets in it.
    """
    folder = f"{shared_folder(spark)}/scripted_source-{uuid4()}"
    buckets = BucketStore(f"{folder}/buckets", PARAMS)
    sink = _failing_once(buckets.write)
    log, checkpoint = f"{folder}/log", f"{folder}/checkpoint"
    for delivery in _deliveries(spark, sf_dir):
        append_messages(delivery, log, "id", 4)
        start = lambda: start_ingest(read_log(spark, log), PARAMS, sink, checkpoint, AS_OF, {"availableNow": True})
        keep_running(start, Event(), delay_seconds=0)
    committed = sum(committed_offsets(spark, checkpoint).values())
    board = ranking.top_as_of(buckets.read(spark, *PARAMS.live_range(AS_OF)), PARAMS, AS_OF)
    return board.select("rank", "query", "count", F.lit(committed).cast("bigint").alias("committed"))


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a job whose first batch is delivered twice, with the sums that must hold among them.

    The folder stays, since the result reads the counters in it.
    """
    folder = f"{shared_folder(spark)}/stream_counters-{uuid4()}"
    counters = CounterStore(f"{folder}/counters")
    sink = _failing_once(BucketStore(f"{folder}/buckets", PARAMS).write)
    for delivery in _deliveries(spark, sf_dir):
        delivery.select("value").write.mode("append").text(f"{folder}/messages")
        start = lambda: start_ingest(
            stream_messages(spark, f"{folder}/messages"), PARAMS, sink, f"{folder}/checkpoint", AS_OF, {"availableNow": True}, counters=counters
        )
        keep_running(start, Event(), delay_seconds=0)
    counters.fold(spark)
    return counters.counters(spark).withColumns({
        "decoded_adds_up": F.col("decoded") == F.col("consumed") + F.col("norm_dropped") + F.col("out_of_window"),
        "messages_add_up": F.col("messages") == F.col("decoded") + F.col("invalid"),
    })


def generated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated events as the table has, and users, from streams started three times over.

    One query from all users in turn, and a flood by one source with a fifth as much ordinary traffic. The folder
    stays, since the result reads the events in it.
    """
    folder = f"{shared_folder(spark)}/generated_events-{uuid4()}"
    size = _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).first()
    modes = {
        "fixed": (size["n"], lambda numbers: generator.fixed_events(numbers, MIX_QUERIES[0], max(1, size["users"]), AS_OF)),
        "flood": (size["n"] + size["n"] // 5, lambda numbers: generator.flood_events(numbers, AS_OF, size["n"])),
    }
    events = []
    for mode, (n, made) in modes.items():
        for _ in range(3):
            numbers = generator.numbers_stream(spark, -(-n // 3), 4).where(F.col("id") < n)
            writer = made(numbers).writeStream.format("parquet").option("checkpointLocation", f"{folder}/{mode}-checkpoint")
            writer.trigger(availableNow=True).start(f"{folder}/{mode}").awaitTermination()
        events.append(spark.read.parquet(f"{folder}/{mode}").withColumn("mode", F.lit(mode)))
    kind = F.when(F.col("query").isin(FLOOD_QUERY, MIX_QUERIES[0]) & ((F.col("mode") == "fixed") | (F.col("source") == FLOOD_SOURCE)), F.col("query"))
    return (
        events[0].unionByName(events[1]).groupBy("mode", F.coalesce(kind, F.lit("ordinary")).alias("query"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources"))
        .withColumn("sources", F.when(F.col("query") != "ordinary", F.col("sources")))
    )


QUERIES: dict[str, Query] = {
    "raw_events": raw_events,
    "decode_outcomes": decode_outcomes,
    "decode_strictness": decode_strictness,
    "normalize_query": normalize_texts,
    "ingest_outcomes": ingest_outcomes,
    "quarantine": quarantine,
    "late_future_outcomes": late_future_outcomes,
    "bucket_counts": bucket_counts,
    "bucket_counts_approx": bucket_counts_approx,
    "top_exact": top_exact,
    "top_from_messages": top_from_messages,
    "top_approx": top_approx,
    "top_approx_direct": top_approx_direct,
    "sketch_accuracy": sketch_accuracy,
    "top_stoplist": top_stoplist,
    "top_prefix": top_prefix,
    "top_json": top_json,
    "hopping_top": hopping_top,
    "hopping_top_approx": hopping_top_approx,
    "top_bounded": top_bounded,
    "top_certain": top_certain,
    "canonical_names": canonical_names,
    "top_canonical": top_canonical,
    "expired_buckets": expired_buckets,
    "stoplist_clean": stoplist_clean,
    "stoplist_list": stoplist_list,
    "stoplist_insert": stoplist_insert,
    "stoplist_delete": stoplist_delete,
    "stoplist_apply": stoplist_apply,
    "stoplist_final": stoplist_final,
    "stoplist_stored": stoplist_stored,
    "pipeline_gauges": pipeline_gauges,
    "bot_flood": bot_flood,
    "replay_idempotent": replay_idempotent,
    "event_roundtrip": event_roundtrip,
    "stream_top": stream_top,
    "stateful_top": stateful_top,
    "scripted_source": scripted_source,
    "stream_counters": stream_counters,
    "generated_events": generated_events,
}
