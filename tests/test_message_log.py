"""A log with offsets as a source, counters that no retry counts twice, and generated events as a stream."""

import json
import threading
from datetime import datetime, timedelta, timezone

import pyarrow.dataset as ds
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hopboard.operators.ranking import top_as_of
from hopboard.params import BoardParams
from hopboard.sources import generator
from hopboard.sources.message_log import MessageLogReader, append_messages, committed_offsets, read_log
from hopboard.streaming.bucket_store import BucketStore
from hopboard.streaming.counter_store import CounterStore
from hopboard.streaming.jobs import keep_running, start_ingest

NOW = datetime.fromtimestamp(1_700_000_040, timezone.utc)
PARAMS = BoardParams.of(timedelta(seconds=30), 3, 5, counter="exact")


def event(query, source, millis=None):
    return json.dumps({"query": query, "source": source, "ts_ms": millis or int(NOW.timestamp() * 1000)})


def messages(spark, first, values):
    return spark.createDataFrame([(first + i, value) for i, value in enumerate(values)], "seq long, value string")


def taken_in(spark, folder):
    """All messages that a stream from the start delivers, with partitions and offsets."""
    query = read_log(spark, f"{folder}/log", 7).writeStream.format("memory").queryName("taken").outputMode("append")
    query.option("checkpointLocation", f"{folder}/plain").trigger(availableNow=True).start().awaitTermination()
    return [tuple(row) for row in spark.table("taken").collect()]


def test_offsets_are_dense_and_read_back(spark, tmp_path):
    values = [f"m{i}" for i in range(50)] + [None, "", "zwei\nZeilen", "{bad"]
    log = str(tmp_path / "log")
    assert sum(append_messages(messages(spark, 0, values[:30]), log, "seq", 3).values()) == 30
    ends = append_messages(messages(spark, 30, values[30:]), log, "seq", 99)
    assert set(ends) == {"0", "1", "2"} and sum(ends.values()) == len(values)
    append_messages(messages(spark, 0, []), log, "seq", 3)
    got = taken_in(spark, tmp_path)
    assert sorted(str(value) for value, _, _ in got) == sorted(map(str, values))
    for p, end in ends.items():
        assert sorted(offset for _, partition, offset in got if partition == int(p)) == list(range(end))
    # Within a partition messages keep their order.
    numbers = {value: i for i, value in enumerate(values)}
    for p in range(3):
        order = [numbers[value] for value, _, offset in sorted((row for row in got if row[1] == p), key=lambda row: row[2])]
        assert order == sorted(order)


def test_ranges_give_the_same_messages_again_and_others_are_not_read(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    for first in (0, 20):
        append_messages(messages(spark, first, [f"m{i}" for i in range(first, first + 20)]), log, "seq", 1)
    reader = MessageLogReader(log, 8)
    assert reader.initialOffset() == {} and reader.latestOffset() == {"0": 40}
    parts = reader.partitions({"0": 5}, {"0": 30})
    assert [(part.start, part.stop) for part in parts] == [(5, 13), (13, 21), (21, 29), (29, 30)]
    assert reader.partitions({"0": 40}, {"0": 40}) == []
    read = lambda part: [row for batch in reader.read(part) for row in batch.to_pylist()]
    assert [row["value"] for part in parts for row in read(part)] == [f"m{i}" for i in range(5, 30)]
    assert read(parts[1]) == read(parts[1])
    opened = []
    dataset = ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda path, **kwargs: opened.append(path) or dataset(path, **kwargs))
    read(parts[0])
    assert len(opened) == 1 and "segment=000000" in opened[0]


def test_unfinished_segment_is_not_seen(spark, tmp_path):
    log = tmp_path / "log"
    append_messages(messages(spark, 0, ["a"]), str(log), "seq", 1)
    append_messages(messages(spark, 1, ["b"]), str(log), "seq", 1)
    (log / "segment=000001/_ends.json").unlink()
    assert MessageLogReader(str(log), 9).latestOffset() == {"0": 1}
    assert append_messages(messages(spark, 1, ["c"]), str(log), "seq", 1) == {"0": 2}
    assert {value for value, _, _ in taken_in(spark, tmp_path)} == {"a", "c"}
    assert MessageLogReader(str(tmp_path / "none"), 9).latestOffset() == {}


@pytest.mark.parametrize("before_store", [True, False])
def test_failed_batches_come_again_and_bad_messages_are_committed(spark, tmp_path, before_store):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    buckets, counters = BucketStore(str(tmp_path / "buckets"), PARAMS), CounterStore(str(tmp_path / "counters"))
    fail, delivered = [True], []

    def sink(batch, name):
        delivered.append(name)
        if not (fail[0] and before_store):
            buckets.write(batch, name)
        if fail[0]:
            fail[0] = False
            raise RuntimeError("lost")

    start = lambda: start_ingest(read_log(spark, log), PARAMS, sink, checkpoint, NOW, {"availableNow": True}, counters=counters)
    first = [event("a", f"u{i % 4}") for i in range(20)] + ["{bad", event(" ", "u"), event("late", "u", 1), event("", "u")]
    append_messages(messages(spark, 0, first), log, "seq", 2)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert committed_offsets(spark, checkpoint) == {}
    assert keep_running(start, threading.Event(), 0) == 0
    assert delivered[0] == delivered[1] and sum(committed_offsets(spark, checkpoint).values()) == len(first)

    fail[0] = True
    append_messages(messages(spark, 100, [event("b", "u"), "nonsense"]), log, "seq", 2)
    assert keep_running(start, threading.Event(), 0) == 1
    assert sum(committed_offsets(spark, checkpoint).values()) == len(first) + 2
    assert keep_running(start, threading.Event(), 0) == 0

    board = top_as_of(buckets.read(spark, *PARAMS.live_range(NOW)), PARAMS, NOW).orderBy("rank").collect()
    assert [(row["query"], row["count"]) for row in board] == [("a", 4), ("b", 1)]
    for _ in range(2):
        row = counters.counters(spark).first().asDict()
        assert row == {"messages": 26, "consumed": 21, "decoded": 23, "invalid": 3, "norm_dropped": 1, "out_of_window": 1}
        counters.fold(spark)
    assert list(tmp_path.glob("counted-*")) == []


def outcomes(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "outcome string, events long")


def test_counters_of_a_batch_replace_each_other_and_fold(spark, tmp_path):
    store = CounterStore(str(tmp_path))
    assert store.counters(spark).first().asDict()["messages"] == 0
    for batch in range(5):
        store.write(outcomes(spark, consumed=10 + batch, invalid=1), f"q-x-{batch}")
    store.write(outcomes(spark, consumed=14, invalid=1), "q-x-4")
    store.write(outcomes(spark, consumed=100), "other-0")
    total = store.counters(spark).first()
    assert (total["consumed"], total["invalid"], total["messages"]) == (160, 5, 165)
    assert store.fold(spark) == 4
    assert store.counters(spark).first() == total
    # The last batch may come again after folding, and folding goes on from the total.
    store.write(outcomes(spark, consumed=14, invalid=1), "q-x-4")
    store.write(outcomes(spark, consumed=1), "q-x-5")
    assert store.counters(spark).first()["consumed"] == 161
    assert store.fold(spark) == 2 and store.counters(spark).first()["consumed"] == 161
    assert store.fold(spark) == 0


def test_total_counts_before_what_it_folds_is_deleted(spark, tmp_path):
    store = CounterStore(str(tmp_path))
    for batch in range(3):
        store.write(outcomes(spark, consumed=1), f"q-{batch}")
    store._write(outcomes(spark, consumed=2), "q", "total", 1)
    assert store.counters(spark).first()["consumed"] == 3


def generated(spark, folder, starts, made, rows=50):
    for _ in range(starts):
        writer = made(generator.numbers_stream(spark, rows, 3)).writeStream.format("parquet")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_generated_stream_goes_on_and_equals_the_table(spark, tmp_path):
    mix = lambda numbers: generator.mix_events(numbers, NOW, 3)
    rows = generated(spark, tmp_path, 3, mix)
    want = generator.query_mix(spark, 150, NOW, 3)
    assert sorted(map(tuple, rows.drop("event_id").collect())) == sorted(map(tuple, want.drop("event_id").collect()))


def test_generated_batch_is_the_same_after_a_retry(spark, tmp_path):
    made = lambda numbers: generator.flood_events(numbers, NOW, 30)
    before = sorted(map(str, generated(spark, tmp_path, 1, made).collect()))
    assert len(before) == 50
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink(missing_ok=True)
    # The batch is in the offsets already, so it comes again as it was, here to a place of its own.
    writer = made(generator.numbers_stream(spark, 50, 3)).writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
    batches = []
    writer.foreachBatch(lambda batch, number: batches.append((number, sorted(map(str, batch.collect()))))).trigger(availableNow=True).start().awaitTermination()
    assert batches[0] == (0, before)


def test_flood_of_numbers(spark):
    rows = generator.flood_events(spark.range(130), NOW, 100)
    bot = rows.where(F.col("source") == generator.FLOOD_SOURCE)
    assert bot.count() == 100 and rows.count() == 130
    assert sorted(map(str, rows.collect())) == sorted(map(str, generator.bot_flood(spark, NOW, 100, 30).collect()))
