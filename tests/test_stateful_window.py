"""The window in the state of the stream, against boards from the same events in one batch."""

import json
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hopboard.operators.ingest import accepted, ingest
from hopboard.operators.ranking import top_as_of
from hopboard.params import BoardParams
from hopboard.sources.files import stream_messages
from hopboard.streaming.stateful_window import WindowState, board_of, start_windowed, state_counts

NOW = datetime.fromtimestamp(1_700_000_040, timezone.utc)
PARAMS = BoardParams.of(timedelta(seconds=30), 3, 5, counter="exact")


def arrival():
    return F.timestamp_millis(F.get_json_object("value", "$.at").cast("bigint"))


def message(query, source, seconds_ago=0, at=NOW):
    """An event so many seconds before its arrival."""
    millis = int(at.timestamp() * 1000)
    return json.dumps({"query": query, "source": source, "ts_ms": millis - 1000 * seconds_ago, "at": millis})


def run(spark, folder, lines, arrival=NOW, params=PARAMS, **kwargs):
    """One more file of messages, taken in by a query that starts from the checkpoint and ends."""
    number = len(list(folder.glob("in*.txt")))
    (folder / f"in{number}.txt").write_text("\n".join(lines) + "\n")
    stream = stream_messages(spark, str(folder / "in*.txt"))
    start_windowed(stream, params, str(folder / "checkpoint"), arrival, {"availableNow": True}, **kwargs).awaitTermination()


def board(spark, folder, as_of=NOW, params=PARAMS, **kwargs):
    rows = board_of(spark, params, str(folder / "checkpoint"), as_of, **kwargs).orderBy("rank").collect()
    return [(row["query"], row["count"]) for row in rows]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_batches_and_restarts_add_up_to_the_board(spark, tmp_path):
    lines = [message(f"q{i % 7}", f"u{i * i % 23}", i % 33) for i in range(300)] + ["{bad", message("", "u"), message(" ", "u"), message("late", "u", 99)]
    assert board(spark, tmp_path) == []
    for part in (lines[0::3], lines[1::3], lines[2::3] + lines[:20]):
        run(spark, tmp_path, part, parts=4)
    rows = accepted(ingest(spark.createDataFrame([(line,) for line in lines], "value string"), PARAMS, NOW))
    words = spark.createDataFrame([("q3",)], "word string")
    want = [(row["query"], row["count"]) for row in top_as_of(rows, PARAMS, NOW, words).orderBy("rank").collect()]
    assert board(spark, tmp_path, stoplist=words) == want and len(want) == 5
    assert board(spark, tmp_path, NOW + timedelta(seconds=60)) == []
    parts = state_counts(spark, str(tmp_path / "checkpoint")).where("query = 'q0'").select("part").distinct().count()
    assert parts > 1


def test_a_source_counts_once_and_in_its_newest_bucket(spark, tmp_path):
    run(spark, tmp_path, [message("q", "u", 20), message("q", "v", 20)] + [message("q", "bot")] * 50)
    run(spark, tmp_path, [message("q", "u", 0), message("q", "v", 25)])
    assert board(spark, tmp_path) == [("q", 3)]
    _, current = PARAMS.live_range(NOW)
    counts = {(row["bucket_id"], row["sources"]) for row in state_counts(spark, str(tmp_path / "checkpoint")).groupBy("bucket_id").agg(F.sum("sources").alias("sources")).collect()}
    assert counts == {(current, 2), (current - 2, 1)}
    # Only the newest bucket is left at the last instant that it counts, and none after that.
    edge = datetime.fromtimestamp((current + 3) * 10, timezone.utc)
    assert board(spark, tmp_path, edge - timedelta(milliseconds=1)) == [("q", 2)]
    assert board(spark, tmp_path, edge) == []


def test_buckets_leave_state_as_the_clock_moves_on(spark, tmp_path):
    run(spark, tmp_path, [message("old", "u"), message("q", "u")], arrival())
    for seconds in (20, 200, 230):
        later = NOW + timedelta(seconds=seconds)
        run(spark, tmp_path, [message("q", f"u{seconds}", 0, later)], arrival())
    left = {(row["query"], row["bucket_id"]) for row in state_counts(spark, str(tmp_path / "checkpoint")).collect()}
    oldest, _ = PARAMS.live_range(NOW + timedelta(seconds=200))
    assert left and all(query == "q" and bucket >= oldest for query, bucket in left)
    assert board(spark, tmp_path, NOW + timedelta(seconds=230)) == [("q", 1)]


def test_a_failed_batch_is_taken_in_again(spark, tmp_path):
    """A batch whose commit is lost is run again on the state before it; here all of the first run's."""
    run(spark, tmp_path, [message("a", "u"), message("a", "v"), message("b", "u")])
    for name in ("0", ".0.crc", "1", ".1.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink(missing_ok=True)
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint/offsets" / name).unlink(missing_ok=True)
    assert board(spark, tmp_path) == []
    run(spark, tmp_path, [message("c", "u")])
    assert board(spark, tmp_path) == [("a", 2), ("b", 1), ("c", 1)]


def test_session_keeps_its_state_store(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    run(spark, tmp_path, [message("a", "u")])
    assert spark.conf.get(name, None) == before


class Map:
    """State of one key, as Spark keeps it."""

    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)


def processor():
    timers, maps = [], {}
    state = WindowState(3, 10_000_000_000)
    state.init(SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, Map()), registerTimer=timers.append))
    return state, maps, timers


def test_processor_alone():
    state, maps, timers = processor()
    give = lambda *rows: [tuple(row) for row in state.handleInputRows(("q", 1), iter([{"source": s, "bucket_id": b} for s, b in rows]), None)]
    assert give(("u", 5), ("u", 4), ("v", 4)) == [("q", 1, 4, 1), ("q", 1, 5, 1)]
    assert timers == [70_000, 80_000]
    assert give(("v", 6), ("u", 5)) == [("q", 1, 4, 0), ("q", 1, 6, 1)]
    assert maps["counts"].held == {(5,): (1,), (6,): (1,)}
    expired = lambda millis: [tuple(row) for row in state.handleExpiredTimer(("q", 1), None, SimpleNamespace(getExpiryTimeInMs=lambda: millis))]
    assert expired(70_000) == [] and expired(80_000) == [("q", 1, 5, 0)]
    assert maps["members"].held == {(6,): (["v"],)}


def test_widths_that_are_no_whole_milliseconds():
    state = WindowState(2, 3)
    assert state.expiry_millis(0) == 1 and state.expiry_millis(333_332) == 2
    assert replace(PARAMS, window_nanos=10).width_nanos == 3
