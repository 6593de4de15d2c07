"""Compaction of the bucket store, upkeep of boards, and the durable stop-list."""

from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hopboard.operators.ranking import top_as_of
from hopboard.params import BoardParams
from hopboard.sources.storage import create_marker, matching_paths
from hopboard.streaming.bucket_store import BucketStore
from hopboard.streaming.jobs import rebuild, start_compacting, start_rebuilding
from hopboard.streaming.snapshot_store import SnapshotStore
from hopboard.streaming.stoplist_store import StoplistStore

NOW = datetime(2024, 5, 1, 12, 0, 9, tzinfo=timezone.utc)
OLDEST, CURRENT = BoardParams().live_range(NOW)


@pytest.fixture(params=["exact", "hll"])
def store(request, tmp_path):
    return BucketStore(str(tmp_path / "buckets"), replace(BoardParams(), counter=request.param))


def rows(spark, batch, n=60):
    return spark.range(n).select(
        (F.lit(OLDEST) + F.col("id") % 3).alias("bucket_id"),
        F.concat(F.lit("q"), (F.col("id") % 5).cast("string")).alias("query"),
        F.concat(F.lit("u"), (F.col("id") * batch % 17).cast("string")).alias("source"),
    ).repartition(6)


def files(tmp_path):
    return {bucket: len(list((tmp_path / "buckets").glob(f"bucket_id={bucket}/batch=*/*.parquet"))) for bucket in range(OLDEST, OLDEST + 3)}


def board(spark, store):
    return [tuple(row) for row in top_as_of(store.read(spark, OLDEST, CURRENT), store.params, NOW).collect()]


def test_batches_leave_few_files_and_compaction_one(spark, store, tmp_path):
    for batch in range(1, 6):
        store.write(rows(spark, batch), f"b{batch}")
    assert max(files(tmp_path).values()) == 5
    before = board(spark, store)
    reader = store.read(spark, OLDEST, CURRENT)
    assert store.compact(spark, OLDEST, CURRENT) == 15
    assert board(spark, store) == before
    assert [tuple(row) for row in top_as_of(reader, store.params, NOW).collect()] == before
    assert store.compact(spark, OLDEST, CURRENT, grace_seconds=0) == 0
    assert set(files(tmp_path).values()) == {1} and board(spark, store) == before
    store.write(rows(spark, 6), "b6")
    more = board(spark, store)
    store.compact(spark, OLDEST, CURRENT)
    store.compact(spark, OLDEST, CURRENT, grace_seconds=0)
    assert set(files(tmp_path).values()) == {1} and board(spark, store) == more


def test_compaction_takes_only_the_buckets_asked_for(spark, store, tmp_path):
    for batch in (1, 2):
        store.write(rows(spark, batch), f"b{batch}")
    assert store.compact(spark, OLDEST + 1, OLDEST + 1, 0) == 2
    store.compact(spark, OLDEST + 1, OLDEST + 1, 0)
    assert files(tmp_path) == {OLDEST: 2, OLDEST + 1: 1, OLDEST + 2: 2}


@pytest.mark.parametrize("step", ["_store", "marker"])
def test_failed_compaction_changes_nothing(spark, store, monkeypatch, step):
    for batch in (1, 2, 3):
        store.write(rows(spark, batch), f"b{batch}")
    before = board(spark, store)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        if step == "_store":
            patched.setattr(BucketStore, "_store", fail)
        else:
            patched.setattr("hopboard.streaming.bucket_store.create_marker", fail)
        with pytest.raises(RuntimeError):
            store.compact(spark, OLDEST, CURRENT, 0)
    assert board(spark, store) == before
    store.compact(spark, OLDEST, CURRENT, 0)
    store.compact(spark, OLDEST, CURRENT, 0)
    assert board(spark, store) == before


def test_batch_written_again_after_compaction(spark, store):
    for batch in (1, 2):
        store.write(rows(spark, batch), f"b{batch}")
    before = board(spark, store)
    store.compact(spark, OLDEST, CURRENT, 0)
    store.write(rows(spark, 2), "b2")
    store.compact(spark, OLDEST, CURRENT, 0)
    store.write(rows(spark, 2), "b2")
    assert board(spark, store) == before


def test_unfinished_boards_go_with_the_old_ones(spark, store, tmp_path):
    boards = SnapshotStore(str(tmp_path / "boards"), store.params)
    for second in range(4):
        rebuild(spark, store.params, store, boards, NOW + timedelta(seconds=second))
    unfinished = sorted((tmp_path / "boards").glob("generated_micros=*"))[1]
    (unfinished / "_SUCCESS").unlink()
    newest = tmp_path / "boards" / f"generated_micros={2**62:020d}"
    newest.mkdir()
    assert boards.keep_newest(spark, 2) == 2
    assert len(list((tmp_path / "boards").glob("generated_micros=*"))) == 3 and newest.exists()


def test_open_buckets_are_folded_by_levels(spark, store, tmp_path):
    """Three batches of a level make one of the next; closed buckets become one batch each."""
    held, newest = {}, OLDEST + 2
    for batch in range(1, 11):
        store.write(rows(spark, batch), f"b{batch:02d}")
        before = board(spark, store)
        store.compact(spark, OLDEST, CURRENT, 0, open_from=newest, fan=3)
        store.compact(spark, OLDEST, CURRENT, 0, open_from=newest, fan=99)
        assert board(spark, store) == before
        held[batch] = files(tmp_path)
    assert all(held[batch][bucket] == 1 for batch in held for bucket in (OLDEST, OLDEST + 1))
    # At most two batches of each of the levels of one, three and nine.
    assert max(held[batch][newest] for batch in held) <= 6
    store.compact(spark, OLDEST, CURRENT, 0)
    store.compact(spark, OLDEST, CURRENT, 0)
    assert files(tmp_path)[newest] == 1 and board(spark, store) == before


def test_compaction_runs_on_a_clock_of_its_own(spark, store, tmp_path):
    for batch in range(12):
        store.write(rows(spark, batch + 1), f"b{batch}")
    before = board(spark, store)
    query = start_compacting(spark, store.params, store, str(tmp_path / "checkpoint"), "200 milliseconds", lambda: NOW, 0)
    try:
        while query.isActive and set(files(tmp_path).values()) != {1}:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert query.exception() is None and board(spark, store) == before


def test_ticks_report_gauges(spark, store, tmp_path):
    for batch in (1, 2):
        store.write(rows(spark, batch), f"b{batch}")
    boards, seen = SnapshotStore(str(tmp_path / "boards"), store.params), []
    words = spark.createDataFrame([("q1",)], "word STRING")
    query = start_rebuilding(
        spark, store.params, store, boards, str(tmp_path / "checkpoint"), "200 milliseconds", lambda: words,
        clock=lambda: NOW, on_gauges=seen.append,
    )
    try:
        while len(seen) < 2 and query.isActive:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert seen[0]["snapshot_size"] == 4 and seen[0]["stoplist_words"] == 1 and seen[0]["rebuild_seconds"] > 0


@pytest.fixture
def words(spark, tmp_path):
    return StoplistStore(spark, str(tmp_path / "words"))


def frame(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "word STRING")


def listed(words):
    return [row["word"] for row in words.list().collect()]


def test_words_are_added_removed_and_reported(spark, words):
    assert listed(words) == []
    assert {tuple(r) for r in words.add(frame(spark, " Spam ", "ads", "  ")).collect()} == {("spam", "added"), ("ads", "added"), ("  ", "invalid")}
    old = words.table()
    assert {tuple(r) for r in words.add(frame(spark, "SPAM", "new")).collect()} == {("spam", "conflict"), ("new", "added")}
    assert listed(words) == ["ads", "new", "spam"]
    words.remove(frame(spark, "Ads", "absent"))
    assert listed(words) == ["new", "spam"]
    assert sorted(row["word"] for row in old.collect()) == ["ads", "spam"]


def test_change_log(spark, words):
    words.add(frame(spark, "a", "b"))
    log = [(1, "remove", "A"), (2, "add", "c"), (3, "add", " C"), (4, "add", " ")]
    changes = spark.createDataFrame(log, "seq LONG, op STRING, word STRING").withColumn("changed_at", F.current_timestamp())
    got = {row["seq"]: row["status"] for row in words.apply(changes).collect()}
    assert got == {1: "removed", 2: "added", 3: "conflict", 4: "invalid"} and listed(words) == ["b", "c"]


def test_next_rebuild_bans_and_unbans(spark, store, words, tmp_path):
    store.write(rows(spark, 1), "b1")
    boards = SnapshotStore(str(tmp_path / "boards"), store.params)

    def queries():
        rebuild(spark, store.params, store, boards, NOW, words.active)
        return {row["query"]: row["count"] for row in boards.top(spark, "100", NOW).collect()}

    before = queries()
    words.add(frame(spark, "q1"))
    assert "q1" in before and queries() == {query: count for query, count in before.items() if query != "q1"}
    words.remove(frame(spark, "q1"))
    assert queries() == before


def test_failed_and_competing_changes(spark, words, tmp_path):
    words.add(frame(spark, "a"))
    with pytest.raises(Exception, match="broken"):
        words.replace(words.table().withColumn("word", F.raise_error(F.lit("broken"))))
    assert listed(words) == ["a"]
    words.add(frame(spark, "b"))
    assert listed(words) == ["a", "b"]
    create_marker(spark, f"{words.path}/claim={3:012d}")
    with pytest.raises(Exception, match="exist"):
        words.add(frame(spark, "c"))
    assert listed(words) == ["a", "b"]
    words.stale_seconds = 0
    words.add(frame(spark, "c"))
    assert listed(words) == ["a", "b", "c"]


def test_old_versions_are_deleted(spark, words):
    for text in "abc":
        words.add(frame(spark, text))
    assert words.keep_newest(1) == 2 and words.keep_newest(1) == 0 and listed(words) == ["a", "b", "c"]
    assert len(matching_paths(spark, f"{words.path}/claim=*")) == 1
    words.add(frame(spark, "d"))
    assert listed(words) == ["a", "b", "c", "d"]
