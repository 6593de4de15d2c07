"""Boards cut by bounds, and certainty of places, against boards from all sketches and exact counts."""

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hopboard.operators.bounds import contending_queries, relative_error, top_bounded, with_certainty
from hopboard.operators.counting import bucket_sketches, query_counts
from hopboard.operators.ranking import top_as_of
from hopboard.params import BoardParams
from hopboard.streaming.bucket_store import BucketStore
from hopboard.streaming.jobs import rebuild
from hopboard.streaming.snapshot_store import SnapshotStore

NOW = datetime.fromtimestamp(1_700_000_040, timezone.utc)
PARAMS = BoardParams.of(timedelta(seconds=60), 6, 3, counter="hll")
OLDEST, CURRENT = PARAMS.live_range(NOW)
ROWS = "bucket_id BIGINT, query STRING, source STRING"


def stored(frame, params=PARAMS):
    return bucket_sketches(frame, params).withColumn("estimate", F.hll_sketch_estimate("sketch"))


def random_rows(seed, queries=30):
    draw = random.Random(seed)
    return [
        (draw.randrange(OLDEST - 2, CURRENT + 1), f"q{q:02d}", f"u{draw.randrange(60)}") for q in range(queries) for _ in range(draw.choice([1, 5, 40, 80]))
    ]


@pytest.mark.parametrize("named", [None, 0, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_board_as_from_all_sketches(spark, seed, named):
    rows = stored(spark.createDataFrame(random_rows(seed), ROWS))
    rows = rows.unionByName(rows.limit(5))  # A bucket and query may have several rows.
    words = spark.createDataFrame([("q03",), ("q07",)], "word STRING")
    for stoplist, ban in ((None, None), (words, lambda query: query.endswith("1"))):
        got = top_bounded(rows, PARAMS, NOW, stoplist, ban, named).orderBy("rank").collect()
        assert got == top_as_of(rows, PARAMS, NOW, stoplist, ban).orderBy("rank").collect() and len(got) == 3


@pytest.mark.parametrize("named", [None, 0])
def test_ties_at_the_last_place_all_stay(spark, named):
    rows = stored(spark.createDataFrame([(CURRENT, f"q{i:03d}", f"u{j}") for i in range(200) for j in range(3)], ROWS))
    assert contending_queries(rows, PARAMS).count() == 200
    got = [(row["query"], row["count"]) for row in top_bounded(rows, PARAMS, NOW, named=named).orderBy("rank").collect()]
    assert got == [("q000", 3), ("q001", 3), ("q002", 3)]


def test_few_or_no_queries(spark):
    rows = stored(spark.createDataFrame([(CURRENT, "a", "u"), (OLDEST, "a", "v"), (CURRENT, "b", "u")], ROWS))
    assert [tuple(row) for row in top_bounded(rows, PARAMS, NOW).orderBy("rank").collect()] == [(1, "a", 2), (2, "b", 1)]
    assert top_bounded(rows.limit(0), PARAMS, NOW).collect() == []


def test_banned_queries_set_no_bound(spark):
    rows = [(CURRENT, f"big{i}", f"u{j}") for i in range(5) for j in range(100)] + [(CURRENT, f"small{i}", "u") for i in range(2)]
    frame = stored(spark.createDataFrame(rows, ROWS))
    got = top_bounded(frame, PARAMS, NOW, ban=lambda query: query.startswith("big"))
    assert [row["query"] for row in got.orderBy("rank").collect()] == ["small0", "small1"]


def test_most_queries_are_cut(spark):
    """The sum of bucket estimates lies far below the third board place for all but a few."""
    rows = [(OLDEST + b, f"top{i}", f"u{j}") for i in range(3) for b in range(6) for j in range(50)]
    rows += [(OLDEST + b, f"rare{i}", f"u{j}") for i in range(100) for b in range(2) for j in range(4)]
    frame = stored(spark.createDataFrame(rows, ROWS))
    assert {row["query"] for row in contending_queries(frame, PARAMS).collect()} == {"top0", "top1", "top2"}


def test_rows_without_estimate_stay(spark):
    """As written by a store before it kept estimates."""
    rows = [(CURRENT, f"q{i}", f"u{j}") for i in range(6) for j in range(20 * i + 1)]
    frame = stored(spark.createDataFrame(rows, ROWS))
    old = frame.withColumn("estimate", F.when(F.col("query") != "q5", F.col("estimate")))
    assert "q5" in {row["query"] for row in contending_queries(old, PARAMS).collect()}
    assert top_bounded(old, PARAMS, NOW).collect() == top_as_of(frame, PARAMS, NOW).collect()


def test_large_sketches_at_close_counts(spark):
    """Counts two percent apart: within the error, so that the cut must keep what it cannot tell apart."""
    sizes = [20_000 + 400 * i for i in range(8)]
    rows = spark.createDataFrame([(f"q{i}", n) for i, n in enumerate(sizes)], "query STRING, n INT").select(
        "query", F.explode(F.sequence(F.lit(1), "n")).alias("i")
    ).select((F.lit(OLDEST) + F.col("i") % 3).cast("bigint").alias("bucket_id"), "query", F.concat("query", F.col("i").cast("string")).alias("source"))
    params = replace(PARAMS, lg_k=12)
    frame = stored(rows, params)
    assert top_bounded(frame, params, NOW).collect() == top_as_of(frame, params, NOW).collect()


def test_sketches_are_read_after_the_cut(spark, tmp_path):
    store = BucketStore(str(tmp_path), PARAMS)
    store.write(spark.createDataFrame(random_rows(4), ROWS).where(F.col("bucket_id") >= OLDEST), "one")
    rows = store.read(spark, OLDEST, CURRENT)
    scans = lambda frame: [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    first = scans(contending_queries(rows.select("query", "estimate"), PARAMS))
    assert first and all("sketch" not in scan.split("FileScan parquet ")[1].split("]")[0] for scan in first)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    second = scans(top_bounded(rows, PARAMS, NOW, named=100))
    assert len(second) == 1 and "sketch" in second[0]
    assert "In(query, [" in second[0].split("PushedFilters: ")[1]
    assert top_bounded(rows, PARAMS, NOW).collect() == top_as_of(rows, PARAMS, NOW).collect()


def test_files_of_the_store_are_sorted_by_query(spark, tmp_path):
    """So that a scan for some queries can skip the pages of others."""
    store = BucketStore(str(tmp_path), PARAMS)
    store.write(spark.createDataFrame([(CURRENT, f"q{i * 7919 % 5000:04d}", "u") for i in range(5000)], ROWS), "one")
    for path in {row["path"] for row in store.read(spark, CURRENT, CURRENT).select(F.input_file_name().alias("path")).distinct().collect()}:
        names = [row["query"] for row in spark.read.parquet(path).coalesce(1).collect()]
        assert names == sorted(names) and len(names) > 1


def test_exact_boards_are_not_bounded(spark, tmp_path):
    with pytest.raises(ValueError, match="no bounds"):
        rebuild(spark, replace(PARAMS, counter="exact"), None, None, NOW, bounded=True)


def test_rebuilding_from_sketches_uses_the_cut(spark, tmp_path):
    store, boards = BucketStore(f"{tmp_path}/buckets", PARAMS), SnapshotStore(f"{tmp_path}/boards", PARAMS)
    frame = spark.createDataFrame(random_rows(6), ROWS).where(F.col("bucket_id") >= OLDEST)
    store.write(frame, "one")
    store.write(frame.limit(300), "two")
    store.compact(spark, OLDEST, CURRENT, grace_seconds=0)
    store.compact(spark, OLDEST, CURRENT, grace_seconds=0)
    assert store.read(spark, OLDEST, CURRENT).where("estimate IS NULL").isEmpty()
    rebuild(spark, PARAMS, store, boards, NOW, bounded=True)
    want = top_as_of(frame, replace(PARAMS, counter="exact"), NOW).orderBy("rank").collect()
    assert [tuple(row) for row in boards.top(spark, "3", NOW).select("rank", "query", "count").orderBy("rank").collect()] == [tuple(row) for row in want]


@pytest.mark.parametrize("lg_k", [6, 9, 14])
def test_what_is_called_certain_holds_for_exact_counts(spark, lg_k):
    params = replace(PARAMS, lg_k=lg_k, top_k=5)
    sizes = [4000, 3900, 2500, 1200, 1190, 1180, 600, 20, 19, 3]
    rows = [(CURRENT, f"q{i}", f"u{i}-{j}") for i, n in enumerate(sizes) for j in range(n)]
    estimates = query_counts(bucket_sketches(spark.createDataFrame(rows, ROWS), params))
    got = with_certainty(estimates, params).orderBy("rank").collect()
    assert [row["rank"] for row in got] == [1, 2, 3, 4, 5]
    exact = {f"q{i}": n for i, n in enumerate(sizes)}
    for row in got:
        assert row["low"] <= exact[row["query"]] <= row["high"]
        place = 1 + sum(n > exact[row["query"]] for n in sizes)
        assert not row["in_top"] or place <= 5
        assert not row["at_rank"] or place == row["rank"]
    assert relative_error(params, 3) < 1 or not any(row["at_rank"] for row in got)
    if lg_k == 14:
        assert [row["in_top"] for row in got] == [True, True, True, False, False]
        assert [row["at_rank"] for row in got] == [False, False, True, False, False]


def test_certainty_of_exact_counts_and_short_boards(spark):
    params = replace(PARAMS, counter="exact", top_k=2)
    counts = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2)], "query STRING, count BIGINT")
    got = [tuple(row) for row in with_certainty(counts, params).orderBy("rank").collect()]
    assert got == [(1, "a", 3, 3, 3, True, True), (2, "b", 2, 2, 2, False, False)]
    assert all(row["in_top"] for row in with_certainty(counts, replace(params, top_k=3)).collect())
    assert with_certainty(counts.limit(0), params).collect() == []
