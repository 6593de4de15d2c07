import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hopboard.operators.counting import bucket_counts, bucket_rows, bucket_sketches, query_counts, query_estimates
from hopboard.operators.hopping import contenders, each_tick, levels_of, top_per_tick
from hopboard.operators.ranking import (
    as_document,
    as_snapshot,
    prefix,
    rank_counts,
    snapshot_items,
    top_as_of,
    without_banned,
)
from hopboard.operators.upkeep import expired_buckets, gauges
from hopboard.params import BoardParams

NOW = datetime.fromtimestamp(1_700_000_040, timezone.utc)
PARAMS = BoardParams.of(timedelta(seconds=30), 3, counter="exact")
OLDEST, CURRENT = PARAMS.live_range(NOW)
ROWS = "bucket_id BIGINT, query STRING, source STRING"


def board(ranked):
    return [(row["query"], row["count"]) for row in ranked.orderBy("rank").collect()]


def rows_of(spark, *triples):
    return spark.createDataFrame(list(triples), ROWS)


@pytest.fixture(scope="module")
def languages(spark):
    return rows_of(
        spark,
        *[(CURRENT, "rust", f"u{i}") for i in range(3)],
        *[(CURRENT, "python", f"u{i}") for i in range(5)],
        (CURRENT, "go", "u0"),
        *[(CURRENT, "python", "u0")] * 100,
    )


@pytest.mark.parametrize("counter", ["exact", "hll"])
def test_order_and_distinct_sources(languages, counter):
    params = replace(PARAMS, counter=counter)
    got = top_as_of(bucket_rows(languages, params), params, NOW)
    assert board(got) == [("python", 5), ("rust", 3), ("go", 1)]
    assert [row["rank"] for row in got.collect()] == [1, 2, 3]


@pytest.mark.parametrize("counter", ["exact", "hll"])
def test_source_in_several_buckets_counts_once_and_old_buckets_not_at_all(spark, counter):
    params = replace(PARAMS, counter=counter)
    rows = rows_of(
        spark, (OLDEST, "q", "a"), (CURRENT, "q", "a"), (CURRENT, "q", "b"),
        (OLDEST - 1, "q", "c"), (OLDEST - 1, "gone", "a"), (CURRENT + 1, "ahead", "a"),
    )
    assert board(top_as_of(bucket_rows(rows, params), params, NOW)) == [("q", 2)]


def test_ties_are_ordered_by_the_bytes_of_the_query(spark):
    queries = ["b", "a", "Z", "я", "é", "\U0001f600", "￮", "a b", "ab"]
    rows = rows_of(spark, *[(CURRENT, query, "u") for query in queries])
    assert [query for query, _ in board(top_as_of(rows, PARAMS, NOW))] == sorted(queries, key=lambda q: q.encode())


def test_ban_comes_before_the_cut_and_matches_whole_queries(spark, languages):
    words = spark.createDataFrame([("python",), ("rus",)], "word STRING")
    assert board(top_as_of(languages, replace(PARAMS, top_k=2), NOW, words)) == [("rust", 3), ("go", 1)]
    assert board(top_as_of(languages, PARAMS, NOW, ban=lambda query: query.startswith("p"))) == [("rust", 3), ("go", 1)]
    assert without_banned(query_counts(languages), words.limit(0)).count() == 3


def test_lifting_a_ban_restores_the_full_count(spark, languages):
    words = spark.createDataFrame([("python",)], "word STRING")
    assert ("python", 5) not in board(top_as_of(languages, PARAMS, NOW, words))
    assert ("python", 5) in board(top_as_of(languages, PARAMS, NOW, words.where("word <> 'python'")))


def test_cut_keeps_the_first_k(spark):
    rows = rows_of(spark, *[(CURRENT, f"q{i:02d}", f"u{j}") for i in range(10) for j in range(i + 1)])
    assert board(top_as_of(rows, replace(PARAMS, top_k=3), NOW)) == [("q09", 10), ("q08", 9), ("q07", 8)]


@pytest.mark.parametrize("limit, rows", [(3, 3), (10, 10), (11, 10), (0, 10), (-5, 10)])
def test_prefix(spark, limit, rows):
    ranked = spark.range(1, 11).select(F.col("id").cast("int").alias("rank"))
    assert prefix(ranked, limit).count() == rows


def test_snapshot_and_document(languages):
    snapshot = as_snapshot(top_as_of(languages, PARAMS, NOW), PARAMS, NOW)
    assert as_document(snapshot, 2).first()["document"] == (
        '{"data":[{"query":"python","count":5},{"query":"rust","count":3}],"timestamp":1700000040,"window_sec":30}'
    )
    assert [row["rank"] for row in snapshot_items(snapshot).collect()] == [1, 2, 3]


def test_empty_snapshot(languages):
    snapshot = as_snapshot(top_as_of(languages.limit(0), PARAMS, NOW), PARAMS, NOW)
    assert as_document(snapshot).first()["document"] == '{"data":[],"timestamp":1700000040,"window_sec":30}'
    assert snapshot_items(snapshot).count() == 0


def test_bucket_counts_do_not_add_up_to_query_counts(spark):
    rows = rows_of(spark, (1, "q", "a"), (2, "q", "a"), (2, "q", "b"))
    assert sorted(tuple(row) for row in bucket_counts(rows).collect()) == [(1, "q", 1), (2, "q", 2)]
    assert [tuple(row) for row in query_counts(rows).collect()] == [("q", 2)]


def test_sketches_are_close_to_exact_counts(spark):
    params = replace(PARAMS, counter="hll")
    rows = spark.range(60_000).select(
        (F.col("id") % 5).alias("bucket_id"),
        F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("query"),
        F.concat(F.lit("user-"), F.col("id").cast("string")).alias("source"),
    )
    for counts in (query_counts(bucket_sketches(rows, params)), query_estimates(rows, params)):
        for row in counts.collect():
            assert abs(row["count"] - 20_000) <= 600


@pytest.mark.parametrize("sources", [2, 50])
def test_small_sketches_are_exact(spark, sources):
    rows = spark.range(sources * 4).select(
        (F.col("id") % 2).alias("bucket_id"), F.lit("q").alias("query"), (F.col("id") % sources).cast("string").alias("source")
    )
    sketches = bucket_sketches(rows, replace(PARAMS, counter="hll"))
    assert query_counts(sketches).first()["count"] == sources


def test_sketches_of_different_sizes_do_not_merge(spark):
    rows = rows_of(spark, (1, "q", "a"))
    mixed = bucket_sketches(rows, replace(PARAMS, counter="hll")).unionByName(
        bucket_sketches(rows, replace(PARAMS, counter="hll", lg_k=12))
    )
    with pytest.raises(Exception, match="HLL_UNION_DIFFERENT_LG_K"):
        query_counts(mixed).collect()


def test_merging_twice_changes_nothing(spark, languages):
    sketches = bucket_sketches(languages, replace(PARAMS, counter="hll"))
    once = sorted(tuple(row) for row in query_counts(sketches).collect())
    assert sorted(tuple(row) for row in query_counts(sketches.unionByName(sketches)).collect()) == once


def brute_force_ticks(rows, bucket_count, k):
    buckets = [bucket for bucket, _, _ in rows]
    result = []
    for tick in range(min(buckets), max(buckets) + 1):
        sources = {}
        for bucket, query, source in rows:
            if tick - bucket_count < bucket <= tick:
                sources.setdefault(query, set()).add(source)
        ranked = sorted(((-len(found), query) for query, found in sources.items()))[:k]
        result += [(tick, rank, query, -count) for rank, (count, query) in enumerate(ranked, 1)]
    return result


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_recounting_every_window(spark, seed):
    random.seed(seed)
    rows = [
        (100 + random.randrange(25) ** 2 // 10, f"q{min(random.randrange(6), random.randrange(6))}", f"u{random.randrange(7)}")
        for _ in range(120)
    ]
    params = replace(PARAMS, bucket_count=4, top_k=3)
    got = top_per_tick(rows_of(spark, *rows), params).collect()
    assert sorted(tuple(row) for row in got) == brute_force_ticks(rows, 4, 3)


def test_replay_with_stop_list_and_last_tick(spark):
    rows = rows_of(spark, (1, "a", "u"), (1, "b", "u"), (2, "a", "v"))
    words = spark.createDataFrame([("b",)], "word STRING")
    got = top_per_tick(rows, PARAMS, last_tick=5, stoplist=words).collect()
    assert sorted(tuple(row) for row in got) == [(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "a", 2), (4, 1, "a", 1)]


def test_expired_buckets_and_gauges(spark):
    rows = rows_of(spark, (OLDEST - 2, "a", "u"), (OLDEST - 1, "a", "u"), (OLDEST - 1, "b", "u"), (OLDEST, "a", "u"))
    assert sorted(tuple(row) for row in expired_buckets(rows, PARAMS, NOW).collect()) == [(OLDEST - 2, 1), (OLDEST - 1, 2)]
    ranked = rank_counts(query_counts(rows), replace(PARAMS, top_k=1))
    words = spark.createDataFrame([("x",), ("y",)], "word STRING")
    assert {row["gauge"]: row["value"] for row in gauges(ranked, words).collect()} == {
        "snapshot_size": 1, "stoplist_words": 2,
    }


@pytest.mark.parametrize("top_k, bucket_count", [(3, 5), (1, 9), (4, 16), (3, 1)])
def test_replay_with_many_ties_and_wide_windows(spark, top_k, bucket_count):
    random.seed(top_k * bucket_count)
    rows = [(random.randrange(60), f"q{random.randrange(12)}", f"u{random.randrange(3)}") for _ in range(90)]
    params = replace(PARAMS, bucket_count=bucket_count, top_k=top_k)
    got = top_per_tick(rows_of(spark, *rows), params).collect()
    assert sorted(tuple(row) for row in got) == brute_force_ticks(rows, bucket_count, top_k)


def test_replay_drops_rare_queries_before_copying_them(spark):
    params = replace(PARAMS, bucket_count=30, top_k=5)
    rare = spark.range(20_000).selectExpr("id % 60 AS bucket_id", "concat('rare', id) AS query", "'u' AS source")
    head = spark.range(60 * 10 * 8).selectExpr("id % 60 AS bucket_id", "concat('hot', id % 10) AS query", "concat('u', id) AS source")
    levels = levels_of(rare.unionByName(head), params)
    every, kept = each_tick(levels).count(), each_tick(contenders(levels, params)).count()
    ticks = levels.agg({"until": "max"}).first()[0] + 1
    assert every > 200_000 and kept <= 3 * ticks * params.top_k + 25 * 20_000 / 60


def test_replay_reads_its_input_once(spark, tmp_path):
    rows_of(spark, (1, "a", "u"), (2, "b", "u")).write.parquet(str(tmp_path / "rows"))
    frame = top_per_tick(spark.read.parquet(str(tmp_path / "rows")), PARAMS)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
