"""Replay from sketches against counts by hand at every tick."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from hopboard.operators.counting import bucket_sketches
from hopboard.operators.hopping import each_tick, top_per_tick
from hopboard.operators.sketch_replay import sketch_levels
from hopboard.params import BoardParams

ROWS = "bucket_id BIGINT, query STRING, source STRING"


def params_of(buckets, **kwargs):
    return BoardParams.of(timedelta(seconds=10 * buckets), buckets, counter="hll", **kwargs)


def by_hand(rows, size, last):
    counts = {}
    for tick in range(min(b for b, _, _ in rows), last + 1):
        seen = {}
        for b, query, source in rows:
            if tick - size < b <= tick:
                seen.setdefault(query, set()).add(source)
        counts |= {(query, tick): len(sources) for query, sources in seen.items()}
    return counts


def random_rows(seed, n=150):
    draw = random.Random(seed)
    return [(draw.randrange(-15, 25), draw.choice("abcd"), f"u{draw.randrange(12)}") for _ in range(n)]


def counts_of(levels):
    rows = each_tick(levels).collect()
    found = {(row["query"], row["tick"]): row["count"] for row in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 5, 40])
def test_every_tick_against_counts_by_hand(spark, size):
    rows = random_rows(size) + [(60, "late", "u1")]
    params = params_of(size)
    frame = spark.createDataFrame(rows, ROWS).repartition(4)
    assert counts_of(sketch_levels(frame, params)) == by_hand(rows, size, 60)
    # As the store gives them: several sketches for a bucket and query.
    halves = [spark.createDataFrame(rows[i::2], ROWS) for i in (0, 1)]
    stored = bucket_sketches(halves[0], params).unionByName(bucket_sketches(halves[1], params))
    assert counts_of(sketch_levels(stored, params, 62)) == by_hand(rows, size, 62)


def test_sparse_queries_at_block_borders(spark):
    """A query alone at the first or last bucket of a block, and one that pauses for longer than a window."""
    for bucket in (-4, -1, 0, 3, 4, 7):
        rows = [(bucket, "q", "u"), (bucket + 9, "q", "u"), (30, "end", "u")]
        assert counts_of(sketch_levels(spark.createDataFrame(rows, ROWS), params_of(4))) == by_hand(rows, 4, 30)


def test_no_events(spark):
    assert sketch_levels(spark.createDataFrame([], ROWS), params_of(3)).collect() == []


def test_boards_of_both_counters_agree(spark):
    rows = random_rows(9, 400)
    frame = spark.createDataFrame(rows, ROWS)
    words = spark.createDataFrame([("b",)], "word STRING")
    estimated, exact = (
        top_per_tick(frame, replace(params_of(6, top_k=2), counter=counter), 26, words, lambda query: query == "d").orderBy("tick", "rank").collect()
        for counter in ("hll", "exact")
    )
    assert estimated == exact and {row["query"] for row in exact} == {"a", "c"}


def test_estimates_of_many_sources(spark):
    """20,000 sources a bucket, half of which come again in the next one."""
    rows = spark.range(200_000).select(
        (F.col("id") % 10).alias("bucket_id"), F.lit("q").alias("query"),
        F.concat(F.lit("u"), (F.floor(F.col("id") / 10) + (F.col("id") % 10) * 10_000).cast("string")).alias("source"),
    )
    found = counts_of(sketch_levels(rows, params_of(4)))
    exact = {tick: 20_000 + 10_000 * min(tick, 3) for tick in range(10)}
    assert len(found) == 10
    assert all(abs(found["q", tick] - count) <= 0.03 * count for tick, count in exact.items())


def test_sketches_are_not_copied_to_ticks(spark):
    """One step per bucket, prefix and suffix; no row is made for a tick that holds a sketch."""
    rows = spark.createDataFrame([(b, "q", f"u{b}") for b in range(100)], ROWS)
    levels = sketch_levels(rows, params_of(30), 99)
    plan = levels._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and plan.count("Generate") == 1
    assert levels.count() <= 3 * 100
