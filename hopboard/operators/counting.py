"""Distinct sources per query, exact or as mergeable sketches, over one bucket or several.

A popular query may hold a large share of all rows. Exact counting removes repeats of a
(query, source) pair before and after a shuffle on that pair, which spreads one query over all
tasks; sketches are built per task first, so one query costs a shuffle row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.params import BoardParams


def bucket_rows(rows: DataFrame, params: BoardParams) -> DataFrame:
    """Mergeable state per bucket: distinct sources, or one sketch for each bucket and query."""
    if params.counter == "exact":
        return bucket_sources(rows)
    return bucket_sketches(rows, params)


def bucket_sources(rows: DataFrame) -> DataFrame:
    return rows.select("bucket_id", "query", "source").distinct()


def bucket_sketches(rows: DataFrame, params: BoardParams) -> DataFrame:
    return rows.groupBy("bucket_id", "query").agg(F.hll_sketch_agg("source", params.lg_k).alias("sketch"))


def live_rows(rows: DataFrame, oldest: int, current: int) -> DataFrame:
    return rows.where(F.col("bucket_id").between(oldest, current))


def merged_rows(rows: DataFrame) -> DataFrame:
    """Bucket rows of either kind with those of equal bucket and query (and source) merged into one."""
    if "sketch" in rows.columns:
        return rows.groupBy("bucket_id", "query").agg(F.hll_union_agg("sketch").alias("sketch"))
    return bucket_sources(rows)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Exact number of sources for each bucket and query."""
    return rows.groupBy("bucket_id", "query").agg(F.count_distinct("source").alias("count"))


def bucket_estimates(sketches: DataFrame) -> DataFrame:
    return sketches.select("bucket_id", "query", F.hll_sketch_estimate("sketch").alias("count"))


def query_counts(rows: DataFrame) -> DataFrame:
    """Sources per query over all buckets given; a source seen in several buckets counts once.

    Takes either kind of bucket rows, or plain events for an exact count without bucket state.
    """
    if "sketch" in rows.columns:
        counter = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    else:
        counter = F.count_distinct("source")
    return rows.groupBy("query").agg(counter.alias("count"))


def query_estimates(rows: DataFrame, params: BoardParams) -> DataFrame:
    """Approximate sources per query straight from events: one sketch per query instead of per bucket."""
    return rows.groupBy("query").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", params.lg_k)).alias("count"))
