"""Gauges over the published tables and the buckets that have left the window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.params import BoardParams


def gauges(ranked: DataFrame, words: DataFrame) -> DataFrame:
    """Size of the board after the cut and number of stop-list words, as rows (gauge, value)."""
    return _size(ranked, "snapshot_size").unionByName(_size(words, "stoplist_words"))


def expired_buckets(rows: DataFrame, params: BoardParams, as_of: datetime) -> DataFrame:
    """Buckets before the window and the number of queries each one holds."""
    oldest, _ = params.live_range(as_of)
    return (
        rows.where(F.col("bucket_id") < oldest)
        .groupBy("bucket_id")
        .agg(F.count_distinct("query").alias("queries"))
    )


def _size(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("gauge"), "value")
