"""Ban, order, cut and publish counted queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopboard.operators.counting import live_rows, query_counts
from hopboard.params import BoardParams, epoch_micros

Ban = Callable[[Column], Column]


def without_banned(counts: DataFrame, stoplist: DataFrame | None = None, ban: Ban | None = None) -> DataFrame:
    """Drop queries equal to a stop-list word or matching a ban condition.

    There is no broadcast hint: Spark broadcasts the list while its size is under the session's
    limit and shuffles it beyond. Each query is one row here, so no key of that join is hot.
    """
    if stoplist is not None:
        words = stoplist.select(F.col("word").alias("query"))
        counts = counts.join(words, "query", "left_anti")
    if ban is not None:
        counts = counts.where(~F.coalesce(ban(F.col("query")), F.lit(False)))
    return counts


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """First k by count descending, then query ascending, with their rank.

    The cut comes first and runs in every task, so the single task that ranks sees k rows.
    """
    cut = counts.orderBy(F.desc("count"), F.asc("query")).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("count"), F.asc("query")))
    return cut.select(rank.alias("rank"), "query", "count")


def rank_counts(
    counts: DataFrame, params: BoardParams, stoplist: DataFrame | None = None, ban: Ban | None = None
) -> DataFrame:
    return top_k(without_banned(counts, stoplist, ban), params.top_k)


def top_as_of(
    rows: DataFrame,
    params: BoardParams,
    as_of: datetime,
    stoplist: DataFrame | None = None,
    ban: Ban | None = None,
) -> DataFrame:
    """The board at one instant, from bucket rows of either kind or from accepted events."""
    return rank_counts(query_counts(live_rows(rows, *params.live_range(as_of))), params, stoplist, ban)


def prefix(ranked: DataFrame, limit: int) -> DataFrame:
    """First rows of a board; a limit of zero or less means all of it."""
    return ranked if limit <= 0 else ranked.where(F.col("rank") <= limit)


def as_snapshot(ranked: DataFrame, params: BoardParams, as_of: datetime) -> DataFrame:
    """One row holding a whole board, also when it is empty. A board is at most top_k items."""
    items = F.array_sort(F.collect_list(F.struct("rank", "query", "count")))
    return ranked.agg(items.alias("items")).select(
        F.timestamp_micros(F.lit(epoch_micros(as_of))).alias("generated_at"),
        F.lit(params.window_sec).alias("window_sec"),
        "items",
    )


def snapshot_items(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("generated_at", "window_sec", F.inline("items"))


def as_document(snapshot: DataFrame, limit: int = 0) -> DataFrame:
    """JSON text of a snapshot: `data` in rank order, `timestamp` in whole seconds, `window_sec`."""
    kept = F.col("items") if limit <= 0 else F.slice("items", 1, limit)
    data = F.transform(kept, lambda item: F.struct(item["query"].alias("query"), item["count"].alias("count")))
    document = F.struct(
        data.alias("data"), F.unix_seconds("generated_at").alias("timestamp"), F.col("window_sec").alias("window_sec")
    )
    return snapshot.select(F.to_json(document).alias("document"))
