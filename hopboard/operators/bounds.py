"""Boards from stored sketches that open few of them.

Beside each sketch the store keeps its estimate. Over the buckets of a window, the largest estimate of a query is
a lower and their sum an upper bound of what the union would give. The K-th largest lower bound is one for the K-th
place of the board; queries whose upper bound lies below it cannot be on it, and their sketches are never united.

Both kinds of estimates err by a share that depends on the size of the sketches. Bounds are widened by `DEVIATIONS`
standard errors to each side, so that a query is wrongly left out once in some hundred million cases.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopboard.operators.counting import live_rows, query_counts
from hopboard.operators.ranking import Ban, rank_counts, top_k, without_banned
from hopboard.params import BoardParams

DEVIATIONS = 6.0
# Fixed value: standard error of an estimate from a union, times the root of the number of registers.
ERROR_FACTOR = 1.04


def relative_error(params: BoardParams, deviations: float = DEVIATIONS) -> float:
    return deviations * ERROR_FACTOR / 2 ** (params.lg_k / 2)


def contending_queries(
    estimates: DataFrame, params: BoardParams, stoplist: DataFrame | None = None, ban: Ban | None = None
) -> DataFrame:
    """Queries that can be among the first top_k, from (query, estimate) of every sketch in the window.

    Banned queries go first, so that they set no bound. A query with a sketch whose estimate is unknown always
    stays. With fewer than top_k queries all stay, and so do all that tie with the bound.
    """
    margin = relative_error(params)
    bounds = estimates.groupBy("query").agg(
        F.max("estimate").alias("largest"), F.sum("estimate").alias("total"), F.bool_or(F.col("estimate").isNull()).alias("unknown")
    )
    bounds = without_banned(bounds, stoplist, ban).select(
        "query",
        (F.coalesce("largest", F.lit(0)) * (1 - margin) / (1 + margin)).alias("least"),
        F.when(~F.col("unknown"), F.col("total") * (1 + margin) / (1 - margin)).alias("most"),
    )
    highest = bounds.orderBy(F.desc("least")).limit(params.top_k)
    bound = highest.agg(F.when(F.count(F.lit(1)) == params.top_k, F.min("least"))).scalar()
    return bounds.where(F.col("most").isNull() | (F.col("most") >= F.coalesce(bound, F.lit(0.0)))).select("query")


def top_bounded(
    rows: DataFrame,
    params: BoardParams,
    as_of: datetime,
    stoplist: DataFrame | None = None,
    ban: Ban | None = None,
    named: int | None = None,
) -> DataFrame:
    """The board at one instant from stored sketch rows (bucket_id, query, estimate, sketch).

    The first pass reads names and estimates only. Contenders up to `named` (four boards unless given) are named in
    the filter of the second pass, which lets the scan skip pages of files sorted by query; more of them,
    as where everything ties, are joined. Either way the sketches of other queries are not united.
    """
    live = live_rows(rows, *params.live_range(as_of))
    contenders = contending_queries(live.select("query", "estimate"), params, stoplist, ban)
    most = 4 * params.top_k if named is None else named
    # Within an aggregate the limit is one job; a plain one looks for rows in a few partitions at a time.
    names = contenders.limit(most + 1).agg(F.collect_list("query")).first()[0]
    if len(names) <= most:
        contending = live.where(F.col("query").isin(names))
    else:
        contending = live.join(contenders, "query", "left_semi")
    return rank_counts(query_counts(contending.select("query", "sketch")), params)


def with_certainty(counts: DataFrame, params: BoardParams, deviations: float = 3.0) -> DataFrame:
    """Board of estimated counts with what the error of the estimates leaves open.

    `low` and `high` enclose the true count up to so many standard errors. `in_top` says that the query is surely
    among the first top_k: the first one behind the board cannot reach its low end. `at_rank` says that
    neither neighbour, that one included, can change places with it. Where all queries are on the board, all are surely
    in the top. Exact counts have no error.
    """
    error = 0.0 if params.counter == "exact" else relative_error(params, deviations)
    ranked = top_k(counts, params.top_k + 1).select(
        "rank", "query", "count",
        F.ceil(F.col("count") / (1 + error)).alias("low"),
        (F.floor(F.col("count") / (1 - error)) if error < 1 else F.lit(2**63 - 1)).alias("high"),
    )
    # These windows see no more than top_k + 1 rows.
    by_rank = Window.orderBy("rank")
    behind = F.max(F.when(F.col("rank") > params.top_k, F.col("high"))).over(by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    below = F.lead("high").over(by_rank)
    above = F.lag("low").over(by_rank)
    apart = lambda low, high: F.coalesce(low > high, F.lit(True))
    return ranked.select(
        "*",
        apart(F.col("low"), behind).alias("in_top"),
        (apart(F.col("low"), below) & apart(above, F.col("high"))).alias("at_rank"),
    ).where(F.col("rank") <= params.top_k)
