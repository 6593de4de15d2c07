"""Replay of a whole history: the board at the end of every bucket."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopboard.operators.ranking import Ban, without_banned
from hopboard.operators.sketch_replay import sketch_levels
from hopboard.params import BoardParams


def levels_of(rows: DataFrame, params: BoardParams, last_tick: Column | int | None = None) -> DataFrame:
    """Stretches of ticks (query, tick, until, count) in which a query's count stays the same.

    The window of tick t spans the buckets t-B+1 to t. Each (query, source) pair is turned into the
    stretches of ticks it counts in, a stretch into a plus one where it starts and a minus one
    after its end, and a running sum over these few steps gives the count up to the next step. The
    last tick defaults to that of the newest bucket, where the last stretch starts. It is taken from the
    same steps, and both uses need the same columns of them, so that Spark works these out once.
    """
    seen = rows.select("bucket_id", "query", "source").distinct()
    next_seen = F.lead("bucket_id").over(Window.partitionBy("query", "source").orderBy("bucket_id"))
    past_window = F.col("bucket_id") + params.bucket_count
    stretches = seen.select("query", F.col("bucket_id").alias("start"), F.least(past_window, next_seen).alias("stop"))

    steps = (
        stretches.select("query", F.inline(F.array(_step("start", 1), _step("stop", -1))))
        .groupBy("query", "tick")
        .agg(F.sum("change").alias("change"), F.max("change").alias("largest"))
    )
    if last_tick is None:
        last_tick = steps.where("largest > 0").agg(F.max("tick")).scalar()
    elif isinstance(last_tick, int):
        last_tick = F.lit(last_tick).cast("bigint")
    # Steps that cancel out are kept: with them no two steps of a live query are further apart than
    # the window is long, which bounds the sequences below.
    by_tick = Window.partitionBy("query").orderBy("tick")
    levels = steps.select(
        "query",
        "tick",
        F.when(F.col("largest").isNotNull(), F.sum("change").over(by_tick)).alias("count"),
        (F.lead("tick").over(by_tick) - 1).alias("until"),
    )
    return levels.withColumn("until", F.least("until", last_tick)).where(
        (F.col("count") > 0) & (F.col("tick") <= F.col("until"))
    )


def contenders(levels: DataFrame, params: BoardParams) -> DataFrame:
    """Parts of levels that can be among the first top_k of a tick; what is dropped never is.

    Ticks are cut into runs of about the square root of the window's buckets. A query that is there
    throughout a run has at least its smallest count at every tick of it, so the K-th largest of
    these smallest counts is a lower bound for the K-th count of each tick in the run. Parts below
    the bound go; ties with it stay, all of them where everything ties. Rare queries are so dropped
    before they are copied to their ticks. Banned queries must be gone before.
    """
    length = max(1, isqrt(params.bucket_count))
    floor_of = lambda column: F.floor(F.col(column) / length).cast("bigint")
    runs = levels.withColumn("run", F.explode(F.sequence(floor_of("tick"), floor_of("until"))))
    parts = runs.select(
        "run", "query", "count",
        F.greatest("tick", F.col("run") * length).alias("tick"),
        F.least("until", (F.col("run") + 1) * length - 1).alias("until"),
    )
    throughout = (
        parts.groupBy("run", "query")
        .agg(F.min("count").alias("least"), F.sum(F.col("until") - F.col("tick") + 1).alias("ticks"))
        .where(F.col("ticks") == length)
    )
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("least")))
    bounds = throughout.withColumn("place", place).where(F.col("place") == params.top_k).select(
        "run", F.col("least").alias("bound")
    )
    return (
        parts.join(bounds, "run", "left")
        .where(F.col("count") >= F.coalesce("bound", F.lit(0)))
        .select("query", "tick", "until", "count")
    )


def top_per_tick(
    rows: DataFrame,
    params: BoardParams,
    last_tick: Column | int | None = None,
    stoplist: DataFrame | None = None,
    ban: Ban | None = None,
) -> DataFrame:
    """First top_k queries of every tick; the last tick defaults to the newest bucket of the rows.

    With counter `hll` counts are estimates, from events or from sketch rows of buckets.
    """
    replayed = levels_of if params.counter == "exact" else sketch_levels
    levels = without_banned(replayed(rows, params, last_tick), stoplist, ban)
    counts = each_tick(contenders(levels, params))
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("count"), F.asc("query")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= params.top_k).select("tick", "rank", "query", "count")


def each_tick(levels: DataFrame) -> DataFrame:
    return levels.select(F.explode(F.sequence("tick", "until")).alias("tick"), "query", "count")


def _step(at: str, change: int) -> Column:
    return F.struct(F.col(at).alias("tick"), F.lit(change).cast("bigint").alias("change"))
