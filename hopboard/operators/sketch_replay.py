"""Replay of a whole history from sketches, which can be united but not taken apart again.

Buckets are cut into blocks as long as the window. The window of a tick is then the end of one block and the start
of the next: a suffix and a prefix. Both are running unions within a block, one step for each bucket a query
occurs in, so that a tick costs one union of two sketches however many buckets its window has, and no sketch is copied
to the ticks it counts in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopboard.operators.counting import bucket_sketches, merged_rows
from hopboard.params import BoardParams


def sketch_levels(rows: DataFrame, params: BoardParams, last_tick: Column | int | None = None) -> DataFrame:
    """Stretches of ticks (query, tick, until, count) in which a query's estimate stays the same.

    Takes events (bucket_id, query, source) or sketch rows of buckets. A suffix that begins with bucket b
    serves the ticks from B after the bucket before b up to B - 1 after b; a prefix that ends with bucket b serves the
    ticks from b on. What serves a tick is the last of either kind to begin; a suffix of nothing begins once the last
    bucket of a block has left the window. The last tick defaults to that of the newest bucket, which costs a
    scan of the bucket ids; a caller who knows it gives it.
    """
    sketches = merged_rows(rows) if "sketch" in rows.columns else bucket_sketches(rows, params)
    if last_tick is None:
        last_tick = rows.agg(F.max("bucket_id")).scalar()
    elif isinstance(last_tick, int):
        last_tick = F.lit(last_tick).cast("bigint")
    size = params.bucket_count
    block = F.floor(F.col("bucket_id") / size).cast("bigint")
    in_block = sketches.select("query", "bucket_id", "sketch", block.alias("block"))
    forward = Window.partitionBy("query", "block").orderBy("bucket_id")
    backward = Window.partitionBy("query", "block").orderBy(F.desc("bucket_id"))
    to_here = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unions = in_block.select(
        "query", "block", "bucket_id",
        F.hll_union_agg("sketch").over(to_here(forward)).alias("prefix"),
        F.hll_union_agg("sketch").over(to_here(backward)).alias("suffix"),
        F.lag("bucket_id").over(forward).alias("earlier"),
        F.lead("bucket_id").over(forward).alias("later"),
    )
    # A suffix begins in the next block, the first one with the block itself. That of a block's first bucket never
    # serves: it would be the whole block, which is the prefix at the block's last tick.
    suffix_from = F.coalesce(F.col("earlier") + size, (F.col("block") + 1) * size)
    nothing = F.lit(None).cast("binary")
    begins = F.array(
        _begin(F.col("block"), F.col("bucket_id"), prefix=F.col("prefix")),
        F.when(suffix_from < F.col("bucket_id") + size, _begin(F.col("block") + 1, suffix_from, suffix=F.col("suffix"))),
        F.when(F.col("later").isNull(), _begin(F.col("block") + 1, F.col("bucket_id") + size, suffix=nothing)),
    )
    steps = unions.select("query", F.inline(F.filter(begins, lambda begin: begin.isNotNull())))
    # Begins at one tick are one step. A block has at most one prefix and one suffix that begins at a tick.
    at_tick = steps.groupBy("query", "block", "tick").agg(
        F.any_value("prefix", True).alias("prefix"), F.any_value("suffix", True).alias("suffix")
    )
    so_far = to_here(Window.partitionBy("query", "block").orderBy("tick"))
    serving = at_tick.select(
        "query", "tick",
        F.last("prefix", True).over(so_far)["sketch"].alias("prefix"),
        F.last("suffix", True).over(so_far)["sketch"].alias("suffix"),
    )
    both = F.coalesce(F.hll_union("prefix", "suffix"), "prefix", "suffix")
    counts = serving.select("query", "tick", F.coalesce(F.hll_sketch_estimate(both), F.lit(0)).alias("count"))
    until = F.lead("tick").over(Window.partitionBy("query").orderBy("tick")) - 1
    levels = counts.withColumn("until", F.least(until, last_tick))
    return levels.where((F.col("count") > 0) & (F.col("tick") <= F.col("until"))).select("query", "tick", "until", "count")


def _begin(block: Column, tick: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """Start of service of a prefix or suffix; a null struct says nothing of that kind begins here."""
    held = "struct<sketch: binary>"
    sketch = lambda column: F.lit(None).cast(held) if column is None else F.struct(column.alias("sketch"))
    return F.struct(block.alias("block"), tick.alias("tick"), sketch(prefix).alias("prefix"), sketch(suffix).alias("suffix"))
