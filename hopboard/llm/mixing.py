"""Mixing of sources to target weights, as DataFrame operations only.

Targets: sources weigh in turn and share all words; a target stops at a multiple of its source's words and
the excess goes to the others by weight. Documents of a source are laid out in an order drawn by hash and
cut into blocks of equal length, numbered from 0. A source's target is so many slots, each to hold one block.

Every output shard draws its slots by themselves, each for a source with the chance of the source's share of all
slots, so the counts of the sources in a shard are multinomial. What all shards have drawn is a source's number of
slots, unless it is further from the target than one slot in SPARE, or beyond the passes allowed: then the counts of its
shards are scaled to that limit. The slots of a source run through its blocks in passes, each pass in the order of a
permutation of the block numbers that is drawn for it: rounds that mirror a number at a drawn place or leave it, by
a hash of the pair (swap-or-not). Joining slots with blocks by number gives the mix.

Positions in a source are sums over chunks of the order and within a chunk, each of about the square root of
all rows, so that no task orders a whole source; rows that are equal, however many, are dealt into as many parts. The
table of sources is one row per source, and that of a source's shards one row per shard; single tasks go through these.

Defined cases: sources are ordered by code point, null last, and null is a source. Null or blank texts have
size 0 and are never taken. A source without words has target 0. Repeated rows are documents of their own.
An empty input gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopboard.llm.common import written

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 8192
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = 42

# Slots from its target that a source's drawn slots may be away, as a part of the target.
SPARE = 500
# Slots that a task fills.
SLOTS_PER_TASK = 1 << 17
# Rounds of a permutation, and stretches that the draw of a source is looked up in.
ROUNDS = 24
STRETCHES = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Mix:
    """`sources` with targets; `slots` (source_no, index, shard, slot); `pieces` of documents in blocks; `documents`."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """One row per source with source_no, weight and target, for rows (source, size)."""
    everything = Window.partitionBy()
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    rows = sums.withColumn("source_no", number).withColumn("weight", weight).withColumn("most", (passes * F.col("source_size")).cast("double"))
    # By rising limit per weight: a source is held at its limit if it could have more than that of what is left.
    rising = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / left
    rows = rows.withColumn("level", level).withColumn("held", F.col("most") <= F.col("weight") * F.col("level"))
    shared = F.max(F.when(~F.col("held"), F.col("level"))).over(everything)
    target = F.when(F.col("held"), F.col("most")).otherwise(F.col("weight") * shared)
    return rows.select("source", "source_no", "weight", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    columns: list[str],
    block_words: int = BLOCK_WORDS,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = SEED,
) -> Mix:
    """The mix of documents (source, text, and `columns` to pass on)."""
    passed = [name for name in columns if name not in ("size", "source_size", "target", "taken")]
    units = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"), F.struct(*passed).alias("row"), F.col("source").alias("source"),
            word_count("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
        ),
        "units",
    )
    sources = written(_with_slots(source_targets(units.select("source", "size")), block_words), "sources")
    numbered = units.select("row_no", "source", "size", "draw").where("size > 0").join(
        sources.select(F.col("source").alias("of"), "source_no"), F.col("source").eqNullSafe(F.col("of"))
    )
    pieces = _pieces(_positions(numbered, units.count()), block_words)
    slots = _slots(sources, slots_per_shard, seed)
    # Slots come from few rows, which Spark takes for a small table; both sides grow with the input.
    taken = (
        slots.hint("merge").join(pieces, (slots["source_no"] == pieces["source_no"]) & (slots["index"] == pieces["block"]))
        .groupBy("row_no").agg(F.sum("words").alias("taken"))
    )
    facts = sources.select(F.col("source").alias("of"), "source_size", "target")
    documents = (
        units.select("row_no", "row", "source", "size").join(taken, "row_no", "left")
        .join(facts, F.col("source").eqNullSafe(F.col("of")))
        .select(*[F.col(f"row.`{name}`").alias(name) for name in passed], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
    return Mix(sources, slots, pieces, documents)


def _with_slots(targets: DataFrame, block_words: int) -> DataFrame:
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    return targets.withColumn("blocks", blocks).withColumn("slots", slots.cast("bigint"))


def _positions(units: DataFrame, rows: int) -> DataFrame:
    """Where each document starts among the words of its source: by chunk, draw, part and row."""
    chunks = max(1, ceil(sqrt(rows)))
    dealt = units.withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(chunks)))
    # Equal rows have equal draws; their parts may come in any order, as they are alike.
    parts = dealt.groupBy("source_no", "draw", "part").agg(F.sum("size").alias("words")).withColumn("chunk", F.pmod("draw", F.lit(chunks)))
    before = lambda window: F.coalesce(F.sum("words").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_chunk = before(Window.partitionBy("source_no", "chunk").orderBy("draw", "part"))
    sums = parts.groupBy("source_no", "chunk").agg(F.sum("words").alias("words"))
    starts = sums.select("source_no", "chunk", before(Window.partitionBy("source_no").orderBy("chunk")).alias("chunk_start"))
    part_starts = parts.select("source_no", "chunk", "draw", "part", in_chunk.alias("part_start")).join(starts, ["source_no", "chunk"]).select(
        "source_no", "draw", "part", (F.col("chunk_start") + F.col("part_start")).alias("part_start")
    )
    within = Window.partitionBy("source_no", "draw", "part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(part_starts, ["source_no", "draw", "part"])
        .select("row_no", "source_no", "size", (F.col("part_start") + F.col("offset")).alias("start"))
    )


def _pieces(positions: DataFrame, block_words: int) -> DataFrame:
    first = F.expr(f"start div {block_words}")
    last = F.expr(f"(start + size - 1) div {block_words}")
    low, high = F.col("block") * block_words, (F.col("block") + 1) * block_words
    stop = F.col("start") + F.col("size")
    return positions.withColumn("block", F.explode(F.sequence(first, last))).select(
        "row_no", "source_no", "block",
        (F.greatest(low, F.col("start")) - F.col("start")).alias("from_word"),
        (F.least(high, stop) - F.greatest(low, F.col("start"))).alias("words"),
    )


def _drawn(sources: DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """Slots of each source that each shard draws (source_no, shard, n): independent draws, counted."""
    known = sources.agg(F.sum("slots").alias("slots"), F.count(F.lit(1)).alias("sources")).first()
    total = known["slots"] or 0
    width = max(1, ceil(total / max(STRETCHES, 4 * known["sources"])))
    # Each source is a range of numbers; a drawn number is looked up in the stretch that it falls into.
    high = F.sum("slots").over(Window.partitionBy().orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sources.select("source_no", "slots", high.alias("high")).where("slots > 0").withColumn("low", F.col("high") - F.col("slots"))
    stretches = ranges.select("source_no", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("stretch"))
    spark = sources.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, ceil(total / (1 << 22)))
    draws = spark.range(0, total, 1, tasks).select(
        F.expr(f"id div {slots_per_shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("number")
    )
    found = draws.withColumn("stretch", F.expr(f"number div {width}")).join(stretches, "stretch").where("low <= number AND number < high")
    return found.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("n"))


def _slots(sources: DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """Slots of all sources (source_no, slot, index, shard), those of a shard next to each other."""
    drawn = written(_drawn(sources, slots_per_shard, seed), "drawn")
    totals = drawn.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    spare = F.expr(f"slots div {SPARE}")
    most = F.least(F.col("slots") + spare, F.col("blocks") * MAX_PASSES)
    held = F.greatest(F.least(F.coalesce("drawn", F.lit(0)), most), F.col("slots") - spare)
    limits = sources.where("slots > 0").join(totals, "source_no", "left").select("source_no", "blocks", "drawn", held.alias("held"))
    # A source that no shard has drawn goes to one by hash.
    shards = F.greatest(F.lit(1), F.ceil(F.sum("held").over(Window.partitionBy()) / slots_per_shard))
    unseen = limits.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "source_no"), shards)).where("drawn IS NULL").select(
        "source_no", "blocks", "shard", F.lit(0).cast("bigint").alias("first"), F.col("held").alias("stop")
    )
    upto = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))
    scaled = lambda place: F.expr(f"CAST({place} AS DECIMAL(19, 0)) * CAST(held AS DECIMAL(19, 0)) div CAST(drawn AS DECIMAL(19, 0))")
    runs = drawn.withColumn("upto", upto).join(limits.where("drawn IS NOT NULL"), "source_no").select(
        "source_no", "blocks", "shard", scaled("(upto - n)").alias("first"), scaled("upto").alias("stop")
    )
    # Runs are small rows that become many slots; Spark would put them together by their size as they are.
    total = sources.agg(F.sum("slots")).first()[0] or 0
    tasks = max(sources.sparkSession.sparkContext.defaultParallelism, ceil(total / SLOTS_PER_TASK))
    each = runs.unionByName(unseen).where("first < stop").repartition(tasks, "source_no", "shard")
    slots = each.select("source_no", "blocks", "shard", F.explode(F.expr("sequence(first, stop - 1)")).alias("slot"))
    index = _permuted(F.expr("slot % blocks"), F.col("blocks"), [F.lit(seed), F.col("source_no"), F.expr("slot div blocks")])
    return slots.select("source_no", "slot", index.alias("index"), "shard")


def _permuted(number: Column, n: Column, key: list[Column]) -> Column:
    """A permutation of 0 to n - 1 that the key draws.

    In each round the numbers pair up, a with drawn - a modulo n, and a pair swaps or not by a hash of its larger one.
    """

    def swapped(at: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, turn), n) - at, n)
        return F.when(F.xxhash64(*key, turn, F.greatest(at, other)) % 2 == 0, at).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), number.cast("bigint"), swapped)
