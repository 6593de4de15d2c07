"""Canonical names: queries that mean the same are counted under one name.

A table gives for some queries the name each stands under, which may stand under another in turn. Chains
are followed by pointer jumping: every round replaces a name by the name of that name, so that a chain of n takes
about log2 n rounds. A chain that leads into a circle has no end; its queries keep their own names and are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.functions.text import with_normalized
from hopboard.sources.storage import written

# A query with at least this share of the rows is joined by sending its name to all tasks; no more than HOT can be.
HOT = 10_000


def normalized_names(names: DataFrame) -> DataFrame:
    """Table of (query, canonical), both normalised, without invalid ones and queries that stand for themselves.

    A query with several names takes the smallest.
    """
    given = names.select(F.col("query").alias("_query"), F.col("canonical").alias("_canonical"))
    both = with_normalized(with_normalized(given, F.col("_query"), "query"), F.col("_canonical"), "canonical")
    valid = both.where("query IS NOT NULL AND canonical IS NOT NULL AND query <> canonical")
    return valid.groupBy("query").agg(F.min("canonical").alias("canonical"))


def resolved_names(names: DataFrame) -> DataFrame:
    """(query, canonical, cyclic) for each query of a normalised table, with the name at the end of its chain.

    Rounds double the steps that a pointer has taken. Pointers that have reached an end drop out, so a round joins
    only those still under way; a name that many queries stand under is looked up once, before they are joined with
    what it points to. While there is a chain longer than the steps taken, one of its queries is just near enough to
    the end to get there in the next round; once a round ends no pointer, those left go round in circles.
    """
    moving, ended = written(names.select("query", "canonical"), "names"), []
    while not moving.isEmpty():
        # Name after name, once for each: the end of a chain has none, or the pointer of a chain that has ended.
        ahead = moving.select(F.col("query").alias("canonical"), F.col("canonical").alias("next"))
        if ended:
            ends = ended[0]
            for more in ended[1:]:
                ends = ends.unionByName(more)
            done = ends.select(F.col("query").alias("canonical"), F.col("canonical").alias("next"), F.lit(True).alias("done"))
            ahead = ahead.withColumn("done", F.lit(False)).unionByName(done)
        else:
            ahead = ahead.withColumn("done", F.lit(False))
        looked_up = with_named(moving, ahead, "canonical")
        stepped = written(
            looked_up.select(
                "query",
                F.coalesce("next", "canonical").alias("canonical"),
                (F.col("next").isNull() | F.coalesce("done", F.lit(False))).alias("at_end"),
            ),
            "steps",
        )
        moving = stepped.where("NOT at_end").select("query", "canonical")
        at_end = stepped.where("at_end").select("query", "canonical")
        if at_end.isEmpty():
            break
        ended.append(at_end)
    circular = moving.select("query", F.col("query").alias("canonical"), F.lit(True).alias("cyclic"))
    for part in ended:
        circular = circular.unionByName(part.withColumn("cyclic", F.lit(False)))
    return circular


def with_named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows left-joined with a table that has each key at most once, whatever share of the rows a key holds.

    Keys are counted in the tasks first. The names of the at most HOT keys with a share of 1 / HOT or more are
    sent to all tasks; rows of other keys are brought together by key.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    frequent = counts.where(F.col("_n") * HOT >= total).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(written(frequent.join(names, key, "left"), "hot_names"))
    columns = [*rows.columns, *[name for name in names.columns if name != key]]
    here = rows.join(hot, key).select(*columns)
    rest = rows.join(hot.select(key), key, "left_anti").join(names, key, "left").select(*columns)
    return here.unionByName(rest)


def canonical_rows(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events or bucket rows with their queries under canonical names.

    Applied when a board is read, a change of names takes effect at once. Exact rows may repeat afterwards, which
    counts nothing twice; sketches under one name are united like those of several buckets.
    """
    names = resolved.where("NOT cyclic").select("query", F.col("canonical").alias("_name"))
    named = with_named(rows, names, "query")
    return named.select(*[F.coalesce("_name", "query").alias("query") if column == "query" else column for column in rows.columns])
