"""Helpers that several operators of this folder share: written tables, grouped batches, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.sources.storage import shared_folder

HEAVY = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/llm/{uuid4().hex}/{name}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage is cut and survives lost executors.

    The files are the inputs of frames handed to the caller, so they stay until the shared folder is cleared.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def in_training(doc_id: str | Column) -> Column:
    """Whether labels of this document may be learned from: crc32 of its id as text modulo 4 is not 2."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def text_key(text: str | Column) -> Column:
    """Tells rows with the same id but other texts apart; null and empty texts differ."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(column, column.isNull())


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of the groups, from batches sorted by integer keys.

    Only the last, unfinished group of a batch is held back, so memory follows the largest group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[key].to_numpy() for key in keys]
        if held and all(held[-1][key][-1].as_py() == column[0] for key, column in zip(keys, columns)):
            change = _changes(columns)
            if not len(change):
                held.append(table)
                continue
            first = int(change[0])
            finished = pa.concat_tables([*held, table.slice(0, first)]).combine_chunks()
            yield finished, np.array([0, finished.num_rows])
            table, columns = table.slice(first), [column[first:] for column in columns]
        elif held:
            finished = pa.concat_tables(held).combine_chunks()
            yield finished, np.array([0, finished.num_rows])
        change = _changes(columns)
        last = int(change[-1]) if len(change) else 0
        if last:
            yield table.slice(0, last).combine_chunks(), np.concatenate([[0], change])
        held = [table.slice(last)]
    if held:
        finished = pa.concat_tables(held).combine_chunks()
        yield finished, np.array([0, finished.num_rows])


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    differs = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for column in columns:
        differs |= column[1:] != column[:-1]
    return np.flatnonzero(differs) + 1


def with_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """Rows joined (inner or left) with the facts on their key; `facts` is a written table with the `count` of rows of each key.

    A key may hold any share of the rows. No more than HEAVY keys can each have a share of 1 / HEAVY; the facts
    on these are sent to all tasks, so that only the rows of other keys are brought together by key.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY >= total
    hot = F.broadcast(facts.where(heavy))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(~heavy), key, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), as (node, root), for nodes that have a link.

    Each round sends every node to the neighbour (itself included) with the smallest pseudorandom
    number and links these targets instead, which keeps who reaches whom. Numbers are new in every
    round, so that a constant share of the nodes goes each time and long chains take few rounds. Minima
    are combined before the shuffle. A node with very many links makes a skewed join, which adaptive
    execution splits. Targets of all rounds are joined up at the end.
    """
    links = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        number = len(rounds)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda name: F.struct(F.xxhash64(F.lit(number), name).alias("draw"), F.col(name).alias("node"))
        nearest = both.groupBy("a").agg(F.min(ranked("b")).alias("near"))
        target = written(
            nearest.select(F.col("a").alias("node"), F.least(ranked("a"), F.col("near"))["node"].alias("target")), "targets"
        )
        rounds.append(target)
        links = written(
            links.join(target.select(F.col("node").alias("a"), F.col("target").alias("to_a")), "a")
            .join(target.select(F.col("node").alias("b"), F.col("target").alias("to_b")), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select("node", F.col("target").alias("root"))
    for target in rounds[1:]:
        step = target.select(F.col("node").alias("root"), F.col("target").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


class LocalSets:
    """Disjoint sets over the positions of one bounded block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
