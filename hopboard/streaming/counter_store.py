"""Counters of a running job that no retry counts twice: one small table for each batch, summed when read.

A batch that is run again replaces its own counters. Those of earlier batches are folded into totals now and then: a
total says up to which batch it reaches, and readers add only later batches to the newest one, so that what is
folded may be deleted at any time. The last batch of a query is never folded, as it is the one that can come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.operators.ingest import CONSUMED, INVALID, NORM_DROPPED, OUT_OF_WINDOW
from hopboard.sources.storage import delete_tree, matching_paths

_COUNTERS = "outcome STRING, events BIGINT"


class CounterStore:
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, counts: DataFrame, batch: str) -> None:
        """Store (outcome, events) of a batch, whose name ends in its number."""
        query, number = batch.rsplit("-", 1)
        self._write(counts, query, "batch", int(number))

    def by_outcome(self, spark: SparkSession) -> DataFrame:
        """Events of each outcome over all batches so far."""
        counted = {query: self._current(tables) for query, tables in self._tables(spark).items()}
        return self._sum(spark, [path for paths in counted.values() for path in paths])

    def counters(self, spark: SparkSession) -> DataFrame:
        """One row: messages, consumed, decoded, invalid, norm_dropped, out_of_window; zeros before the first batch."""
        of = lambda *outcomes: F.coalesce(F.sum(F.when(F.col("outcome").isin(*outcomes), F.col("events"))), F.lit(0))
        return self.by_outcome(spark).agg(
            F.coalesce(F.sum("events"), F.lit(0)).alias("messages"),
            of(CONSUMED).alias("consumed"),
            of(CONSUMED, NORM_DROPPED, OUT_OF_WINDOW).alias("decoded"),
            of(INVALID).alias("invalid"),
            of(NORM_DROPPED).alias("norm_dropped"),
            of(OUT_OF_WINDOW).alias("out_of_window"),
        )

    def fold(self, spark: SparkSession) -> int:
        """Fold all but the last batch of each query into a total; returns the number of tables deleted."""
        deleted = 0
        for query, tables in self._tables(spark).items():
            numbers = sorted(number for kind, number in tables if kind == "batch")
            if len(numbers) > 1:
                upto = {key: path for key, path in tables.items() if key[1] < numbers[-1]}
                self._write(self._sum(spark, self._current(upto)), query, "total", numbers[-2])
                tables = self._tables(spark)[query]
            kept = set(self._current(tables))
            for path in tables.values():
                if path not in kept:
                    delete_tree(spark, path)
                    deleted += 1
        return deleted

    def _write(self, counts: DataFrame, query: str, kind: str, number: int) -> None:
        folder = f"{self.path}/query={query}/{kind}={number:012d}"
        counts.select("outcome", F.col("events").cast("bigint").alias("events")).coalesce(1).write.mode("overwrite").parquet(folder)

    def _tables(self, spark: SparkSession) -> dict[str, dict[tuple[str, int], str]]:
        """Complete tables by query, kind and number."""
        tables: dict[str, dict[tuple[str, int], str]] = {}
        for done in matching_paths(spark, f"{self.path}/query=*/*/_SUCCESS"):
            folder, query, name = done.rsplit("/", 1)[0], *done.split("/")[-3:-1]
            kind, number = name.split("=")
            tables.setdefault(query.removeprefix("query="), {})[kind, int(number)] = folder
        return tables

    @staticmethod
    def _current(tables: dict[tuple[str, int], str]) -> list[str]:
        """The newest total, and the batches after it."""
        reached = max((number for kind, number in tables if kind == "total"), default=-1)
        return [path for (kind, number), path in sorted(tables.items()) if number > reached or (kind, number) == ("total", reached)]

    def _sum(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        rows = spark.read.schema(_COUNTERS).parquet(*paths) if paths else spark.createDataFrame([], _COUNTERS)
        return rows.groupBy("outcome").agg(F.sum("events").alias("events"))
