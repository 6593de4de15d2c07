"""Published boards on shared storage: one folder each, complete once Spark has marked it so."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from hopboard.operators.ranking import as_document, as_snapshot, prefix, snapshot_items
from hopboard.params import BoardParams, epoch_micros, parse_top_limit
from hopboard.sources.storage import delete_tree, matching_paths

SNAPSHOT_SCHEMA = (
    "generated_at TIMESTAMP, window_sec INT, items ARRAY<STRUCT<rank: INT, query: STRING, count: BIGINT>>"
)


class SnapshotStore:
    def __init__(self, path: str, params: BoardParams) -> None:
        self.path = path.rstrip("/")
        self.params = params

    def publish(self, ranked: DataFrame, as_of: datetime) -> None:
        """Write a board as one row in a folder of its own; earlier boards stay readable meanwhile."""
        folder = f"{self.path}/generated_micros={epoch_micros(as_of):020d}"
        as_snapshot(ranked, self.params, as_of).coalesce(1).write.mode("overwrite").parquet(folder)

    def latest(self, spark: SparkSession, empty_as_of: datetime) -> DataFrame:
        """Newest complete board, or an empty one of the given time before the first is there."""
        done = matching_paths(spark, f"{self.path}/generated_micros=*/_SUCCESS")
        if done:
            return spark.read.schema(SNAPSHOT_SCHEMA).parquet(done[-1].rsplit("/", 1)[0])
        return as_snapshot(spark.createDataFrame([], "rank INT, query STRING, count BIGINT"), self.params, empty_as_of)

    def top(self, spark: SparkSession, limit: str, now: datetime) -> DataFrame:
        """First rows of the newest board; the limit is checked as in a top request."""
        return prefix(snapshot_items(self.latest(spark, now)), parse_top_limit(limit))

    def top_document(self, spark: SparkSession, limit: str, now: datetime) -> DataFrame:
        return as_document(self.latest(spark, now), parse_top_limit(limit))

    def keep_newest(self, spark: SparkSession, count: int) -> int:
        """Delete all but the newest complete boards, and unfinished ones older than the first kept; returns how many."""
        if count < 1:
            raise ValueError("at least one board must be kept")
        done = [path.rsplit("/", 1)[0] for path in matching_paths(spark, f"{self.path}/generated_micros=*/_SUCCESS")]
        if not done:
            return 0
        first_kept = done[-count:][0]
        old = [path for path in matching_paths(spark, f"{self.path}/generated_micros=*") if path < first_kept]
        for path in old:
            delete_tree(spark, path)
        return len(old)
