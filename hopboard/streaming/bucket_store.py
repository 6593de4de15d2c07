"""Window state on shared storage: bucket rows partitioned by bucket and by the batch that wrote them.

A batch that is run again overwrites its own partitions only, so the state takes it once. Readers
name the live buckets in the path and list nothing else. Counts are unions, hence rows of one
query spread over several batches or written twice never add up to more.

Before a write, rows are brought together by bucket; Spark splits large buckets and merges small
ones, so that a batch leaves few files. Compaction folds the batches of a bucket into one. It writes
first and deletes the folded batches only after a grace period, so that readers who have listed them
can finish; until then both are there, which changes no count. A compaction that fails leaves at most
a copy of rows that are there anyway, and the next one folds again. A folded batch that is delivered
again after its deletion writes its rows once more, which changes no count either.

A sketch is stored with its estimate, and files are sorted by query: boards are cut by the estimates alone, and a scan
for some queries skips the pages of others. Rows stored without an estimate have a null one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.operators.counting import bucket_rows, merged_rows
from hopboard.params import BoardParams
from hopboard.sources.storage import age_seconds, create_marker, delete_tree, matching_paths

# Fixed value: file that marks a batch as folded into another. Spark does not read names with this first letter.
_FOLDED = "_FOLDED"
# Level of what a closed bucket is folded into, above those of any open one.
_CLOSED = 98


class BucketStore:
    def __init__(self, path: str, params: BoardParams) -> None:
        self.path = path.rstrip("/")
        self.params = params

    def write(self, accepted: DataFrame, batch: str) -> None:
        """Aggregate accepted events per bucket and store them under the name of the batch."""
        self._store(bucket_rows(accepted, self.params), batch)

    def read(self, spark: SparkSession, oldest: int, current: int) -> DataFrame:
        """Rows of the buckets from oldest to current; no rows where none of them has been written."""
        return self._rows(spark, [f"{self.path}/bucket_id={{{','.join(map(str, range(oldest, current + 1)))}}}"])

    def compact(
        self, spark: SparkSession, oldest: int, newest: int, grace_seconds: float = 600.0, open_from: int | None = None, fan: int = 10
    ) -> int:
        """Fold batches of each bucket from oldest to newest; returns the number of batches folded.

        Buckets before `open_from` (all, if it is not given) hardly change any more: each is folded into one batch. In
        the others a batch has a level, 0 as it comes in, and `fan` batches of a level are folded into one of the
        next, so that an open bucket holds few batches at any time and each row is written about once a level.
        Batches that come later are folded by the next call, which also deletes those folded longer ago than
        the grace period.
        """
        marked = set()
        for marker in matching_paths(spark, f"{self.path}/bucket_id=*/batch=*/{_FOLDED}"):
            folder = marker.rsplit("/", 1)[0]
            marked.add(folder)
            if oldest <= _bucket_of(folder) <= newest and age_seconds(spark, marker) >= grace_seconds:
                delete_tree(spark, folder)
        batches: dict[tuple[int, int], list[str]] = {}
        for folder in matching_paths(spark, f"{self.path}/bucket_id=*/batch=*"):
            bucket = _bucket_of(folder)
            if folder not in marked and oldest <= bucket <= newest:
                is_open = open_from is not None and bucket >= open_from
                batches.setdefault((bucket, _level_of(folder) if is_open else _CLOSED), []).append(folder)
        folding: dict[int, list[str]] = {}
        for (_, level), folders in batches.items():
            if len(folders) >= (2 if level == _CLOSED else fan):
                folding.setdefault(level, []).extend(folders)
        for level, folders in folding.items():
            self._store(merged_rows(self._rows(spark, folders)), f"compacted-{level + 1}-{uuid4().hex}")
            for folder in folders:
                create_marker(spark, f"{folder}/{_FOLDED}")
        return sum(map(len, folding.values()))

    def drop_before(self, spark: SparkSession, bucket_id: int) -> int:
        """Delete the buckets before this one and return how many there were."""
        expired = [path for path in matching_paths(spark, f"{self.path}/bucket_id=*") if _bucket_of(path) < bucket_id]
        for path in expired:
            delete_tree(spark, path)
        return len(expired)

    def _store(self, rows: DataFrame, batch: str) -> None:
        if self.params.counter == "hll":
            rows = rows.withColumn("estimate", F.hll_sketch_estimate("sketch"))
        (
            rows.hint("rebalance", "bucket_id")
            .sortWithinPartitions("bucket_id", "query")
            .withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket_id", "batch")
            .parquet(self.path)
        )

    def _rows(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        state = "source STRING" if self.params.counter == "exact" else "sketch BINARY, estimate BIGINT"
        schema = f"query STRING, {state}, bucket_id BIGINT, batch STRING"
        try:
            stored = spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = spark.createDataFrame([], schema)
        return stored.drop("batch")


def _level_of(path: str) -> int:
    name = path.split("/batch=", 1)[1]
    return int(name.split("-")[1]) if name.startswith("compacted-") else 0


def _bucket_of(path: str) -> int:
    return int(path.split("bucket_id=", 1)[1].split("/", 1)[0])
