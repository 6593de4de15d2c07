"""Stop-list on shared storage: every change writes a new version, readers take the newest complete one.

A version is a folder of its own that counts once Spark has marked it complete, so a reader of an
older version is not disturbed and a failed change leaves the list as it was. Versions are numbered and
claimed before they are written: of two writers that start from the same version one fails instead of
undoing the other's change. A failed writer gives its claim back; the claim of one that died counts as
given back after `stale_seconds`, which must be longer than any change takes: a writer that is slower still would
share its folder with the next one. Claims need a file system that creates a file only where there is none, as
HDFS and local disks do; on object stores without that, run one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.functions.text import normalize_query
from hopboard.operators.stoplist import active_words, change_statuses, changed_table, delete_words, merged_words, normalized_changes, sorted_words
from hopboard.sources.stopwords import STOPWORD_SCHEMA
from hopboard.sources.storage import age_seconds, create_marker, delete_tree, matching_paths


class StoplistStore:
    """`active` is a stop-list provider for the rebuilding job, which calls it anew at every tick."""

    def __init__(self, spark: SparkSession, path: str, stale_seconds: float = 3600.0) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.stale_seconds = stale_seconds

    def table(self) -> DataFrame:
        """Words as stored, with the time each was added; none before the first change."""
        versions = self._versions()
        if versions:
            return self.spark.read.schema(STOPWORD_SCHEMA).parquet(versions[-1])
        return self.spark.createDataFrame([], STOPWORD_SCHEMA)

    def active(self) -> DataFrame:
        return active_words(self.table())

    def list(self) -> DataFrame:
        return sorted_words(self.table())

    def replace(self, table: DataFrame) -> None:
        """Write (word, created_at) as the next version."""
        versions = self._versions()
        number = int(versions[-1].rsplit("=", 1)[1]) + 1 if versions else 1
        claim, folder = f"{self.path}/claim={number:012d}", f"{self.path}/version={number:012d}"
        for old in matching_paths(self.spark, claim):
            if age_seconds(self.spark, old) >= self.stale_seconds:
                delete_tree(self.spark, claim)
        create_marker(self.spark, claim)
        try:
            rows = table.select("word", F.col("created_at").cast("timestamp").alias("created_at"))
            rows.write.mode("overwrite").parquet(folder)
        except Exception:
            delete_tree(self.spark, claim)
            raise

    def add(self, words: DataFrame, created_at: Column | None = None) -> DataFrame:
        """Add words; returns the normalised ones as added or conflict, others as given and invalid."""
        before = self.table()
        time = F.current_timestamp() if created_at is None else created_at
        self.replace(merged_words(before, words, time).where("status <> 'conflict'"))
        added = active_words(words).join(before.select("word"), "word", "left_anti")
        conflicts = active_words(words).join(before.select("word"), "word", "left_semi")
        invalid = words.where(normalize_query(F.col("word")).isNull()).select("word").distinct()
        status = lambda frame, text: frame.select("word", F.lit(text).alias("status"))
        return status(added, "added").unionByName(status(conflicts, "conflict")).unionByName(status(invalid, "invalid"))

    def remove(self, words: DataFrame) -> None:
        self.replace(delete_words(self.table(), words))

    def apply(self, changes: DataFrame) -> DataFrame:
        """Apply a change log (seq, op, word, changed_at) and return the outcome of each change."""
        before, log = self.table(), normalized_changes(changes)
        self.replace(changed_table(before, log))
        return change_statuses(before, log)

    def keep_newest(self, count: int) -> int:
        """Delete all but the newest versions, and claims and what failed changes have left before them."""
        if count < 1:
            raise ValueError("at least one version must be kept")
        versions = self._versions()
        if len(versions) <= count:
            return 0
        first_kept = versions[-count].rsplit("=", 1)[1]
        old = [p for p in matching_paths(self.spark, f"{self.path}/version=*") if p.rsplit("=", 1)[1] < first_kept]
        claims = [p for p in matching_paths(self.spark, f"{self.path}/claim=*") if p.rsplit("=", 1)[1] < first_kept]
        for path in old + claims:
            delete_tree(self.spark, path)
        return len(old)

    def _versions(self) -> list[str]:
        done = matching_paths(self.spark, f"{self.path}/version=*/_SUCCESS")
        return [path.rsplit("/", 1)[0] for path in done]
