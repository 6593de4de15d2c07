"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Write partitions of the advised size rather than one per core.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Sketches of this many groups stay in a hash map before a task falls back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Accept unknown fields that hold the same key twice.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
