"""Files as source and sink of messages: one JSON text per line, or a parquet column `value`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopboard.sources.kafka import to_messages

_MESSAGE = "value STRING"


def read_messages(spark: SparkSession, path: str, file_format: str = "text") -> DataFrame:
    return spark.read.format(file_format).schema(_MESSAGE).load(path)


def stream_messages(
    spark: SparkSession, path: str, file_format: str = "text", max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(_MESSAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def write_events(events: DataFrame, path: str, file_format: str = "text", mode: str = "append") -> None:
    to_messages(events).write.format(file_format).mode(mode).save(path)
