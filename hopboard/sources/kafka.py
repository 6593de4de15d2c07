"""Kafka as source and sink of search events. Needs the spark-sql-kafka package on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.functions.messages import encode_event

# What the event topic is called and how much one fetch asks for.
DEFAULT_TOPIC = "search.events"
MIN_FETCH_BYTES = 1
MAX_FETCH_BYTES = 1 << 20


def source_options(
    brokers: list[str],
    topic: str = DEFAULT_TOPIC,
    group_id: str | None = None,
    min_bytes: int = MIN_FETCH_BYTES,
    max_bytes: int = MAX_FETCH_BYTES,
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
    starting_offsets: str = "earliest",
) -> dict[str, str]:
    """Reader options. `min_partitions` splits large topic partitions over several tasks."""
    if not brokers:
        raise ValueError("at least one broker is needed")
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "kafka.fetch.min.bytes": str(min_bytes if min_bytes > 0 else MIN_FETCH_BYTES),
        "kafka.fetch.max.bytes": str(max_bytes if max_bytes > 0 else MAX_FETCH_BYTES),
    }
    if group_id:
        options["kafka.group.id"] = group_id
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a topic as they come in; key and headers are not used."""
    return spark.readStream.format("kafka").options(**options).load().select("value", "timestamp")


def read_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("kafka").options(**options).load().select("value", "timestamp")


def sink_options(brokers: list[str], topic: str = DEFAULT_TOPIC) -> dict[str, str]:
    if not brokers:
        raise ValueError("at least one broker is needed")
    return {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic}


def to_messages(events: DataFrame) -> DataFrame:
    return events.select(encode_event().alias("value"))


def write_events(events: DataFrame, options: dict[str, str]) -> None:
    to_messages(events).select(F.col("value")).write.format("kafka").options(**options).save()
