"""From raw messages to classified events: every message ends in exactly one outcome."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopboard.functions.buckets import bucket_of_millis, bucket_of_timestamp, in_live_range
from hopboard.functions.messages import decode_events
from hopboard.functions.selecting import keep_where
from hopboard.functions.text import with_normalized
from hopboard.params import BoardParams

# Outcomes of a message and reasons for refusing one, in the order they are checked.
INVALID = "invalid"
NORM_DROPPED = "norm_dropped"
OUT_OF_WINDOW = "out_of_window"
CONSUMED = "consumed"
REASON_JSON = "malformed json"
REASON_QUERY = "empty query"
REASON_SOURCE = "missing source"
REASON_TIME = "missing or invalid ts_ms"


def reject_reason(well_formed: Column | None = None) -> Column:
    """First rule an event breaks, or NULL. A missing field counts as an empty one."""
    well_formed = F.lit(True) if well_formed is None else well_formed
    return (
        F.when(~well_formed, REASON_JSON)
        .when(F.coalesce(F.col("query"), F.lit("")) == "", REASON_QUERY)
        .when(F.coalesce(F.col("source"), F.lit("")) == "", REASON_SOURCE)
        .when(F.coalesce(F.col("ts_ms"), F.lit(0)) <= 0, REASON_TIME)
    )


def classify(events: DataFrame, params: BoardParams, arrival: Column | datetime) -> DataFrame:
    """Add `reject_reason`, `norm_query`, `bucket_id` and `outcome` to decoded events.

    `arrival` is the clock an event is judged by when it comes in: a column, or one instant for all.
    Both late events and those ahead of the current bucket are out of the window.
    """
    well_formed = F.col("well_formed") if "well_formed" in events.columns else None
    if isinstance(arrival, datetime):
        current = F.lit(params.bucket_at(arrival)).cast("bigint")
    else:
        current = bucket_of_timestamp(arrival, params)
    admitted = F.coalesce(in_live_range(F.col("bucket_id"), current, params), F.lit(False))
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), INVALID)
        .when(F.col("norm_query").isNull(), NORM_DROPPED)
        .when(~admitted, OUT_OF_WINDOW)
        .otherwise(CONSUMED)
    )
    judged = events.withColumn("reject_reason", reject_reason(well_formed)).withColumn(
        "bucket_id", F.when(F.col("reject_reason").isNull(), bucket_of_millis(F.col("ts_ms"), params))
    )
    valid_query = F.when(F.col("reject_reason").isNull(), F.col("query"))
    return with_normalized(judged, valid_query, "norm_query").withColumn("outcome", outcome)


def ingest(messages: DataFrame, params: BoardParams, arrival: Column | datetime, value: str = "value") -> DataFrame:
    return classify(decode_events(messages, value), params, arrival)


def accepted(classified: DataFrame) -> DataFrame:
    """What goes into the window: bucket, normalised query and source of each consumed event."""
    query = F.col("norm_query").alias("query")
    return keep_where(classified, F.col("outcome") == CONSUMED, "bucket_id", query, "source")


def valid_events(events: DataFrame, params: BoardParams) -> DataFrame:
    """Same rows for typed events that are all admitted, as in a replay of history."""
    valid = events.where(reject_reason().isNull()).withColumn("bucket_id", bucket_of_millis(F.col("ts_ms"), params))
    normalized = with_normalized(valid, F.col("query"), "norm_query")
    kept = F.col("norm_query").isNotNull() & F.col("bucket_id").isNotNull()
    return keep_where(normalized, kept, "bucket_id", F.col("norm_query").alias("query"), "source")


def quarantined(classified: DataFrame) -> DataFrame:
    """Messages that did not make it into the window, with the outcome and reason."""
    return keep_where(classified, F.col("outcome") != CONSUMED, *classified.columns)


def outcome_counters() -> list[Column]:
    """Aggregates for one pass over classified events; they also serve `DataFrame.observe`."""
    counted = {
        "consumed": F.col("outcome") == CONSUMED,
        "decoded": F.col("outcome") != INVALID,
        "invalid": F.col("outcome") == INVALID,
        "norm_dropped": F.col("outcome") == NORM_DROPPED,
        "out_of_window": F.col("outcome") == OUT_OF_WINDOW,
    }
    return [
        F.count(F.lit(1)).alias("messages"),
        *[F.count_if(condition).alias(name) for name, condition in counted.items()],
    ]


def outcome_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(*outcome_counters())
