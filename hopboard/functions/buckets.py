"""Time bucket arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopboard.params import NANOS_PER_MILLI, BoardParams


def bucket_of_millis(millis: Column, params: BoardParams) -> Column:
    """Bucket id of an event time in epoch milliseconds; NULL where nanoseconds overflow a long."""
    nanos = F.try_multiply(millis, F.lit(NANOS_PER_MILLI).cast("bigint"))
    return _whole_quotient(nanos, params.width_nanos)


def bucket_of_timestamp(instant: Column, params: BoardParams) -> Column:
    """Bucket id of an instant; NULL where nanoseconds overflow a long, so that nothing is in its window."""
    nanos = F.try_multiply(F.unix_micros(instant), F.lit(1000).cast("bigint"))
    return _whole_quotient(nanos, params.width_nanos)


def in_live_range(bucket_id: Column, current: Column, params: BoardParams) -> Column:
    """True for the buckets that count when `current` is the bucket of the clock."""
    return bucket_id.between(current - (params.bucket_count - 1), current)


def _whole_quotient(dividend: Column, divisor: int) -> Column:
    return F.call_function("div", dividend, F.lit(divisor).cast("bigint"))
