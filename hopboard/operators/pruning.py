"""Time ranges on typed events that reach the scan.

Bucket ids come from computed columns, and filters on these do not reach the files. A range on the
event's own time does: it keeps whole milliseconds of every bucket asked for and nothing else. Events
without a time are dropped, as they are in no bucket.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopboard.params import BoardParams


def in_window(events: DataFrame, params: BoardParams, as_of: datetime, time: str = "ts") -> DataFrame:
    """Events whose time lies in the window of an instant; the column is a timestamp with or without zone."""
    first, last = params.live_millis(as_of)
    return events.where(F.col(time).between(_literal(events, time, first, 0), _literal(events, time, last, 999)))


def before_window(events: DataFrame, params: BoardParams, as_of: datetime, time: str = "ts") -> DataFrame:
    """Events whose time lies before the window of an instant."""
    first, _ = params.live_millis(as_of)
    return events.where(F.col(time) < _literal(events, time, first, 0))


def _literal(events: DataFrame, time: str, millis: int, extra_micros: int) -> Column:
    """A time as a literal of the column's type; without zone it is taken as UTC."""
    if events.schema[time].dataType.typeName() == "timestamp":
        return F.timestamp_micros(F.lit(millis * 1000 + extra_micros))
    instant = datetime(1970, 1, 1) + timedelta(milliseconds=millis, microseconds=extra_micros)
    return F.expr(f"TIMESTAMP_NTZ'{instant.isoformat(sep=' ')}'")
