"""Job parameters and the checks made on them before a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

NANOS_PER_MILLI = 1_000_000
NANOS_PER_SECOND = 1_000_000_000

# Defaults and limits a caller of the board relies on.
DEFAULT_WINDOW_NANOS = 300 * NANOS_PER_SECOND
DEFAULT_BUCKET_COUNT = 30
DEFAULT_TOP_K = 1000
DEFAULT_TOP_LIMIT = 10
MAX_TOP_LIMIT = 1000
LIMIT_NOT_POSITIVE = "parameter 'n' must be a positive integer"
LIMIT_TOO_LARGE = "parameter 'n' must not exceed 1000"

_INTEGER = re.compile(r"[+-]?[0-9]+")
_INT64_MAX = 2**63 - 1


@dataclass(frozen=True)
class BoardParams:
    """Window length, number of buckets in it, ranking depth and kind of distinct counter.

    Values of zero or less take the default, as a caller who leaves them out would get.
    """

    window_nanos: int = DEFAULT_WINDOW_NANOS
    bucket_count: int = DEFAULT_BUCKET_COUNT
    top_k: int = DEFAULT_TOP_K
    counter: str = "hll"
    lg_k: int = 14

    def __post_init__(self) -> None:
        if self.window_nanos <= 0:
            object.__setattr__(self, "window_nanos", DEFAULT_WINDOW_NANOS)
        if self.bucket_count <= 0:
            object.__setattr__(self, "bucket_count", DEFAULT_BUCKET_COUNT)
        if self.top_k <= 0:
            object.__setattr__(self, "top_k", DEFAULT_TOP_K)
        if self.counter not in ("exact", "hll"):
            raise ValueError(f"counter must be 'exact' or 'hll', not {self.counter!r}")
        if not 4 <= self.lg_k <= 21:
            raise ValueError("lg_k must be between 4 and 21")
        if self.width_nanos == 0:
            raise ValueError("window is shorter than one nanosecond per bucket")

    @classmethod
    def of(cls, window: timedelta, bucket_count: int = 0, top_k: int = 0, **kwargs) -> BoardParams:
        micros = window // timedelta(microseconds=1)
        return cls(micros * 1000, bucket_count, top_k, **kwargs)

    @property
    def width_nanos(self) -> int:
        """Bucket width, rounded down; the buckets then cover bucket_count widths, not window_nanos."""
        return self.window_nanos // self.bucket_count

    @property
    def window_sec(self) -> int:
        return self.window_nanos // NANOS_PER_SECOND

    def bucket_at(self, instant: datetime) -> int:
        return epoch_micros(instant) * 1000 // self.width_nanos

    def live_range(self, instant: datetime) -> tuple[int, int]:
        """Oldest and newest bucket id that count at this instant."""
        current = self.bucket_at(instant)
        return current - (self.bucket_count - 1), current

    def live_millis(self, instant: datetime) -> tuple[int, int]:
        """First and last event time in whole milliseconds that falls in a live bucket."""
        oldest, current = self.live_range(instant)
        first = -(-oldest * self.width_nanos // NANOS_PER_MILLI)
        last = ((current + 1) * self.width_nanos - 1) // NANOS_PER_MILLI
        return first, last


def epoch_micros(instant: datetime) -> int:
    """Microseconds since 1970; an instant without a zone is taken as UTC."""
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return (instant - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def parse_top_limit(raw: str) -> int:
    """Read the row limit of a top request: empty means 10, allowed are 1 to 1000."""
    if raw == "":
        return DEFAULT_TOP_LIMIT
    if not _INTEGER.fullmatch(raw) or not 1 <= int(raw) <= _INT64_MAX:
        raise ValueError(LIMIT_NOT_POSITIVE)
    if int(raw) > MAX_TOP_LIMIT:
        raise ValueError(LIMIT_TOO_LARGE)
    return int(raw)
