from datetime import datetime, timedelta, timezone

import pytest

from hopboard.params import LIMIT_NOT_POSITIVE, LIMIT_TOO_LARGE, BoardParams, parse_top_limit


@pytest.mark.parametrize(
    "raw, limit", [("", 10), ("1", 1), ("100", 100), ("1000", 1000), ("+7", 7), ("007", 7)]
)
def test_limits_accepted(raw, limit):
    assert parse_top_limit(raw) == limit


@pytest.mark.parametrize("raw", ["abc", "-1", "0", "1.5", " ", "1 ", "٣", "9" * 30, "1\n"])
def test_limits_not_positive(raw):
    with pytest.raises(ValueError, match=LIMIT_NOT_POSITIVE):
        parse_top_limit(raw)


@pytest.mark.parametrize("raw", ["1001", "9999", str(2**63 - 1)])
def test_limits_too_large(raw):
    with pytest.raises(ValueError, match=LIMIT_TOO_LARGE):
        parse_top_limit(raw)


def test_defaults_replace_values_of_zero_or_less():
    assert BoardParams(0, -1, 0) == BoardParams()
    assert (BoardParams().window_sec, BoardParams().width_nanos) == (300, 10_000_000_000)


def test_window_shorter_than_its_buckets_is_refused():
    with pytest.raises(ValueError):
        BoardParams(window_nanos=29, bucket_count=30)


def test_unknown_counter_is_refused():
    with pytest.raises(ValueError):
        BoardParams(counter="bloom")


def test_live_range_ends_with_the_current_bucket():
    params = BoardParams.of(timedelta(seconds=30), 3)
    now = datetime.fromtimestamp(1_700_000_040, timezone.utc)
    assert params.live_range(now) == (170000002, 170000004)
    assert params.live_millis(now) == (1_700_000_020_000, 1_700_000_049_999)


def test_window_that_does_not_divide_covers_whole_buckets_only():
    params = BoardParams.of(timedelta(minutes=5), 7)
    assert params.width_nanos == 42_857_142_857
    first, last = params.live_millis(datetime(2024, 1, 1, tzinfo=timezone.utc))
    oldest, current = params.live_range(datetime(2024, 1, 1, tzinfo=timezone.utc))
    for millis, bucket in ((first, oldest), (first - 1, oldest - 1), (last, current), (last + 1, current + 1)):
        assert millis * 1_000_000 // params.width_nanos == bucket
