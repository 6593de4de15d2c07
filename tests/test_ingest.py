from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hopboard.operators.ingest import accepted, ingest, outcome_counts, quarantined, valid_events
from hopboard.params import BoardParams

NOW = datetime(2024, 5, 1, 12, 0, 3, tzinfo=timezone.utc)
NOW_MS = int(NOW.timestamp()) * 1000
PARAMS = BoardParams(counter="exact")


def message(query='"iphone 15"', source='"u1"', ts_ms=NOW_MS):
    return f'{{"query":{query},"source":{source},"ts_ms":{ts_ms}}}'


CASES = [
    (message(), "consumed", None),
    (message('"  iPhone  15  "'), "consumed", None),
    (message(source='" "'), "consumed", None),
    ("{bad}", "invalid", "malformed json"),
    ('{"query":"a","ts_ms":1}', "invalid", "missing source"),
    ('{"query":"a","source":"s"}', "invalid", "missing or invalid ts_ms"),
    ('{"source":"s","ts_ms":1}', "invalid", "empty query"),
    (message('""', '""', 0), "invalid", "empty query"),
    (message(source='""', ts_ms=0), "invalid", "missing source"),
    (message(ts_ms=0), "invalid", "missing or invalid ts_ms"),
    (message(ts_ms=-1), "invalid", "missing or invalid ts_ms"),
    ("null", "invalid", "empty query"),
    (message('"   "'), "norm_dropped", None),
    (message('"' + "a" * 257 + '"'), "norm_dropped", None),
    (message('"   "', ts_ms=1), "norm_dropped", None),
    (message(ts_ms=NOW_MS - 600_000), "out_of_window", None),
    (message(ts_ms=NOW_MS + 600_000), "out_of_window", None),
    (message(ts_ms=2**63 - 1), "out_of_window", None),
    (message(ts_ms=NOW_MS + 6_999), "consumed", None),
    (message(ts_ms=NOW_MS + 7_000), "out_of_window", None),
    (message(ts_ms=NOW_MS - 293_000), "consumed", None),
    (message(ts_ms=NOW_MS - 293_001), "out_of_window", None),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(CASES)], "id INT, value STRING")


@pytest.fixture(params=["instant", "column"])
def classified(request, messages):
    arrival = NOW if request.param == "instant" else F.timestamp_millis(F.lit(NOW_MS))
    return ingest(messages, PARAMS, arrival)


def test_each_message_has_one_outcome(classified):
    for row in classified.collect():
        text, outcome, reason = CASES[row["id"]]
        assert (row["outcome"], row["reject_reason"]) == (outcome, reason), text


def test_counters_add_up(classified):
    counts = outcome_counts(classified).first()
    assert counts["messages"] == len(CASES) == counts["decoded"] + counts["invalid"]
    assert counts["decoded"] == counts["norm_dropped"] + counts["out_of_window"] + counts["consumed"]
    assert counts["consumed"] == sum(outcome == "consumed" for _, outcome, _ in CASES)


def test_accepted_and_quarantined_rows_are_complementary(classified):
    taken = accepted(classified)
    assert taken.columns == ["bucket_id", "query", "source"]
    assert {row["query"] for row in taken.collect()} == {"iphone 15"}
    assert taken.count() + quarantined(classified).count() == len(CASES)


def test_source_is_kept_as_given(classified):
    assert " " in {row["source"] for row in accepted(classified).collect()}


def test_valid_events_skip_the_window_check_only(spark):
    events = spark.createDataFrame(
        [("A", "s", 1, None), ("b", "s", NOW_MS, None), (" ", "s", 1, None), ("c", "", 1, None),
         ("d", "s", 0, None), ("e", "s", 2**63 - 1, None), (None, "s", 1, None)],
        "query STRING, source STRING, ts_ms BIGINT, event_id STRING",
    )
    got = {(row["bucket_id"], row["query"]) for row in valid_events(events, PARAMS).collect()}
    assert got == {(0, "a"), (NOW_MS // 10_000, "b")}


def test_window_that_does_not_divide(spark):
    params = BoardParams.of(timedelta(minutes=5), 7, counter="exact")
    first, last = params.live_millis(NOW)
    rows = spark.createDataFrame([(message(ts_ms=at),) for at in (first - 1, first, last, last + 1)], "value STRING")
    outcomes = [row["outcome"] for row in ingest(rows, params, NOW).collect()]
    assert outcomes == ["out_of_window", "consumed", "consumed", "out_of_window"]


def test_time_zone_of_the_session_does_not_matter(spark, messages):
    before = {row["id"]: row["outcome"] for row in ingest(messages, PARAMS, F.timestamp_millis(F.lit(NOW_MS))).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shifted = ingest(messages, PARAMS, F.timestamp_millis(F.lit(NOW_MS))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {row["id"]: row["outcome"] for row in shifted} == before
