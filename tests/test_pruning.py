from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hopboard.functions.buckets import bucket_of_millis, bucket_of_timestamp
from hopboard.operators.pruning import before_window, in_window
from hopboard.params import BoardParams

NOW = datetime(2024, 5, 1, 12, 0, 9, tzinfo=timezone.utc)


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMP_NTZ"])
@pytest.mark.parametrize("params", [BoardParams(counter="exact"), BoardParams.of(timedelta(minutes=5), 7, counter="exact")])
def test_ranges_agree_with_buckets(spark, params, kind):
    first, last = params.live_millis(NOW)
    millis = [None, 0, first - 1, first, first + 1, last - 1, last, last + 1, 2**41]
    rows = spark.createDataFrame([(ms,) for ms in millis], "ms LONG").withColumn("ts", F.timestamp_millis("ms").cast(kind))
    rows = rows.withColumn("bucket_id", bucket_of_millis(F.col("ms"), params))
    oldest, current = params.live_range(NOW)
    found = lambda frame: sorted(row["ms"] for row in frame.collect())
    assert found(in_window(rows, params, NOW)) == found(rows.where(F.col("bucket_id").between(oldest, current)))
    assert found(before_window(rows, params, NOW)) == found(rows.where(F.col("bucket_id") < oldest))


def test_far_instants_have_no_bucket(spark):
    row = spark.sql("SELECT TIMESTAMP'2300-01-01' AS far, TIMESTAMP'2024-01-01' AS near")
    got = row.select(bucket_of_timestamp(F.col("far"), BoardParams()), bucket_of_timestamp(F.col("near"), BoardParams())).first()
    assert got[0] is None and got[1] is not None
