"""What the physical plans must and must not contain."""

import pytest

from hopboard.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_top", "stoplist_stored"}))
def test_no_cross_join_and_no_python_worker(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "RoundRobin"):
        assert operator not in plan


def test_window_reaches_the_scan(spark):
    plan = plan_of(QUERIES["top_exact"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts,2024-01-13T18:00)" in plan
    assert "LessThanOrEqual(ts,2024-01-20T17:59:59.9" in plan
    assert "value" not in plan.split("ReadSchema")[1]


def test_cut_runs_in_every_task(spark):
    plan = plan_of(QUERIES["top_exact"](spark, SF_DIR))
    assert "TakeOrderedAndProject(limit=20" in plan
    assert "RangePartitioning" not in plan


def test_distinct_counting_spreads_one_query_over_many_tasks(spark):
    plan = plan_of(QUERIES["top_exact"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "hashpartitioning(query" in plan and "source" in plan.split("hashpartitioning(query")[2]


def test_ban_of_a_small_list_is_a_broadcast_and_of_a_large_one_is_not(spark):
    assert "BroadcastHashJoin" in plan_of(QUERIES["top_stoplist"](spark, SF_DIR))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["top_stoplist"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "LeftAnti" in plan


def test_message_is_parsed_once(spark):
    plan = plan_of(QUERIES["top_from_messages"](spark, SF_DIR))
    assert plan.count("from_json(ArrayType") <= 1


def test_replay_keeps_the_first_k_before_the_shuffle(spark):
    plan = plan_of(QUERIES["hopping_top"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_old_buckets_are_read_by_time(spark):
    plan = plan_of(QUERIES["expired_buckets"](spark, SF_DIR))
    assert "LessThan(ts,2024-01-13T18:00)" in plan


def test_insert_reads_table_and_words_once(spark):
    plan = plan_of(QUERIES["stoplist_insert"](spark, SF_DIR))
    assert plan.count("FileScan parquet") + plan.count("Scan parquet") <= 2 * plan.count("events.parquet")
    assert plan.count("ReadSchema") == 2
