"""Names of names, followed to their ends, against following them one by one."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from hopboard.operators import canonical
from hopboard.operators.canonical import canonical_rows, normalized_names, resolved_names, with_named
from hopboard.operators.counting import bucket_sketches
from hopboard.operators.ranking import top_as_of
from hopboard.params import BoardParams

NOW = datetime.fromtimestamp(1_700_000_040, timezone.utc)
PARAMS = BoardParams.of(timedelta(seconds=30), 3, counter="exact")
_, CURRENT = PARAMS.live_range(NOW)


def names_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "query string, canonical string")


def followed(pairs):
    """End of each chain, or the query itself where it runs into a circle."""
    step, ends = dict(pairs), {}
    for query in step:
        at, seen = query, set()
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
        ends[query] = (query, True) if at in step else (at, False)
    return ends


def resolved(spark, pairs):
    rows = resolved_names(names_of(spark, pairs)).collect()
    assert len(rows) == len(pairs)
    return {row["query"]: (row["canonical"], row["cyclic"]) for row in rows}


CASES = {
    "chain": [(f"q{i}", f"q{i + 1}") for i in range(10)],
    "long chain": [(f"q{i}", f"q{i + 1}") for i in range(70)],
    "circle": [("a", "b"), ("b", "c"), ("c", "a")],
    "two": [("a", "b"), ("b", "a"), ("x", "y")],
    "into a circle": [("t1", "t2"), ("t2", "a"), ("a", "b"), ("b", "a"), ("k", "end")],
    "star": [(f"q{i}", "hub") for i in range(40)] + [("hub", "end")],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_chains_and_circles(spark, case):
    assert resolved(spark, CASES[case]) == followed(CASES[case])


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_random_names_with_any_split_of_hot_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(canonical, "HOT", hot)
    draw = random.Random(hot)
    pairs = [(f"q{i}", f"q{draw.choice([0, draw.randrange(60), draw.randrange(40, 90)])}") for i in range(60)]
    pairs = [(query, name) for query, name in pairs if query != name]
    assert resolved(spark, pairs) == followed(pairs)


def test_names_are_normalised(spark):
    given = [(" A ", "B  c"), ("a", "z"), ("x", " X "), ("", "a"), ("y", " "), ("n", None), (None, "n")]
    assert [tuple(row) for row in normalized_names(names_of(spark, given)).collect()] == [("a", "b c")]


@pytest.mark.parametrize("hot", [2, 10_000])
def test_every_row_is_joined_once(spark, monkeypatch, hot):
    monkeypatch.setattr(canonical, "HOT", hot)
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 0), ("c", 1), ("c", 1)], "query string, n int")
    names = spark.createDataFrame([("a", "A"), ("c", "C"), ("z", "Z")], "query string, name string")
    got = sorted(map(str, map(tuple, with_named(rows, names, "query").collect())))
    want = [(query, n, {"a": "A", "c": "C"}.get(query)) for query, n in [tuple(row) for row in rows.collect()]]
    assert got == sorted(map(str, want))
    assert with_named(rows.limit(0), names, "query").collect() == []


@pytest.mark.parametrize("counter", ["exact", "hll"])
def test_sources_count_once_under_one_name(spark, counter):
    params = BoardParams.of(timedelta(seconds=30), 3, counter=counter)
    events = [(CURRENT, "iphone 15", "u1"), (CURRENT - 1, "iphone15", "u1"), (CURRENT, "iphone15", "u2"), (CURRENT, "a", "u"), (CURRENT, "b", "v"), (CURRENT, "other", "u")]
    rows = spark.createDataFrame(events, "bucket_id bigint, query string, source string")
    if counter == "hll":
        rows = bucket_sketches(rows, params)
    found = resolved_names(names_of(spark, [("iphone15", "apple phone"), ("iphone 15", "iphone15"), ("a", "b"), ("b", "a")]))
    named = canonical_rows(rows, found)
    assert named.columns == rows.columns
    board = [(row["query"], row["count"]) for row in top_as_of(named, params, NOW).orderBy("rank").collect()]
    assert board == [("apple phone", 2), ("a", 1), ("b", 1), ("other", 1)]
