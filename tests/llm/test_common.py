import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopboard.llm import common
from hopboard.llm.common import components, whole_groups, with_facts


def batches(rows, sizes):
    start = 0
    for size in sizes:
        part = rows[start : start + size]
        start += size
        yield pa.RecordBatch.from_pydict({"k": [k for k, _ in part], "v": [v for _, v in part]})


@pytest.mark.parametrize("sizes", [[20], [1] * 20, [3, 0, 9, 1, 7], [7, 7, 6]])
def test_whole_groups(sizes):
    rows = [(k, i) for i, k in enumerate([1, 1, 1, 1, 1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 5, 5, 6, 7])]
    found = []
    for table, bounds in whole_groups(batches(rows, sizes), ["k"]):
        for start, stop in zip(bounds[:-1], np.append(bounds[1:], table.num_rows)):
            if stop > start:
                found.append((table["k"][int(start)].as_py(), table["v"].to_pylist()[start:stop]))
    expected = {}
    for k, v in rows:
        expected.setdefault(k, []).append(v)
    assert found == list(expected.items())


@pytest.mark.parametrize("edges", [
    [],
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)],
    [(random.Random(1).randrange(400), random.Random(i).randrange(400)) for i in range(300)],
    [(5, 5), (1, 2), (2, 1), (1, 2)],
])
def test_components_match_union_find(spark, edges):
    parent = {x: x for edge in edges for x in edge if edge[0] != edge[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    found = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found.keys() == parent.keys()
    groups = {}
    for node, root in found.items():
        groups.setdefault(root, set()).add(find(node))
    assert all(len(roots) == 1 for roots in groups.values())
    assert len(groups) == len({find(x) for x in parent})


def test_facts_reach_rows_of_hot_and_of_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    keys = [b"hot"] * 60 + [bytes([i]) for i in range(30)] + [b"alone"]
    rows = spark.createDataFrame([(i, key) for i, key in enumerate(keys)], "id long, key binary")
    facts = rows.where("key <> cast('alone' as binary)").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(tuple(row) for row in with_facts(rows, facts, "key", "n").select("id", "n").collect())
    assert found == [(i, keys.count(key)) for i, key in enumerate(keys) if key != b"alone"]
    assert with_facts(rows, facts.where("false"), "key", "n").isEmpty()
