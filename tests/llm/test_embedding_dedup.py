import math
import random

import numpy as np
import pytest

from hopboard.llm import embedding_dedup
from hopboard.llm.embedding_dedup import linked_vectors, spherical_kmeans


def brute_force(rows, least):
    units = []
    for _, vector, label in rows:
        fine = label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        units.append(np.array(vector, float) / np.linalg.norm(np.array(vector, float) / max(map(abs, vector))) / max(map(abs, vector)) if fine else None)
    linked = lambda i, j: (
        i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
        and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least
    )
    links = [[j for j in range(len(rows)) if linked(i, j)] for i in range(len(rows))]
    label = [row[0] for row in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near)]) for i, near in enumerate(links)]
    return [(row[0], len(near), root, row[0] == root) for row, near, root in zip(rows, links, label)]


def rows_of(seed):
    random.seed(seed)
    rows = []
    for i in range(220):
        if i % 3 and i > 10:
            _, vector, label = random.choice(rows[11:] or rows)
            vector = [x + random.gauss(0, 0.03) if i % 4 else x for x in vector] if vector else vector
            label = label if i % 7 else random.randrange(3)
        else:
            vector, label = [random.gauss(0, 1) for _ in range(8)], random.randrange(3)
        rows.append((i, vector, label))
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e30] * 8, [1e-30] * 8, [2.0] * 8, [1.0] * 5, [3.0] * 5]
    return rows + [(1000 + i, vector, 1) for i, vector in enumerate(odd)] + [(2000, [2.0] * 8, None), (2001, [2.0] * 8, 2)]


@pytest.mark.parametrize("cell, block", [(1024, 1024), (10, 7), (30, 1000)])
def test_matches_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = rows_of(cell)
    frame = spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<double>, label int, key string")
    got = [tuple(row) for row in linked_vectors(frame.repartition(4), 0.95).orderBy("vec_id").collect()]
    assert got == brute_force(rows, 0.95)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.01], 5), (None, None, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, linked_vectors(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    assert linked_vectors(frame.limit(0)).count() == 0


def test_cells_follow_clusters():
    random_ = np.random.default_rng(0)
    means = np.eye(4, 16)
    vectors = np.repeat(means, 50, axis=0) + random_.normal(0, 0.05, (200, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(spherical_kmeans(vectors, 4), axis=1), 1)
