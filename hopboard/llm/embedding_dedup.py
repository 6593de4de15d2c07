"""Near-duplicate vectors by spherical k-means cells and blocked cosine products within the cells.

Every vector has one home cell, that of the nearest centroid among vectors of its label and length.
It also visits each cell that can be home of a vector at the wanted cosine: with unit vectors, a
vector x whose products with the home centroid h and another centroid c differ by m can only have a
partner with home c if m <= sin(angle) * |h - c|. So a row meets all its partners among the home and
visiting rows of its own home cell, whatever the centroids are, and its links are counted there once.
Cells of more than BLOCK rows are compared block by block, so that no task holds more than two blocks.

Centroids are fitted on at most SAMPLE rows, those with the smallest hashes of their ids; all rows are
assigned. The number of cells follows the rows of the largest label up to MAX_CELLS, which bounds what is sent to
the tasks; beyond that, cells have more blocks.

Defined cases: a row with a null label, or with a vector that is null, empty, zero, or has null or
non-finite components, links with nothing. Equal vectors of a label are one class, compared once; their
rows are linked with each other and have the class's links. Vectors of other lengths never link. Repeated
rows count as other vectors of each other; a null id gives way to any other as component id. Columns other
than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.llm.common import components, whole_groups, with_facts, written

BLOCK = 1024
ROWS_PER_CELL = 1024
MAX_CELLS = 512
SAMPLE = 20_000
ROUNDS = 8


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision and keys of equal (label, vector); nulls for rows that link with nothing."""
    for batch in batches:
        keys, units, sizes = [], [], []
        for vector, label in zip(batch["embedding"].to_pylist(), batch["label"].to_pylist()):
            unit = None if label is None or not vector or None in vector else _unit(np.array(vector, np.float64))
            units.append(None if unit is None else unit.tobytes())
            sizes.append(0 if unit is None else len(unit))
            raw = b"" if unit is None else repr(label).encode() + b"\0" + (np.array(vector, np.float64) + 0.0).tobytes()
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch["vec_id"],
            "label": batch["label"],
            "size": pa.array(sizes, pa.int32()),
            "key": pa.array(keys, pa.binary()),
            "unit": pa.array(units, pa.binary()),
        })


def _unit(vector: np.ndarray) -> np.ndarray | None:
    largest = np.abs(vector).max()
    if not np.isfinite(largest) or not largest:
        return None
    vector = vector / largest
    return vector / np.sqrt(vector @ vector)


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; a cell that runs empty keeps its centroid."""
    random = np.random.default_rng(7)
    centroids = vectors[random.permutation(len(vectors))[:cells]].copy()
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1)
        full = lengths > 1e-12
        centroids[full] = sums[full] / lengths[full, None]
    return centroids


def _assigned(centroids: dict[int, np.ndarray], sine: float):
    """A row for the home cell and one for each visited cell of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Distances of unit centroids from their products, once for each task.
        distances = {size: np.sqrt(np.maximum(2 - 2 * (means @ means.T), 0)) for size, means in centroids.items()}
        for batch in batches:
            sizes = np.asarray(batch["size"])
            source, cells, homes = [], [], []
            units = batch["unit"].to_pylist()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                means = centroids.get(int(size))
                if means is None or len(means) < 2:
                    source.append(rows), cells.append(np.zeros(len(rows), int)), homes.append(np.ones(len(rows), bool))
                    continue
                gaps = distances[int(size)]
                for start in range(0, len(rows), 1024):
                    part = rows[start : start + 1024]
                    products = np.frombuffer(b"".join(units[i] for i in part)).reshape(len(part), -1) @ means.T
                    home = products.argmax(axis=1)
                    behind = products[np.arange(len(part)), home][:, None] - products
                    x, cell = np.nonzero(behind <= sine * gaps[home] + 1e-9)
                    source.append(part[x]), cells.append(cell), homes.append(home[x] == cell)
            index = pa.array(np.concatenate(source) if source else np.array([], int))
            taken = batch.take(index)
            yield pa.RecordBatch.from_pydict({
                **{name: taken[name] for name in ("class_id", "label", "size", "copies", "unit")},
                "cell": pa.array(np.concatenate(cells) if cells else [], pa.int32()),
                "home": pa.array(np.concatenate(homes) if homes else [], pa.bool_()),
            })

    return run


_GROUP = ["place", "low", "high"]


def _compared(least: float):
    """Links counted for each home row of a block with one other block, and links that join the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _GROUP):
            class_id, copies, left, right = (table[name].to_numpy() for name in ("class_id", "copies", "left", "right"))
            units = table["unit"].to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, stop in zip(bounds[:-1], np.append(bounds[1:], table.num_rows)):
                rows, others = start + np.flatnonzero(left[start:stop]), start + np.flatnonzero(right[start:stop])
                if not len(rows) or not len(others):
                    continue
                vectors = [np.frombuffer(b"".join(units[i] for i in which)).reshape(len(which), -1) for which in (rows, others)]
                linked = vectors[0] @ vectors[1].T >= least
                linked &= class_id[rows][:, None] != class_id[others][None, :]
                counts = linked @ copies[others]
                some = counts > 0
                out.append((class_id[rows][some], counts[some], np.full(int(some.sum()), -1)))
                out += [(np.array([a]), np.array([0]), np.array([b])) for a, b in _spanning(linked, class_id[rows], class_id[others])]
            a, n, b = (np.concatenate(column) if out else np.array([], np.int64) for column in (zip(*out) if out else ((), (), ())))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _spanning(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links to one row from everything it reaches within the matrix."""
    waiting = linked.any(axis=1)
    while waiting.any():
        seed = int(np.flatnonzero(waiting)[0])
        in_rows, in_columns = np.zeros(len(rows), bool), np.zeros(len(columns), bool)
        front = np.array([seed])
        while len(front):
            in_rows[front] = True
            reached = linked[front].any(axis=0) & ~in_columns
            in_columns |= reached
            front = np.flatnonzero(linked[:, reached].any(axis=1) & ~in_rows)
        waiting &= ~in_rows
        for node in {*rows[in_rows].tolist(), *columns[in_columns].tolist()} - {int(rows[seed])}:
            yield int(rows[seed]), node


def linked_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector (vec_id, n_links, component_id, kept), for a frame with vec_id, embedding and label."""
    source = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    kind = {name: source.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    rows = written(
        source.mapInArrow(_units, f"vec_id {kind['vec_id']}, label {kind['label']}, size int, key binary, unit binary"), "vectors"
    )
    classes = written(
        rows.where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("label", "size", "unit")))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    sine = float(np.sqrt(1 - least * least))
    placed = classes.select("class_id", "label", "size", "copies", "unit").mapInArrow(
        _assigned(_centroids(classes), sine), f"class_id bigint, label {kind['label']}, size int, copies bigint, unit binary, cell int, home boolean"
    )
    placed = written(placed.withColumn("place", F.xxhash64("label", "size", "cell")), "cells")
    found = written(_blocks(placed).mapInArrow(_compared(least), "a bigint, n bigint, b bigint"), "links")
    counts = found.where("b < 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b >= 0").select("a", "b")).withColumnsRenamed({"node": "class_id"})
    members = written(roots.join(classes.select("class_id", "first_id"), "class_id"), "members")
    smallest = written(members.groupBy("root").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("classes")), "smallest")
    grouped = with_facts(members.select("root", "class_id"), smallest, "root", "classes").select("class_id", "smallest")
    summary = written(
        classes.select("class_id", "key", "copies", "first_id").join(counts, "class_id", "left").join(grouped, "class_id", "left")
        .select(F.col("key"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("smallest", "first_id").alias("smallest"), "copies"),
        "summary",
    )
    # Rows that link with nothing get keys of their own: nulls would all meet in one task.
    key = F.coalesce("key", F.concat(F.lit("row"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"))
    component = F.when(F.col("links").isNotNull(), F.col("smallest")).otherwise(F.col("vec_id"))
    return (
        with_facts(rows.select("vec_id", key.alias("key")), summary, "key", "copies", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _centroids(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each vector length among the sample; the largest label decides how many."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells = min(MAX_CELLS, -(-largest // ROWS_PER_CELL))
    sample = classes.select("size", "unit").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    by_size: dict[int, list[bytes]] = {}
    for row in sample:
        by_size.setdefault(row["size"], []).append(bytes(row["unit"]))
    return {
        size: spherical_kmeans(np.frombuffer(b"".join(units)).reshape(len(units), -1), min(cells, len(units)))
        for size, units in by_size.items()
    }


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows dealt out to pairs of blocks: a block of the cell's home rows against one of all its rows.

    The two are numbered apart: home rows are few of a cell's rows, and so are the copies of visiting rows.
    """
    sizes = written(
        placed.groupBy("place").agg(
            F.ceil(F.count_if("home") / BLOCK).cast("int").alias("lows"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("highs"), F.count(F.lit(1)).alias("n")
        ).where("lows > 0"),
        "sizes",
    )
    dealt = with_facts(placed, sizes, "place", "n").withColumn("hash", F.xxhash64("class_id", "cell"))
    low, high = (F.pmod("hash", count).cast("int") for count in ("lows", "highs"))
    each_low, each_high = (F.explode(F.sequence(F.lit(0), F.col(count) - 1)) for count in ("lows", "highs"))
    columns = ["class_id", "copies", "unit"]
    as_left = dealt.where("home").select("place", low.alias("low"), each_high.alias("high"), *columns, F.lit(True).alias("left"))
    as_right = dealt.select("place", each_low.alias("low"), high.alias("high"), *columns, F.lit(False).alias("left"))
    both = as_left.unionByName(as_right).withColumn("right", ~F.col("left"))
    return both.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
