"""Near-duplicate documents by MinHash signatures in an LSH forest, confirmed on whole shingle sets.

A signature has TREES labels of LABEL minima each. Every tree is an order of the documents by one label, in which
those that share a prefix lie next to each other; the longer the prefix, the nearer. Two documents are compared
where they share a prefix of DEPTH minima in some tree. A region of more than BLOCK documents is too crowded for that:
its documents are told apart by one minimum more, and so on region by region until each part is small enough or the
prefix is `deepest` long, which is the whole label by default. What is still larger then is compared block by block, so
that none of its pairs is left out and no task holds more than two blocks. Within a block documents are put in
the order of the label, and neighbours in it, which share the longest prefixes, are compared first: pairs that what is
found so far connects need no comparison.

With 20 trees a pair at similarity 0.85 misses all regions of depth 3 with a chance of 5e-9, and all regions of depth
6, if all its regions are crowded, with 8e-5 (at 0.8: 6e-7 and 2e-3); groups of near copies are linked by many
pairs. With `deepest` = DEPTH no region is cut, and with `margin` = 1 no pair is passed over by its signature; together
these leave only the chance of depth 3, at the cost of work in the square of crowded regions.

A pair is confirmed on whole sets. Only links that join something new leave a task, never all pairs of a group.

Defined cases: null, empty and blank texts have no shingles and link with nothing. Rows are judged
one by one, so repeated rows and rows that share an id but not a text are each reported, and rows of one id may all be
kept; equal sets are one class, which is compared once. A null doc_id gives way to any other id as component id.
Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hopboard.llm.common import LocalSets, components, text_key, texts, whole_groups, with_facts, written

TREES = 20
LABEL = 6
DEPTH = 3
BLOCK = 256
# Signatures estimate similarity with a standard deviation of at most 0.037 at 0.8; five of them are allowed for.
MARGIN = 0.18

_MINIMA = TREES * LABEL
_random = np.random.default_rng(20240611)
_FACTORS = _random.integers(0, 2**63, _MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _random.integers(0, 2**63, _MINIMA, dtype=np.uint64)


class _WordHashes(dict):
    """Hashes of the words seen last, kept as most words come again and again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; of the whole text if it has fewer words."""
    hashes = np.fromiter(map(known.__getitem__, text.lower().split()), np.uint64)
    if not len(hashes):
        return hashes
    run = min(words, len(hashes))
    mixed = np.full(len(hashes) - run + 1, run, np.uint64)
    for start in range(run):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[start : len(hashes) - run + 1 + start])
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        drawn = shingles[None, start : start + 512] * _FACTORS[:, None] + _SUMMANDS[:, None]
        np.minimum(least, drawn.min(axis=1), out=least)
    return _mix(least).astype(">u2").tobytes()


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_set(text, words, known) for text in texts(batch["text"])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "signature": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            })

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_set(text, words, known).tobytes() for text in texts(batch["text"])]
            yield pa.RecordBatch.from_pydict({"class_id": batch["class_id"], "shingles": pa.array(sets, pa.binary())})

    return run


def _neighbours(signatures: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions next to each other in the order of the tree's label, those with the longest common prefix first."""
    labels = signatures.reshape(len(signatures), TREES, LABEL)[:, tree]
    order = np.lexsort(labels.T[::-1])
    common = np.cumprod(labels[order[1:]] == labels[order[:-1]], axis=1).sum(axis=1)
    nearest = np.argsort(-common, kind="stable")
    return order[:-1][nearest], order[1:][nearest]


def _likely_pairs(signatures: np.ndarray, tree: int, side: np.ndarray, first: int, last: int, least: float, deepest: int):
    """Positions of pairs across the two blocks (or within the one) that look similar enough.

    Pairs that share `deepest` minima in an earlier tree are in one region there, and left to that tree.
    """
    left = np.flatnonzero(side == first)
    right = left if first == last else np.flatnonzero(side == last)
    for start in range(0, len(left), 64):
        rows = left[start : start + 64]
        same = signatures[rows][:, None, :] == signatures[right][None, :, :]
        likely = same.mean(axis=2) >= least
        if first == last:
            likely &= rows[:, None] < right[None, :]
        if tree and likely.any():
            labels = same.reshape(len(rows), len(right), TREES, LABEL)
            likely &= ~labels[:, :, :tree, :deepest].all(axis=3).any(axis=2)
        x, y = np.nonzero(likely)
        yield rows[x], right[y]


_GROUP = ["region", "low", "high"]


def _flagged(least: float, deepest: int):
    """Rows of each pair of blocks that have a likely partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _GROUP):
            signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, _MINIMA)
            tree, side, low, high = (table[name].to_numpy() for name in ("tree", "block", "low", "high"))
            wanted = np.zeros(table.num_rows, bool)
            for start, stop in zip(bounds[:-1], np.append(bounds[1:], table.num_rows)):
                for x, y in _likely_pairs(signatures[start:stop], int(tree[start]), side[start:stop], low[start], high[start], least, deepest):
                    wanted[start + x] = wanted[start + y] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    return run


def _links(least: float, percent: int, deepest: int):
    """Confirmed links of each pair of blocks, without those that others of the block imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _GROUP):
            signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, _MINIMA)
            shingles = table["shingles"].combine_chunks()
            class_id, tree, side, low, high = (table[name].to_numpy() for name in ("class_id", "tree", "block", "low", "high"))
            found: list[tuple[int, int]] = []
            for start, stop in zip(bounds[:-1], np.append(bounds[1:], table.num_rows)):
                sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in range(start, stop)]
                joined = LocalSets(len(sets))
                here, number = signatures[start:stop], int(tree[start])
                near = [_neighbours(here, number)] if low[start] == high[start] else []
                for xs, ys in chain(near, _likely_pairs(here, number, side[start:stop], low[start], high[start], least, deepest)):
                    for x, y in zip(xs.tolist(), ys.tolist()):
                        if joined.find(x) != joined.find(y) and similar(sets[x], sets[y], percent):
                            joined.join(x, y)
                            found.append((class_id[start + x], class_id[start + y]))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|, for sorted distinct values."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK, deepest: int = LABEL, margin: float = MARGIN
) -> DataFrame:
    """One row per document (doc_id, text_key, n_shingles, component_id, kept), for a frame with doc_id and text.

    `text_key` tells rows apart that share an id; it is `common.text_key` of the text.
    """
    source = docs.select("doc_id", "text", text_key("text").alias("text_key"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_shingles bigint, set_key binary, signature binary"
    rows = written(source.mapInArrow(_features(words), schema), "features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = written(
        rows.where("set_key is not null").groupBy("set_key").agg(first, F.any_value("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("class_id"), "set_key", "first.doc_id", "first.text_key", "signature", "copies"),
        "classes",
    )
    least = percent / 100 - margin
    flagged = _flagged_rows(classes, least, block, deepest)
    sets = _sets_of(source, classes, flagged, words)
    links = (
        flagged.join(sets, "class_id").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        .mapInArrow(_links(least, percent, deepest), "a bigint, b bigint")
    )
    linked = components(links).withColumnsRenamed({"node": "class_id"})
    members = written(linked.join(classes.select("class_id", "set_key", "doc_id"), "class_id"), "members")
    smallest = written(
        members.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "smallest"
    )
    grouped = with_facts(members.select("root", "set_key"), smallest, "root", "size").select("set_key", "component_id")
    facts = written(
        classes.select("set_key", "copies", F.col("doc_id").alias("class_first")).join(grouped, "set_key", "left")
        .select("set_key", "copies", F.coalesce("component_id", "class_first").alias("component_id")),
        "facts",
    )
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    judged = with_facts(rows.where("set_key is not null"), facts, "set_key", "copies").select(*columns)
    wordless = rows.where("set_key is null").withColumn("component_id", F.col("doc_id")).select(*columns)
    return judged.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _regions(classes: DataFrame, block: int, deepest: int) -> DataFrame:
    """Regions (class_id, tree, region, size) of two documents or more, each as deep as its crowd asks for."""
    label = F.expr(f"substring(signature, tree * {2 * LABEL} + 1, {2 * LABEL})").alias("label")
    rows = classes.select("class_id", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("class_id", "tree", label)
    parts = []
    for depth in range(DEPTH, deepest + 1):
        at = rows.withColumn("region", F.xxhash64("tree", F.substring("label", 1, 2 * depth)))
        sizes = written(at.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        placed = written(with_facts(at, sizes, "region", "size"), "regions")
        done = F.lit(True) if depth == deepest else F.col("size") <= block
        parts.append(placed.where(done).select("class_id", "tree", "region", "size"))
        rows = placed.where(~done).select("class_id", "tree", "label")
        if depth == deepest or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def _flagged_rows(classes: DataFrame, least: float, block: int, deepest: int) -> DataFrame:
    """Classes with a likely partner, as rows of the pair of blocks in which they meet."""
    regions = _regions(classes, block, deepest)
    blocks = F.ceil(F.col("size") / block).cast("int")
    paired = (
        regions.join(classes.select("class_id", "signature"), "class_id")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("class_id", "tree"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tree", "class_id", "signature")
    )
    kept = paired.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_flagged(least, deepest), paired.schema)
    return written(kept, "flagged")


def _sets_of(source: DataFrame, classes: DataFrame, flagged: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets of the classes that have a likely partner, from the text of one document each."""
    wanted = classes.join(flagged.select("class_id").distinct(), "class_id", "left_semi").select(
        "class_id", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")
    )
    found = source.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    )
    single = found.groupBy("class_id").agg(F.any_value("text").alias("text"))
    return single.mapInArrow(_sets(words), "class_id bigint, shingles binary")
