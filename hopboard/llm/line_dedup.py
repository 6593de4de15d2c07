"""Reversible removal of lines that many documents share.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. An index holds
the exact number of documents of every key, and for each shard of the keys a cuckoo filter of those that
have reached the limit. Inserting or deleting documents adds up counts; only keys that cross the limit
touch a filter, once per crossing, so that deletions undo insertions exactly. A filter that has no room for its
crossings is built anew from the counts, and shards split when they hold more keys than meant. The index knows its
documents: inserting one again changes nothing.

To clean documents, lines are looked up in the filters, shard by shard with one filter in memory, and the few that
pass are confirmed by the counts. A key in HOT_DOCS documents or more, and with a share of all counts that no more
than HEAVY keys can have, would make a hot shard: such keys are sent to all tasks and decided where the lines are.

Defined cases: a null or empty text is one empty line. Lines whose key has fewer code points than
`min_chars` are never counted. Documents are told apart by id and text: rows that repeat both count once,
rows without an id count by their texts, and every row is cleaned. Deleting a document that is not in the index
raises; documents without a counted line are never in it. An empty index drops nothing. Other columns are passed
on by `clean`; its own columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.llm.common import HEAVY, text_key, texts, whole_groups, with_facts, written

KEYS_PER_SHARD = 200_000
HOT_DOCS = 20_000
_SLOTS = 4
_BLANK = b" \t\n\v\f\r"
_FILTER = "shard bigint, slots binary"
_DOCUMENT = "doc_id bigint, text_key bigint"


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets; keys are pairs of 64-bit numbers."""

    def __init__(self, slots: np.ndarray | None = None, buckets: int = 64):
        self.slots = np.zeros((buckets, _SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and the two buckets of each key."""
        mask = np.uint64(len(self.slots) - 1)
        prints = np.maximum(low.view(np.uint64) >> np.uint64(48), np.uint64(1))
        first = high.view(np.uint64) & mask
        return prints.astype(np.uint16), first.astype(np.int64), ((first ^ self._turn(prints)) & mask).astype(np.int64)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(high, low)
        return (self.slots[first] == prints[:, None]).any(axis=1) | (self.slots[second] == prints[:, None]).any(axis=1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """False if there is no room; the filter is then to be built anew with more buckets."""
        return all(self._put(*place) for place in zip(*(column.tolist() for column in self.places(high, low))))

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        for print_, first, second in zip(*(column.tolist() for column in self.places(high, low))):
            for bucket in (first, second):
                at = np.flatnonzero(self.slots[bucket] == print_)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    @staticmethod
    def _turn(prints):
        return prints * np.uint64(0x5BD1E995)

    def _put(self, print_: int, first: int, second: int) -> bool:
        mask = len(self.slots) - 1
        for bucket in (first, second):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = print_
                return True
        bucket = second
        for kick in range(500):
            at = (print_ + kick) % _SLOTS
            print_, self.slots[bucket, at] = int(self.slots[bucket, at]), print_
            bucket = (bucket ^ (print_ * 0x5BD1E995)) & mask
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = print_
                return True
        return False


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode(errors="replace")) >= min_chars)


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return numbers[:, 0], numbers[:, 1]


def _keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(texts(batch["text"])):
                keys = {_key(line) for line in text.split(b"\n")}
                found = [_digest(key) for key in keys if key and _long_enough(key, min_chars)]
                digests += found
                rows += [row] * len(found)
            high, low = _pairs(digests)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"].take(index), "text_key": batch["text_key"].take(index), "high": high, "low": low}
            )

    return run


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Distinct (doc_id, text_key, high, low): the documents of each key, as a written table."""
    source = docs.select("doc_id", text_key("text").alias("text_key"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, high bigint, low bigint"
    return written(source.mapInArrow(_keys_of(min_chars), schema).distinct(), "lines")


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table, bounds in whole_groups(batches, ["shard"]):
        for start, stop in zip(bounds[:-1], np.append(bounds[1:], table.num_rows)):
            yield table.slice(start, stop - start)


def _filter_row(shard: int, slots: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "slots": pa.array([slots], pa.binary())})


def _built_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of each shard from all of its keys, about two thirds full."""
    for rows in _shards_of(batches):
        high, low = rows["high"].to_numpy(), rows["low"].to_numpy()
        buckets = max(64, 1 << (int(len(high) / (_SLOTS * 0.85))).bit_length())
        while not (current := CuckooFilter(buckets=buckets)).insert(high, low):
            buckets *= 2
        yield _filter_row(rows["shard"][0].as_py(), current.to_bytes())


def _updated_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of each shard after its crossings; null for one that has no room for them."""
    for rows in _shards_of(batches):
        slots = [data for data in rows["slots"].to_pylist() if data is not None]
        change, high, low = (rows[name].to_numpy() for name in ("change", "high", "low"))
        current = CuckooFilter.from_bytes(slots[0]) if slots else CuckooFilter()
        current.delete(high[change < 0], low[change < 0])
        room = current.insert(high[change > 0], low[change > 0])
        yield _filter_row(rows["shard"][0].as_py(), current.to_bytes() if room else None)


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that pass the filter of their shard, from rows sorted by shard with the filter first."""
    shard, current = None, None
    for batch in batches:
        shards, is_line = batch["shard"].to_numpy(), batch["is_line"].to_numpy(zero_copy_only=False)
        high, low = batch["high"].to_numpy(zero_copy_only=False), batch["low"].to_numpy(zero_copy_only=False)
        passed = np.zeros(batch.num_rows, bool)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1]) if batch.num_rows else []
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            if shards[start] != shard:
                shard, current = shards[start], None
            lines = np.arange(start, stop)
            if not is_line[start]:
                current = CuckooFilter.from_bytes(batch["slots"][int(start)].as_py())
                lines = lines[1:]
            if current is not None and len(lines):
                passed[lines] = current.contains(high[lines].astype(np.int64), low[lines].astype(np.int64))
        yield batch.filter(pa.array(passed)).select(["doc_id", "text_key", "high", "low"])


def _documents(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "text_key").distinct()


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


@dataclass(frozen=True)
class LineIndex:
    """Counts (high, low, n_docs) of all keys, filters (shard, slots) of those in at least `min_docs` documents, and the documents."""

    counts: DataFrame
    filters: DataFrame
    documents: DataFrame | None
    min_docs: int
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int, shards: int) -> LineIndex:
        counts = spark.createDataFrame([], "high bigint, low bigint, n_docs bigint")
        return cls(counts, spark.createDataFrame([], "shard bigint, slots binary"), None, min_docs, shards)

    @classmethod
    def load(cls, spark: SparkSession, path: str, min_docs: int, shards: int) -> LineIndex:
        counts, filters, documents = (spark.read.parquet(f"{path}/{part}") for part in ("counts", "filters", "documents"))
        return cls(counts, filters, documents, min_docs, shards)

    def save(self, path: str) -> None:
        documents = self.counts.sparkSession.createDataFrame([], _DOCUMENT) if self.documents is None else self.documents
        for name, part in (("counts", self.counts), ("filters", self.filters), ("documents", documents)):
            part.write.parquet(f"{path}/{name}")

    def insert(self, lines: DataFrame) -> LineIndex:
        """Index with these documents too; those that are in it already change nothing."""
        if self.documents is None:
            return self._changed(lines, 1, _documents(lines))
        new = written(lines.join(self.documents, _same_document(lines, self.documents), "left_anti"), "new_lines")
        return self._changed(new, 1, written(self.documents.unionByName(_documents(new)), "documents"))

    def delete(self, lines: DataFrame) -> LineIndex:
        """Index without these documents, all of which must be in it."""
        gone = _documents(lines)
        known = (lines.limit(0).select("doc_id", "text_key") if self.documents is None else self.documents).withColumn("known", F.lit(True))
        refused = F.raise_error(F.lit("a document to delete was never inserted")).cast("boolean")
        checked = gone.join(known.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), "known"),
                            F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), "left")
        gone = written(checked.select("doc_id", "text_key", F.coalesce("known", refused).alias("known")), "gone").drop("known")
        left = gone if self.documents is None else self.documents.join(gone, _same_document(self.documents, gone), "left_anti")
        return self._changed(lines, -1, written(left, "documents"))

    def shard(self) -> Column:
        return F.pmod(F.col("low"), F.lit(self.shards))

    def _changed(self, lines: DataFrame, sign: int, documents: DataFrame) -> LineIndex:
        batch = lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
        both = self.counts.select("high", "low", F.col("n_docs").alias("old"), F.lit(0).cast("bigint").alias("new")).unionByName(
            batch.select("high", "low", F.lit(0).cast("bigint").alias("old"), (sign * F.col("n")).alias("new"))
        )
        summed = written(both.groupBy("high", "low").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("new")).alias("n_docs")), "counts")
        counts = summed.where("n_docs > 0").select("high", "low", "n_docs")
        was, now = F.col("old") >= self.min_docs, F.col("n_docs") >= self.min_docs
        shards, frequent = self.shards, summed.where(now).select("high", "low")
        n_frequent = frequent.count()
        while n_frequent > 2 * KEYS_PER_SHARD * shards:
            shards *= 2
        index = LineIndex(counts, self.filters, documents, self.min_docs, shards)
        by_shard = lambda rows: rows.repartition("shard").sortWithinPartitions("shard")
        build = lambda keys: by_shard(keys.select(index.shard().alias("shard"), "high", "low")).mapInArrow(_built_filters, _FILTER)
        if self.documents is None or shards != self.shards:
            return replace(index, filters=written(build(frequent), "filters"))
        crossing = summed.where(was != now).select(
            self.shard().alias("shard"), "high", "low", (now.cast("int") - was.cast("int")).alias("change"), F.lit(None).cast("binary").alias("slots")
        )
        zero = F.lit(0).cast("bigint")
        held = self.filters.select("shard", zero.alias("high"), zero.alias("low"), F.lit(0).alias("change"), "slots")
        updated = written(by_shard(held.unionByName(crossing)).mapInArrow(_updated_filters, _FILTER), "filters")
        full = [row["shard"] for row in updated.where("slots IS NULL").select("shard").collect()]
        if full:
            updated = updated.where("slots IS NOT NULL").unionByName(build(frequent.where(self.shard().isin(full))))
            updated = written(updated, "filters")
        return replace(index, filters=updated)

    def frequent_lines(self, lines: DataFrame) -> DataFrame:
        """Those (doc_id, text_key, high, low) whose key is in at least `min_docs` documents of the index."""
        frequent = self.counts.where(F.col("n_docs") >= self.min_docs)
        total = self.counts.agg(F.sum("n_docs")).first()[0] or 0
        # No more than HEAVY keys can each have a share of 1 / HEAVY of all counts.
        is_heavy = (F.col("n_docs") >= HOT_DOCS) & (F.col("n_docs") * HEAVY >= total)
        heavy = F.broadcast(frequent.where(is_heavy).select("high", "low"))
        decided = lines.join(heavy, ["high", "low"], "left_semi")
        rest = lines.join(heavy, ["high", "low"], "left_anti")
        probes = rest.select(self.shard().alias("shard"), F.lit(True).alias("is_line"), "doc_id", "text_key", "high", "low", F.lit(None).cast("binary").alias("slots"))
        no = lambda name: F.lit(None).cast(lines.schema[name].dataType).alias(name)
        zero = F.lit(0).cast("bigint")
        filters = self.filters.select("shard", F.lit(False).alias("is_line"), no("doc_id"), no("text_key"), zero.alias("high"), zero.alias("low"), "slots")
        passed = (
            filters.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "is_line")
            .mapInArrow(_probed, lines.select("doc_id", "text_key", "high", "low").schema)
        )
        confirmed = passed.join(frequent.select("high", "low"), ["high", "low"], "left_semi")
        columns = ["doc_id", "text_key", "high", "low"]
        return decided.select(*columns).unionByName(confirmed.select(*columns))


def build_index(lines: DataFrame, min_docs: int = 10) -> LineIndex:
    """Index of these documents, with as many shards as their lines ask for."""
    shards = max(8, -(-lines.count() // (min_docs * KEYS_PER_SHARD)))
    return LineIndex.empty(lines.sparkSession, min_docs, shards).insert(lines)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, drops in zip(texts(batch["text"]), batch["drops"].to_pylist()):
            lines = text.split(b"\n")
            if drops:
                gone = {np.array([drop["high"], drop["low"]], np.int64).tobytes() for drop in drops}
                left = [line for line in lines if _digest(_key(line)) not in gone]
            else:
                left = lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        yield pa.RecordBatch.from_pydict({
            "row": batch["row"],
            "text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
        })


def clean(docs: DataFrame, index: LineIndex, lines: DataFrame, keep_first: bool = False) -> DataFrame:
    """Documents without their frequent lines, with n_lines (before) and n_dropped.

    With `keep_first`, the lines of a key stay in the document with the smallest id.
    """
    drops = index.frequent_lines(lines)
    if keep_first:
        drops = written(drops, "drops")
        firsts = written(
            drops.groupBy("high", "low").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts"
        )
        drops = with_facts(drops, firsts, ["high", "low"], "n").where(~F.struct("doc_id", "text_key").eqNullSafe(F.col("first")))
    by_doc = drops.groupBy(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).agg(
        F.collect_list(F.struct("high", "low")).alias("drops")
    )
    others = [name for name in docs.columns if name not in ("text", "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*others).alias("row"), "text", text_key("text").alias("text_key"))
    joined = packed.join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_key") == F.col("drop_key")), "left")
    rows = joined.select("row", "text", "drops")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_lines bigint, n_dropped bigint"
    cut = rows.mapInArrow(_cut, schema)
    return cut.select(*[F.col(f"row.`{name}`").alias(name) for name in others], "text", "n_lines", "n_dropped")
