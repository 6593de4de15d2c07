"""Benchmark passages in documents, found by Wu-Manber search for many strings at once.

Texts are brought to a canonical form: words in lower case, one space before, between and after them. A
window of an item is then a string that starts and ends with a space, and an occurrence of the words is an
occurrence of the string. Search tables hold, for every block of bytes, how far the search may move on
when the block ends at the current position; where it may not move, the block selects a bucket of
windows, which are compared directly. Windows are divided into classes by length, since the shortest one of
a table bounds its shifts.

The windows of a benchmark may be more than one task should hold. They are dealt into shards of about SHARD windows,
files in the shared folder. The documents are read once: a task takes in some CHUNK bytes of texts and searches them
for the windows of one shard after the other, with one search table in memory. Neither windows nor texts go through
the driver or a shuffle. The shared folder must be one that pyarrow can open on all executors.

Defined cases: null, empty and wordless texts have no words; such an item has no windows and such a
document no hits. An item with fewer words than the window is one window. Items are told apart by id:
rows with the same id add up, a null id hits words but is not listed. Each row of documents is reported by
itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.llm.common import scratch_path, text_key, texts, written

WINDOW = 10
SHARD = 20_000
CHUNK = 32 << 20
BLOCK_BYTES = 8

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return text.lower().translate(_WORD_BYTES).split()


def canonical(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " if words else b""


class WuManber:
    """Occurrences of strings of similar length; all are at least as long as the shortest, `least`."""

    def __init__(self, strings: list[bytes]):
        self.least = min(map(len, strings))
        self.block = min(BLOCK_BYTES, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for string in strings:
            for end in range(self.block, self.least + 1):
                block = string[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), self.least - end)
            suffix = string[self.least - self.block : self.least]
            self.buckets.setdefault(suffix, {}).setdefault(string[: self.block], []).append(string)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and string of every occurrence."""
        block, least, default = self.block, self.least, self.default
        shift_of, length = self.shift.get, len(text)
        end = least
        while end <= length:
            suffix = text[end - block : end]
            shift = shift_of(suffix, default)
            if shift:
                end += shift
                continue
            start = end - least
            for string in self.buckets[suffix].get(text[start : start + block], ()):
                if text.startswith(string, start):
                    yield start, string
            end += 1


def windows(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    return [canonical(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _windows_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(windows(words_of(text), window))) for text in texts(batch["text"])]
            index = pa.array([row for row, strings in enumerate(found) for _ in strings], pa.int64())
            strings = pa.array([string for strings in found for string in strings], pa.binary())
            yield pa.RecordBatch.from_pydict({"item_id": batch["item_id"].take(index), "string": strings})

    return run


class _Shard:
    """The windows of one shard, each with the items it is from, and the tables to search for them."""

    def __init__(self, path: str, number: int):
        system, root = fs.FileSystem.from_uri(path)
        folder = f"{root}/shard={number}"
        self.items: dict[bytes, list[str]] = {}
        if system.get_file_info(folder).type == fs.FileType.Directory:
            for batch in ds.dataset(folder, filesystem=system, format="parquet").to_batches(columns=["string", "item_id"]):
                for string, item in zip(batch["string"].to_pylist(), batch["item_id"].to_pylist()):
                    self.items.setdefault(string, []).extend([] if item is None else [item])
        classes: dict[int, list[bytes]] = {}
        for string in self.items:
            classes.setdefault(min(len(string).bit_length(), 6), []).append(string)
        self.tables = [WuManber(group) for _, group in sorted(classes.items())]


def _searched(path: str, shards: int):
    """Words, hit words and items of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, _Shard] | None = None
        for chunk in _chunks(batches):
            lines = [canonical(words_of(text)) for batch in chunk for text in texts(batch["text"])]
            spans: list[list[tuple[int, int]]] = [[] for _ in lines]
            items: list[set[str]] = [set() for _ in lines]
            for number in range(shards):
                if last is None or last[0] != number:
                    last = None  # The last table goes before the next one is built.
                    last = number, _Shard(path, number)
                for row, line in enumerate(lines):
                    hits = [hit for table in last[1].tables for hit in table.search(line)]
                    if hits:
                        spans[row] = merged(sorted(spans[row] + _in_words(line, hits)))
                        items[row].update(item for string in {string for _, string in hits} for item in last[1].items[string])
            yield pa.RecordBatch.from_pydict({
                **{name: pa.concat_arrays([batch[name] for batch in chunk]) for name in ("doc_id", "text_key")},
                "n_words": pa.array([max(0, line.count(b" ") - 1) for line in lines], pa.int64()),
                "n_hit": pa.array([sum(stop - start for start, stop in found) for found in spans], pa.int64()),
                "hit_spans": pa.array([[{"start": start, "stop": stop} for start, stop in found] for found in spans], _SPANS),
                "item_ids": pa.array([sorted(found) for found in items], pa.list_(pa.string())),
            })

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together up to about CHUNK bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(part.nbytes for part in held) >= CHUNK:
            yield held
            held = []
    if held:
        yield held


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _in_words(line: bytes, hits: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Stretches of word numbers for occurrences; the space at the start of a string comes before its first word."""
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    first = np.searchsorted(spaces, [start for start, _ in hits]).tolist()
    return sorted((at, at + string.count(b" ") - 1) for at, (_, string) in zip(first, hits))


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches that cover the same numbers, from sorted ones."""
    out: list[tuple[int, int]] = []
    for start, stop in stretches:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, hit_spans (of word numbers), item_ids, contaminated.

    `item_ids` are texts in the order of their code points; `text_key` is `common.text_key` of the text.
    """
    found = written(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_windows_of(window), "item_id string, string binary").distinct(),
        "windows",
    )
    shards = max(1, -(-found.count() // shard))
    path = scratch_path(docs.sparkSession, "window_shards")
    found.withColumn("shard", F.pmod(F.xxhash64("string"), F.lit(shards))).repartition("shard").write.partitionBy("shard").parquet(path)
    source = docs.select("doc_id", text_key("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_key bigint, n_words bigint, n_hit bigint, "
        "hit_spans array<struct<start: bigint, stop: bigint>>, item_ids array<string>"
    )
    return source.mapInArrow(_searched(path, shards), schema).withColumn("contaminated", F.col("n_hit") > 0)
