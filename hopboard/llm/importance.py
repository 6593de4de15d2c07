"""Importance resampling of documents towards a target text, over hashed runs of words.

Features of a text are all runs of 1 to `longest` consecutive words, joined by one space, repeats counted.
A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. A document's weight is the floored
mean over its features of the buckets' gains, the log ratio of smoothed frequencies in the target and in
all documents, in thousandths, rounded down. Adding Gumbel noise drawn from the document's id makes the highest
scores a sample without replacement in proportion to the weights' exponentials.

CRCs of all features of a batch come from a position table: a byte at a distance from the end of its
span contributes a value that depends on these two alone, contributions are combined by
`bitwise_xor.reduceat` over the spans, and a constant for the length is added. Spans longer than the table are
cut into blocks; each pair of blocks is folded by moving the first one on by the length of the second.

Both passes over the documents run where they lie and shuffle no text: tasks send one count for each bucket,
and the gains come back as a table of fixed size. Ranks come from the number of documents at each score.
Scores are whole thousandths of logarithms, so that there are at most some hundred thousand of them however
many documents there are, and only documents at or above the last score drawn are sorted, each score by itself.

Defined cases: null and empty texts have no words and features, weight 0, and are never drawn if `min_words` is
above 0. A null id counts as an empty text in the noise. Ties go to the smaller id (null first), then to fewer
features, then the smaller weight; rows that repeat all three get consecutive ranks. Without documents or
target text the gains follow from the formula with counts of 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopboard.llm.common import texts, written
from hopboard.llm.decontamination import words_of

LONGEST = 2
BUCKETS = 10_000
SEED = 7
PERCENT = 25
MIN_WORDS = 20

# Distances from the end of a span that the position table covers, and bytes of spans worked on at once.
REACH = 64
SPAN_BYTES = 1 << 21
# Copies of one row that are numbered in one piece.
PIECE = 4096

# Fixed value: reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    """What a register's lowest byte turns into as it is shifted out."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_STEP = _byte_table()


def _after_zero_byte(registers: np.ndarray) -> np.ndarray:
    return _STEP[registers & 0xFF] ^ (registers >> 8)


def _position_table(reach: int) -> np.ndarray:
    """Contribution of byte b at distance d from the end, at [b, d]."""
    columns = [_STEP]
    for _ in range(reach - 1):
        columns.append(_after_zero_byte(columns[-1]))
    return np.ascontiguousarray(np.array(columns).T)


_CONTRIBUTION = _position_table(REACH).ravel()
_LENGTH_CONSTANT = np.array([crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


class _Moves:
    """Registers moved on by REACH * 2**level zero bytes, by the contributions of their four bytes."""

    def __init__(self) -> None:
        unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
        for _ in range(REACH):
            unit = _after_zero_byte(unit)
        self.levels = [unit]

    def __call__(self, registers: np.ndarray, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            self.levels.append(self._moved(self.levels[-1], self.levels[-1]))
        return self._moved(registers, self.levels[level])

    @staticmethod
    def _moved(registers: np.ndarray, table: np.ndarray) -> np.ndarray:
        moved = np.zeros_like(registers)
        for byte in range(4):
            moved ^= table[byte][(registers >> np.uint32(8 * byte)) & np.uint32(0xFF)]
        return moved


_MOVES = _Moves()


def _block_values(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Combined contributions of the bytes of each span of 1 to REACH bytes."""
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    distance = np.repeat(first + lengths - 1, lengths) - at
    at += np.repeat(starts - first, lengths)
    return np.bitwise_xor.reduceat(_CONTRIBUTION[data[at].astype(np.int64) * REACH + distance], first)


def _long_crc(data: np.ndarray, start: int, length: int) -> int:
    """CRC of one span beyond the table: blocks counted from its end, folded in pairs."""
    blocks = -(-length // REACH)
    head = length - (blocks - 1) * REACH
    lengths = np.full(blocks, REACH, np.int64)
    lengths[0] = head
    values = _block_values(data, start + np.cumsum(lengths) - lengths, lengths)
    level = 0
    while len(values) > 1:
        if len(values) % 2:
            values = np.concatenate([np.zeros(1, np.uint32), values])
        values = _MOVES(values[0::2], level) ^ values[1::2]
        level += 1
    return int(values[0]) ^ crc32(bytes(length))


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of the bytes; spans may overlap and be of any length, also empty."""
    crcs = np.zeros(len(starts), np.uint32)
    usual = np.flatnonzero((lengths > 0) & (lengths <= REACH))
    if len(usual):
        ends = np.cumsum(lengths[usual])
        cuts = np.searchsorted(ends, np.arange(SPAN_BYTES, ends[-1] + SPAN_BYTES, SPAN_BYTES), "right")
        for piece in np.split(usual, np.unique(cuts)[:-1]):
            if len(piece):
                crcs[piece] = _block_values(data, starts[piece], lengths[piece]) ^ _LENGTH_CONSTANT[lengths[piece]]
    for i in np.flatnonzero(lengths > REACH):
        crcs[i] = _long_crc(data, int(starts[i]), int(lengths[i]))
    return crcs


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to `longest` words, shorter runs first."""
    if not words:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    runs = range(1, min(longest, len(words)) + 1)
    first = np.concatenate([starts[: len(words) - n + 1] for n in runs])
    last = np.concatenate([ends[n - 1 :] for n in runs])
    return span_crcs(data, first, last - first).astype(np.int64) % buckets


def _grouped(batch: pa.RecordBatch, longest: int, buckets: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of words of some rows, buckets of all their features, and the row of each feature.

    Rows are worked on together up to SPAN_BYTES: words of one follow those of another, and runs over their border
    are left out. A longer text makes a group by itself.
    """
    held: list[list[bytes]] = []
    size = 0
    for text in texts(batch["text"]):
        if held and size + len(text) > SPAN_BYTES:
            yield _features_of(held, longest, buckets)
            held, size = [], 0
        held.append(words_of(text))
        size += len(text)
    if held:
        yield _features_of(held, longest, buckets)


def _features_of(rows: list[list[bytes]], longest: int, buckets: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    counts = list(map(len, rows))
    words = [word for row in rows for word in row]
    found = feature_buckets(words, longest, buckets)
    row_of_word = np.repeat(np.arange(len(rows)), counts)
    runs = range(1, min(longest, len(words)) + 1)
    first = np.concatenate([row_of_word[: len(words) - n + 1] for n in runs]) if words else row_of_word
    last = np.concatenate([row_of_word[n - 1 :] for n in runs]) if words else row_of_word
    inside = first == last
    return counts, found[inside], first[inside]


def _counted(longest: int, buckets: int):
    """One row for each bucket that a task has seen, with the number of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in _grouped(batch, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return run


def bucket_counts(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Only this table, of fixed size, comes to the driver."""
    counted = rows.select("text").mapInArrow(_counted(longest, buckets), "bucket bigint, n bigint")
    counts = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, rounded down."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        floor(1000 * log(((t + 1) * (all_source + buckets)) / ((s + 1) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist())
    ])


def _weighed(bucket_gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for counts, found, rows in _grouped(batch, longest, len(bucket_gains)):
                features = np.bincount(rows, minlength=len(counts))
                # Whole numbers below 2**53 in number and size, so that sums in doubles are exact.
                sums = np.bincount(rows, bucket_gains[found], len(counts)).astype(np.int64)
                n_words += counts
                n_features += features.tolist()
                weights += (sums // np.maximum(features, 1)).tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_features": pa.array(n_features, pa.int64()),
                "weight": pa.array(weights, pa.int64()),
            })

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank; rank is null for those not drawn.

    `docs` has doc_id and text, `target` has text. Of the documents with at least `min_words` words,
    `percent` in a hundred are drawn, rounded down.
    """
    bucket_gains = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(
        _weighed(bucket_gains, longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("bigint")
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    return _ranked(scored, F.col("n_words") >= min_words, percent)


def _ranked(scored: DataFrame, eligible, percent: int) -> DataFrame:
    """Ranks by falling score for `percent` in a hundred of the eligible rows, null for the rest."""
    at_score = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    wanted = sum(row["n"] for row in at_score) * percent // 100
    before, offsets = 0, []
    for row in at_score:
        if before >= wanted:
            break
        offsets.append((row["score"], before))
        before += row["n"]
    columns = scored.columns
    if not offsets:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    spark = scored.sparkSession
    last = F.lit(offsets[-1][0]).cast("bigint")
    above = spark.createDataFrame(offsets, "score bigint, above bigint")
    # Equal rows are one row with their number, so that a row repeated very often is no large group.
    equal = scored.where(eligible & (F.col("score") >= last)).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    by_score = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "n_words")
    earlier = F.coalesce(F.sum("copies").over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = equal.withColumn("earlier", earlier).join(F.broadcast(above), "score")
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(PIECE).cast("bigint"))))
    copies = pieces.withColumn("copy", F.explode(F.sequence("piece", F.least(F.col("piece") + PIECE, "copies") - 1)))
    rank = F.col("above") + F.col("earlier") + F.col("copy") + 1
    drawn = copies.select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.where(~(eligible & (F.col("score") >= last))).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(rest)
