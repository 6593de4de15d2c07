"""Whitening of embeddings by their leading principal components, found by Golub-Kahan-Lanczos bidiagonalisation.

Entries are turned into whole numbers, x = floor(scale * c) + shift, and centred before they are multiplied:
rows of X are x - S/n with exact sums S, so that the shift costs no digits. The process alternates the two
distributed products X v and X' u, each made orthogonal to all earlier vectors of its side, which turns X into a
small bidiagonal matrix; the singular vectors of that give the components, its singular values the deviations.

The process runs in its block form: v and u are blocks of as many vectors as components are wanted, so that
one pass over the rows serves all of them, and equal eigenvalues up to that many times are found. The vectors u
have an entry for every row and are never stored: each is X w for a short w on the driver, and a task that has
its rows at hand works out what it needs of them. A pass returns X'Xw, the products of X w with all earlier u, and
those within the block; sums are combined in each task before they are shuffled by their place. A block is
corrected until it is orthonormal to rounding. The process ends once all wanted triplets have residuals at
rounding level, or when no direction is left; then the bidiagonal matrix holds all of X.

The driver holds some blocks of vectors with one entry per dimension, never one per row.

Defined cases: rows whose vector is null or has null or non-finite entries are left out, as are entries beyond
LARGEST in size, and vectors whose length is not the most frequent one (the longer of those equally frequent).
Directions without variance, up to rounding (FLOOR of the largest eigenvalue), are no components, so one
vector or equal vectors give no rows. Rows that repeat count and come out as often as they occur. `deviation` is
null where it does not fit 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = 2.0**40
SEED = 13

# Relative sizes at which a residual is rounding, a direction is absent, a variance is none, a correction is the last.
SETTLED = 1e-15
ABSENT = 1e-13
FLOOR = 1e-13
CLEAN = 1e-7
# Entries of a block of rows that a task works on at once.
ENTRIES = 1 << 21


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector (-1 for null), and whether all of its entries are there and within LARGEST."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(entries) <= LARGEST))])
    ends = np.cumsum(np.maximum(sizes, 0))
    return sizes, (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])


def _length(vectors: DataFrame) -> int:
    """Most frequent length of a usable vector; 0 if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            sizes, good = _usable(batch["embedding"])
            counts.update(sizes[good].tolist())
        yield pa.RecordBatch.from_pydict({
            "length": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())
        })

    lengths = vectors.select("embedding").mapInArrow(run, "length bigint, n bigint").groupBy("length").agg(F.sum("n").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return first["length"] if first else 0


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of a batch that are in the fit list, and their x, in parts of bounded size."""
    if not length:
        return
    part = max(1, ENTRIES // length)
    for first in range(0, batch.num_rows, part):
        column = batch["embedding"].slice(first, part)
        sizes, good = _usable(column)
        rows = np.flatnonzero(good & (sizes == length))
        if len(rows):
            entries = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield first + rows, np.floor(SCALE * entries.reshape(-1, length)).astype(np.int64) + SHIFT


def _summed(vectors: DataFrame, length: int, size: int, task: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the `size` numbers that each makes of its x; they are shuffled by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(x for batch in batches for _, x in _blocks(batch, length))
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(size), pa.int32()), "part": pa.array(total)})

    kind = task(iter(())).dtype
    parts = vectors.select("embedding").mapInArrow(run, f"place int, part {'bigint' if kind == np.int64 else 'double'}")
    out = np.zeros(size, kind)
    for row in parts.groupBy("place").agg(F.sum("part").alias("part")).collect():
        out[row["place"]] = row["part"]
    return out


@dataclass
class Centring:
    """Number of vectors in the fit list, their length and exact sums."""

    length: int
    n: int
    sums: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean goes first, which is exact."""
        whole = self.sums // self.n
        return (x - whole).astype(np.float64) - (self.sums - whole * self.n) / self.n


def centring(vectors: DataFrame) -> Centring:
    length = _length(vectors)

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(length + 1, np.int64)
        for x in blocks:
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        return total

    total = _summed(vectors, length, length + 1, task)
    return Centring(length, int(total[0]), total[1:])


def _variance(vectors: DataFrame, centre: Centring) -> float:
    """Trace of the covariance."""

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        return np.array([sum((centre.rows(x) ** 2).sum() for x in blocks)], np.float64)

    return float(_summed(vectors, centre.length, 1, task)[0]) / centre.n


def _products(vectors: DataFrame, centre: Centring, left: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For Y = X block: products of the earlier u = X left with Y, of Y with itself, and of X with Y."""
    d, (k, b) = centre.length, (left.shape[1], block.shape[1])

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        crossed, own, back = np.zeros((k, b)), np.zeros((b, b)), np.zeros((d, b))
        for x in blocks:
            rows = centre.rows(x)
            y = rows @ block
            crossed += (rows @ left).T @ y
            own += y.T @ y
            back += rows.T @ y
        return np.concatenate([crossed.ravel(), own.ravel(), back.ravel()])

    total = _summed(vectors, d, (k + b + d) * b, task)
    crossed, own, back = np.split(total, [k * b, (k + b) * b])
    return crossed.reshape(k, b), own.reshape(b, b), back.reshape(d, b)


@dataclass
class Bidiagonal:
    """Right vectors v, the w of left vectors u = X w, their products X'u, and what X'u of the last block has beyond all v."""

    right: np.ndarray
    left: np.ndarray
    back: np.ndarray
    rest: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """Products of left and right vectors through X: block bidiagonal up to rounding."""
        return self.back.T @ self.right

    def triplets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right singular vectors of X as columns, and the sizes of their residuals."""
        p, sigma, q = np.linalg.svd(self.matrix, full_matrices=False)
        missing = np.linalg.norm(self.rest @ p[p.shape[0] - self.rest.shape[1] :], axis=0)
        return sigma, self.right @ q.T, missing


def _left_block(vectors: DataFrame, centre: Centring, known: Bidiagonal, fresh: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """X fresh made orthonormal to all earlier u, as its w, with the products X'u and the largest size met.

    The parts along earlier u are known from X'u. A pass over the rows measures what is left of them and how the
    vectors of the block stand to each other, and is repeated until what it corrects is small.
    """
    block, smallest = fresh - known.left @ (known.back.T @ fresh), None
    while True:
        crossed, own, back = _products(vectors, centre, known.left, block)
        own = own - crossed.T @ crossed
        block, back = block - known.left @ crossed, back - known.back @ crossed
        size = np.sqrt(np.maximum(np.diag(own), 0))
        if smallest is None:
            scale = max(scale, float(size.max()))
            smallest = ABSENT * scale
        there = size > smallest
        values, turn = np.linalg.eigh(own[np.ix_(there, there)] / np.outer(size[there], size[there]))
        strong = values > ABSENT
        turn = turn[:, strong] / np.sqrt(values[strong]) / size[there][:, None]
        block, back, smallest = block[:, there] @ turn, back[:, there] @ turn, ABSENT
        small = np.abs(crossed[:, there] / size[there]).max(initial=0) < CLEAN and values.min(initial=1) > np.sqrt(CLEAN)
        if small or not block.shape[1]:
            return block, back, scale


def _right_block(back: np.ndarray, right: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions of X'u outside the span of all earlier v, and the parts of X'u along them."""
    block = back
    for _ in range(2):
        block = block - right @ (right.T @ block)
    fresh, sizes, _ = np.linalg.svd(block, full_matrices=False)
    fresh = fresh[:, sizes > ABSENT * scale]
    for _ in range(2):
        fresh, _ = np.linalg.qr(fresh - right @ (right.T @ fresh))
    return fresh, fresh.T @ block


def bidiagonalise(vectors: DataFrame, centre: Centring, wanted: int = COMPONENTS, seed: int = SEED) -> Bidiagonal:
    """Block process from a random start until `wanted` triplets are settled or all of X is there."""
    d = centre.length
    fresh, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(wanted, d))))
    known, scale = Bidiagonal(np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))), 0.0
    while True:
        block, back, scale = _left_block(vectors, centre, known, fresh, scale)
        right = np.hstack([known.right, fresh])
        fresh, rest = _right_block(back, right, scale)
        known = Bidiagonal(right, np.hstack([known.left, block]), np.hstack([known.back, back]), rest)
        if not fresh.shape[1]:
            return known
        sigma, _, missing = known.triplets()
        if len(sigma) >= wanted and (missing[:wanted] <= SETTLED * sigma[0]).all():
            return known


@dataclass
class Whitening:
    """Components as columns, with the eigenvalues of the covariance and its trace."""

    centre: Centring
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.components / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening:
    """The first components of the vectors in column `embedding`; none where there is no variance."""
    centre = centring(vectors)
    variance = _variance(vectors, centre) if centre.n > 1 else 0.0
    if not variance:
        return Whitening(centre, np.zeros((centre.length, 0)), np.zeros(0), 0.0)
    sigma, right, _ = bidiagonalise(vectors, centre, wanted).triplets()
    sigma, right = sigma[:wanted], right[:, :wanted]
    kept = sigma**2 > FLOOR * sigma[0] ** 2
    components = right[:, kept] / np.linalg.norm(right[:, kept], axis=0)
    largest = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[largest, np.arange(components.shape[1])])
    return Whitening(centre, components, sigma[kept] ** 2 / centre.n, variance)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry in size of the covariance of whitened rows less the identity."""
    k = len(model.eigenvalues)
    if not k:
        return None

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x in blocks:
            rows = model.whitened(x)
            total[0] += rows.sum(axis=0)
            total[1:] += rows.T @ rows
        return total.ravel()

    total = _summed(vectors, model.centre.length, (k + 1) * k, task).reshape(k + 1, k) / model.centre.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def _deviations(x: np.ndarray, centre: Centring) -> list[int | None]:
    """Sums of (n x - S)^2, in numbers of any size where 64 bits may not do."""
    n, sums = centre.n, centre.sums
    largest = max(abs(int(x.max())), abs(int(x.min()))) * n + int(np.abs(sums).max())
    if largest < 2**63:
        steps = n * x - sums
        largest = max(abs(int(steps.max())), abs(int(steps.min())))
        if largest * largest * x.shape[1] < 2**63:
            return (steps**2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(value) if value < 2**63 else None for value in exact]


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for every vector of the fit list and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    `vectors` are those that the model was fitted on.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centre, k = model.centre, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch, centre.length) if k else ():
                values = pa.array(model.whitened(x).ravel(), pa.float64())
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"].take(pa.array(rows)),
                    "deviation": pa.array(_deviations(x, centre), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), values),
                })

    found = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>")
    shares = F.array(*[F.lit(float(value / model.variance)) for value in model.eigenvalues]).cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(centre.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "place").alias("explained"),
        F.lit(identity_error(vectors, model)).cast("double").alias("identity_error"),
    )
