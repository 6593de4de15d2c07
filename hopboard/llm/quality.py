"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled 1 in the training part; the documents as they come, whatever their
labels, are the unlabelled web text, for which the class prior holds. A linear model with logistic loss minimises
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),
the unbiased risk with its part for the negatives kept from falling below zero: where it would, that
part is left out. The prior is estimated from both kinds of text; labels 0 are not used.

A document is described by the frequencies of pairs of character classes, repetition of words and lines,
and its length, over its whole text. The model is fitted on at most SAMPLE positives and SAMPLE unlabelled
documents, those with the smallest hashes of their ids; all documents are scored.

Defined cases: null and empty texts have zero frequencies and get a score like any other. A document with
several labels counts as positive if one is 1. Labels without id or value are ignored. Without trusted
positives or unlabelled text every score is 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.llm.common import in_training, texts

SAMPLE = 20_000
THRESHOLD = 0.7
STEPS = 400
RATE = 0.05
DECAY = 1e-4


def _class_table() -> bytes:
    """Class of each byte: white space, letters by case, digits, frequent marks, other marks, non-ASCII."""
    classes = bytearray(256)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0x80:
            classes[byte] = 3
        elif char == "\n":
            classes[byte] = 1
        elif char.islower():
            classes[byte] = 2
        elif char.isupper():
            classes[byte] = 4
        elif char.isdigit():
            classes[byte] = 5
        elif char in ".,;:":
            classes[byte] = 6
        elif char in "!?":
            classes[byte] = 7
        elif char in "'\"()-":
            classes[byte] = 8
        elif not char.isspace():
            classes[byte] = 9
    return bytes(classes)


_CLASSES = 10
_TABLE = _class_table()
FEATURES = _CLASSES * _CLASSES + 6


def features(text: bytes) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    classes = np.frombuffer(text.translate(_TABLE), np.uint8)
    pairs = np.bincount(classes[:-1].astype(np.int64) * _CLASSES + classes[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / len(text))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    if words:
        out[-6] = np.sqrt(sum(map(eq, words, words[1:])) / len(words))
        out[-5] = len(set(words)) / len(words)
        out[-4] = min(len(text) / len(words), 50) / 50
        out[-3] = np.log1p(len(words)) / 10
    if lines:
        out[-2] = len(set(lines)) / len(lines)
    out[-1] = np.log1p(len(text)) / 10
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [features(text).tobytes() for text in texts(batch["text"])]
        yield pa.RecordBatch.from_pydict({"kind": batch["kind"], "doc_id": batch["doc_id"], "features": pa.array(values, pa.binary())})


class Model:
    """Linear margins on standardised features, turned into scores by the logistic function."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.spread, self.weights, self.bias = mean, spread, weights, bias

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.spread) @ self.weights + self.bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def constant_model(score: float) -> Model:
    score = min(max(score, 1e-6), 1 - 1e-6)
    return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(score / (1 - score))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS) -> Model:
    """Model with the least non-negative risk, by gradient steps on all rows with estimates of momentum."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-3, np.zeros(both.shape[1]), 0.0)
    p = np.c_[(positive - model.mean) / model.spread, np.ones(len(positive))]
    u = np.c_[(unlabelled - model.mean) / model.spread, np.ones(len(unlabelled))]
    if prior is None:
        prior = _prior_from_unlabelled(p, u)
    loss = lambda scores: -np.log1p(-scores.clip(max=1 - 1e-12)).mean()  # noqa: E731  of a negative
    w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        of_p, of_u = sigmoid(p @ w), sigmoid(u @ w)
        gradient = prior * (p.T @ (of_p - 1)) / len(p) + DECAY * w
        if loss(of_u) - prior * loss(of_p) >= 0:
            gradient += u.T @ of_u / len(u) - prior * (p.T @ of_p) / len(p)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def _prior_from_unlabelled(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in unlabelled text, from the part of it that looks most like positives.

    A model of labelled against unlabelled text gives every row a score, each half by the model of the other. Above
    any score lie a share of the unlabelled text and a share of the positives, whose ratio is the prior plus what
    negatives add there. The score with the least ratio, allowing for chance, is taken, and one standard error
    less: with a prior too high the negatives' part of the risk vanishes and all is called positive, while one
    a little low does no harm.
    """
    of_p, of_u = np.zeros(len(p)), np.zeros(len(u))
    for half in (0, 1):
        rows = np.concatenate([p[1 - half :: 2], u[1 - half :: 2]])
        labels = np.r_[np.ones(len(p[1 - half :: 2])), np.zeros(len(u[1 - half :: 2]))]
        w = np.zeros(rows.shape[1])
        for _ in range(200 if len(rows) else 0):
            w -= 0.5 * rows.T @ (sigmoid(rows @ w) - labels) / len(rows)
        of_p[half::2], of_u[half::2] = p[half::2] @ w, u[half::2] @ w
    cuts = np.quantile(of_p, np.linspace(0, 0.95, 39))
    in_p = (of_p[None, :] >= cuts[:, None]).mean(axis=1)
    in_u = (of_u[None, :] >= cuts[:, None]).mean(axis=1)
    chance = np.sqrt(2 / len(p)) + np.sqrt(2 / len(u))
    best = ((in_u + chance) / in_p).argmin()
    error = np.sqrt(in_u[best] * (1 - in_u[best]) / len(u)) / in_p[best]
    return float(np.clip(in_u[best] / in_p[best] - error, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from documents (doc_id, text) and the training part of labels (doc_id, quality)."""
    trusted = (
        labels.where(in_training("doc_id") & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    picked = _picked(docs, trusted, sample)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .select("doc_id", "text", "kind")
        .mapInArrow(_described, f"kind string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, features binary")
        .groupBy("kind", "doc_id").agg(F.any_value("features").alias("features"))
        .orderBy("kind", F.xxhash64("doc_id"), "doc_id").select("kind", "features").collect()
    )
    by_kind = {kind: [bytes(row["features"]) for row in rows if row["kind"] == kind] for kind in ("positive", "unlabelled")}
    matrix = {kind: np.frombuffer(b"".join(values), np.float32).reshape(-1, FEATURES) for kind, values in by_kind.items()}
    if not len(matrix["positive"]) or not len(matrix["unlabelled"]):
        return constant_model(0.5)
    return fit(matrix["positive"], matrix["unlabelled"])


def _picked(docs: DataFrame, trusted: DataFrame, sample: int) -> DataFrame:
    """At most `sample` ids of each kind; an id of the unlabelled text may be of another kind too."""
    first = lambda ids, kind: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("kind", F.lit(kind))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    positive = trusted.where("quality = 1").select("doc_id")
    return first(positive, "positive").unionByName(first(ids, "unlabelled"))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text) for text in texts(batch["text"])]
            scores = model.scores(np.array(rows)) if rows else np.array([])
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "text": batch["text"], "score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, model: Model, columns: list[str], with_text: bool = True) -> DataFrame:
    """Documents with `score` from 0 to 1; `columns` are passed on, and the text if asked for."""
    passed = [name for name in columns if name not in ("text", "score")]
    packed = docs.select(F.struct(*passed).alias("row"), "text")
    schema = f"row {packed.schema['row'].dataType.simpleString()}, text string, score double"
    scored = packed.mapInArrow(_scored(model), schema)
    return scored.select(*[F.col(f"row.`{name}`").alias(name) for name in passed], *(["text"] if with_text else []), "score")
