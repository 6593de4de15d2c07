"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

Every language has a distribution over buckets of hashed byte trigrams, counted over all training documents.
A document is a mixture of languages; expectation-maximisation estimates their proportions from its
trigrams. The set of languages is chosen by penalised likelihood: languages are taken in the order of
their proportions in the full mixture, as long as one more raises the likelihood by more than PENALTY
times the logarithm of the number of trigrams. Letters count, anything else ends a word.

The model has BUCKETS numbers per language, which bounds what the driver gathers and the tasks get. Tasks
add up counts before the shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing was
learned. Equal proportions and likelihoods go to the language that is first by name. Null languages are
not learned from. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.llm.common import in_training

BUCKETS = 1 << 14
SMOOTHING = 0.1
PENALTY = 4.0
ROUNDS = 12
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_TEXTS_HELD = 2_000_000


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of the letters and word ends of a text."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    letters = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    mixed = letters[:-2] * np.uint32(0x9E3779B1) ^ letters[1:-1] * np.uint32(0x85EBCA77) ^ letters[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        waiting: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            if text:
                waiting.setdefault(lang, []).append(text)
        for lang, held in waiting.items():
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for start, stop in _portions(held):
                counts[lang] += np.bincount(trigrams(" ".join(held[start:stop])), minlength=BUCKETS)
        if len(counts) > 64:
            yield _count_rows(counts)
            counts = {}
    if counts:
        yield _count_rows(counts)


def _portions(held: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for at, text in enumerate(held):
        size += len(text)
        if size > _TEXTS_HELD or at == len(held) - 1:
            yield start, at + 1
            start, size = at + 1, 0


def _count_rows(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    langs, buckets, n = [], [], []
    for lang, found in counts.items():
        some = np.flatnonzero(found)
        langs += [lang] * len(some)
        buckets.append(some)
        n.append(found[some])
    return pa.RecordBatch.from_pydict(
        {"lang": pa.array(langs, pa.string()), "bucket": pa.array(np.concatenate(buckets), pa.int32()), "n": pa.array(np.concatenate(n), pa.int64())}
    )


def _as_vector(rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [counts.tobytes()]})


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        shares = [(counts[lang] + SMOOTHING) / (counts[lang].sum() + SMOOTHING * BUCKETS) for lang in self.langs]
        self.chances = np.array(shares, np.float64).reshape(len(self.langs), BUCKETS)

    def proportions(self, text: str | None) -> dict[str, float]:
        """Language set with proportions, none if the text has no letter."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return {}
        counts = np.bincount(trigrams(text), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        n, p = counts[some].astype(np.float64), self.chances[:, some]
        weights, _ = mixture(n, p)
        order = np.argsort(-weights, kind="stable")
        # The best single language is known without iterations.
        alone = np.log(p) @ n
        chosen, best, shares = [int(np.argmax(alone))], float(alone.max()), np.array([1.0])
        order = [chosen[0], *(int(i) for i in order if i != chosen[0])]
        for size in range(2, len(order) + 1):
            weights, likelihood = mixture(n, p[order[:size]])
            if likelihood - best <= PENALTY * np.log(n.sum()):
                break
            chosen, best, shares = order[:size], likelihood, weights
        return {self.langs[i]: float(share) for i, share in zip(chosen, shares)}


def mixture(n: np.ndarray, p: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the rows of `p` that make counts `n` likely, and the log-likelihood."""
    weights = np.full(len(p), 1 / len(p))
    total = n.sum()
    for _ in range(rounds):
        weights = weights * (p @ (n / (weights @ p))) / total
    return weights, float(n @ np.log(weights @ p))


def train(docs: DataFrame) -> Model:
    """Model from the training part of documents (doc_id, text, lang), all of it."""
    learned = docs.where(in_training("doc_id") & F.col("lang").isNotNull()).select("lang", "text")
    counts = learned.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    vectors = counts.groupBy("lang").applyInPandas(_as_vector, "lang string, counts binary").collect()
    return Model({row["lang"]: np.frombuffer(bytes(row["counts"]), np.int64) for row in vectors})


def _identified(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.proportions(text) for text in batch["text"].to_pylist()]
            best = [max(sorted(shares), key=shares.get) if shares else UNKNOWN for shares in found]
            pairs = [[{"lang": lang, "share": share} for lang, share in shares.items()] for shares in found]
            yield pa.RecordBatch.from_pydict({
                "row": batch["row"],
                "lang_pred": pa.array(best, pa.string()),
                "score": pa.array([min(1.0, shares.get(lang, 0.0)) for shares, lang in zip(found, best)], pa.float64()),
                "languages": pa.array(pairs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
            })

    return run


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of the documents with lang_pred, score and all `languages` with their shares."""
    passed = [name for name in columns if name not in ("lang_pred", "score", "languages")]
    packed = docs.select(F.struct(*passed).alias("row"), "text")
    schema = f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    found = packed.mapInArrow(_identified(model), schema)
    return found.select(*[F.col(f"row.`{name}`").alias(name) for name in passed], "lang_pred", "score", "languages")
