"""Token counts of documents and their sections, from one encoding of each whole document.

A document is encoded once, as tokens depend on what stands around them. The lengths of the tokens' byte
strings add up to the text, so every token has a stretch of bytes; sections are stretches of the text too.
Both are in order, and the join of the two finds, for the ends of every section, the tokens there by binary
search. A token that crosses a boundary is given by the rule:

* `first`: to the section of its first byte,
* `largest`: to the section with most of its bytes, the earlier one if equal,
* `shared`: to each in proportion to its bytes.

Bytes outside all sections count for none (`n_outside`), so section counts and this add up to the tokens of
the document. Without given sections, a document's lines are its sections, each with its line end.

Defined cases: null and empty texts have no tokens and, by lines, one empty section. Sections that are empty
or reach past the text get what is inside; one without start begins with the text, one without stop ends
with it, and a null name stays null. Sections of a document must not overlap, else it raises. Rows are
reported one by one. Sections of ids that no document has are left out. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.llm.common import texts

RULES = ("first", "largest", "shared")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how this vocabulary's text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The rank file, some 1 MB; a path without scheme is the driver's own, so executors need not have it."""
    if "://" not in path:
        return Path(path).read_bytes()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def encoding(vocabulary: bytes):
    """The tokenizer, and the byte length of every token."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    bounds = np.concatenate([[0], ends, [len(text)]])
    return bounds[:-1], bounds[1:]


def byte_offsets(text: bytes, chars: np.ndarray) -> np.ndarray:
    """Byte offset of each character offset; offsets past the end give the length."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    starts = np.append(starts, len(text))
    return starts[np.clip(chars, 0, len(starts) - 1)]


def attribute(token_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary. Sections are in order and apart from each other."""
    counts = np.zeros(len(starts))
    if not len(token_ends) or not len(starts):
        return counts, 0
    token_starts = np.concatenate([[0], token_ends[:-1]])
    # Every section with the tokens that it overlaps, as a list of (section, token, bytes in common).
    first = np.searchsorted(token_ends, starts, side="right")
    last = np.searchsorted(token_starts, stops, side="left")
    n = np.where(stops > starts, np.maximum(last - first, 0), 0)
    section = np.repeat(np.arange(len(starts)), n)
    token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    common = np.minimum(token_ends[token], stops[section]) - np.maximum(token_starts[token], starts[section])
    inside = common == token_ends[token] - token_starts[token]
    crossing = len(np.unique(token[~inside]))
    if rule == "shared":
        np.add.at(counts, section, common / (token_ends[token] - token_starts[token]))
        return counts, crossing
    if rule == "first":
        keep = (starts[section] <= token_starts[token]) & (token_starts[token] < stops[section])
    else:
        order = np.lexsort((section, -common, token))
        keep = np.zeros(len(token), bool)
        keep[order[np.concatenate([[True], np.diff(token[order]) > 0])] if len(order) else []] = True
    np.add.at(counts, section[keep], 1)
    return counts, crossing


def _counted(vocabulary: bytes, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = encoding(vocabulary)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens", "section_names")}
            sections = batch["sections"].to_pylist() if given else [None] * batch.num_rows
            for text, listed in zip(texts(batch["text"]), sections):
                ends = np.cumsum(lengths[tokenizer.encode_ordinary(text.decode())]) if text else np.array([], np.int64)
                if given:
                    listed = sorted(listed or [], key=lambda s: (s["start"], s["stop"], str(s["name"])))
                    starts = byte_offsets(text, np.array([s["start"] for s in listed], np.int64))
                    stops = byte_offsets(text, np.array([s["stop"] for s in listed], np.int64))
                    full = stops > starts
                    if (starts[full][1:] < stops[full][:-1]).any():
                        raise ValueError("sections of a document overlap")
                else:
                    starts, stops = line_sections(text)
                counts, crossing = attribute(ends, starts, stops, rule)
                out["n_tokens"].append(len(ends))
                out["n_sections"].append(len(starts))
                out["n_crossing"].append(crossing)
                out["n_outside"].append(max(0.0, float(len(ends) - counts.sum())))
                out["section_tokens"].append(counts.tolist())
                out["section_names"].append([s["name"] for s in listed] if given else [])
            doubles = pa.list_(pa.float64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), doubles, pa.list_(pa.string())]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], **{name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}}
            )

    return run


def token_counts(docs: DataFrame, vocabulary: bytes, rule: str = "largest", sections: DataFrame | None = None) -> DataFrame:
    """Tokens of each document (doc_id, text) and of its sections.

    `sections` (doc_id, name, start, stop) are stretches of characters. Results are doc_id, n_tokens, n_sections,
    n_crossing, n_outside, section_tokens in the order of the sections, and section_names.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {', '.join(RULES)}")
    rows = docs.select("doc_id", "text")
    if sections is not None:
        listed = sections.groupBy(F.col("doc_id").alias("of")).agg(
            F.collect_list(F.struct(
                F.col("name").cast("string").alias("name"),
                F.coalesce(F.col("start").cast("bigint"), F.lit(0)).alias("start"),
                F.coalesce(F.col("stop").cast("bigint"), F.lit(2**62)).alias("stop"),
            )).alias("sections")
        )
        rows = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "sections")
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_sections bigint, n_crossing bigint, "
        "n_outside double, section_tokens array<double>, section_names array<string>"
    )
    return rows.mapInArrow(_counted(vocabulary, rule, sections is not None), schema)
