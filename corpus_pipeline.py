"""A training corpus from raw documents: judged, cleaned of shared lines, near copies and benchmark passages, and mixed.

Every stage takes the documents that the one before kept and decides on whole texts. All but the last return
the columns of their input; where a text changes and there is a column n_chars, it follows. Defined cases are
those of the operators; rows that repeat id and text are one document from the near-duplicate stage on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopboard.llm import quality
from hopboard.llm.common import read_table, text_key, written
from hopboard.llm.decontamination import contamination
from hopboard.llm.line_dedup import build_index, clean, line_keys
from hopboard.llm.minhash_dedup import near_duplicates
from hopboard.llm.mixing import mix


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by the labels, does not reject."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(_packed(docs), model, ["__row"])
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*_unpacked(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines in ten or more of them stay only in the first; those left without any text go.

    A text in many copies is so kept once instead of being lost with all its lines. Texts that were blank
    before stay as they are.
    """
    lines = line_keys(docs)
    cleaned = clean(_packed(docs), build_index(lines, min_docs=10), lines, keep_first=True)
    changed = F.col("n_dropped") > 0
    emptied = changed & (F.btrim("text", F.lit(" \t\n\v\f\r")) == "")
    columns = _unpacked(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns[docs.columns.index("n_chars")] = F.when(changed, length).otherwise(F.col("__row.given.n_chars")).alias("n_chars")
    return cleaned.where(~emptied).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    found = near_duplicates(docs, words=5, percent=80).where("kept")
    key = _free_name(docs)
    return _with_keys(docs, found, "left_semi", key).dropDuplicates(["doc_id", key]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10).where("contaminated")
    return _with_keys(docs, found, "left_anti", _free_name(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from them, 0 for those it leaves out."""
    return mix(docs, docs.columns).documents


STAGES = [
    ("quality_classifier", judge_quality),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# Signatures, classifier and draws are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all else in one column that no result column can clash with."""
    others = [name for name in docs.columns if name != "text"]
    row = F.struct(F.struct(*others).alias("given"), F.col("text").isNull().alias("no_text"))
    return docs.select("doc_id", "text", row.alias("__row"))


def _unpacked(docs: DataFrame) -> list[Column]:
    """The columns of the documents, null texts as they were."""
    text = F.when(~F.col("__row.no_text"), F.col("text")).alias("text")
    return [text if name == "text" else F.col(f"__row.given.`{name}`").alias(name) for name in docs.columns]


def _with_keys(docs: DataFrame, found: DataFrame, how: str, key: str) -> DataFrame:
    """Documents with (semi) or without (anti) a row of their id and text in `found`, and the key of their text."""
    keys = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"))
    keyed = docs.withColumn(key, text_key("text"))
    return keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["found_id"]) & (keyed[key] == keys["found_key"]), how)


def _free_name(docs: DataFrame) -> str:
    """A name for the key of the text that no column has."""
    name = "__text_key"
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name
