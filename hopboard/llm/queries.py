"""The operators of this folder with production parameters, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hopboard.llm import html_extraction, language, quality, whitening
from hopboard.llm.common import in_training, read_table, scratch_path
from hopboard.llm.decontamination import contamination
from hopboard.llm.embedding_dedup import linked_vectors
from hopboard.llm.importance import resample
from hopboard.llm.line_dedup import build_index, clean, line_keys
from hopboard.llm.minhash_dedup import near_duplicates
from hopboard.llm.mixing import mix
from hopboard.llm.oracle import ORACLE_SQL
from hopboard.llm.token_counts import read_vocabulary, token_counts
from hopboard.llm.url_filter import judge
from hopboard.llm.warc import page_facts, page_records, read_warc, write_warc

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have.

    The texts of the benchmark are in the index for a while too and are deleted from it again, which must leave no trace.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    guests = line_keys(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item\n"), "text").alias("text")))
    lines = line_keys(docs)
    cleaned = clean(docs, build_index(lines, min_docs=10).insert(guests).delete(guests), lines)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    path = scratch_path(spark, "warc")
    write_warc(page_records(read_table(spark, sf_dir, "pages")), path)
    return page_facts(read_warc(spark, path))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")), ["doc_id"], with_text=False)
    return scored.select(
        "doc_id", (~in_training("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs), ["doc_id"])
    return found.select("doc_id", (~in_training("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and of each of their lines."""
    found = token_counts(read_table(spark, sf_dir, "documents"), read_vocabulary(spark), rule="largest")
    return found.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.col("section_tokens").cast("array<bigint>").alias("line_tokens"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at a cosine of 0.98 or more within a label."""
    return linked_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of three-word shingles overlap by 85 % or more."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of pages."""
    return judge(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score", "threshold")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside passages of ten words that a benchmark item has too."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources to their target weights takes from each document."""
    return mix(read_table(spark, sf_dir, "documents"), ["doc_id"]).documents


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    pages = read_table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages), ["page_id", "url"])


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by how much their words and pairs of words resemble the benchmark's."""
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings projected on their first eight principal components, each brought to unit variance."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_html_extraction": op11_html_extraction,
    "op12_importance": op12_importance,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}
