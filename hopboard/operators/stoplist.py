"""Upkeep of the stop-list table (word, created_at) as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopboard.functions.selecting import keep_where
from hopboard.functions.text import with_normalized
from hopboard.sources.storage import written

# Changes are folded in runs of about this many rows, the most that a task sorts for one word.
ROWS_PER_RUN = 1_000_000


def active_words(table: DataFrame) -> DataFrame:
    """Words in force: normalised, without invalid ones and repeats."""
    normalized = with_normalized(table.select(F.col("word").alias("stored")), F.col("stored"), "word")
    return keep_where(normalized, F.col("word").isNotNull(), "word").distinct()


def sorted_words(words: DataFrame) -> DataFrame:
    return words.select("word").orderBy("word")


def merged_words(table: DataFrame, words: DataFrame, created_at: Column) -> DataFrame:
    """Table and normalised new words with their status, from one pass over both.

    Every word of the table is `stored`, a new word that it lacks is `added` with the given time, and
    one that it has gives a row `conflict` more.
    """
    stored = table.select("word", "created_at", F.lit(True).alias("stored"))
    both = stored.join(active_words(words).withColumn("given", F.lit(True)), "word", "full_outer")
    statuses = (
        F.when(F.col("stored") & F.col("given"), F.array(F.lit("stored"), F.lit("conflict")))
        .when(F.col("stored"), F.array(F.lit("stored")))
        .otherwise(F.array(F.lit("added")))
    )
    time = F.when(F.col("stored"), F.col("created_at")).otherwise(created_at)
    return both.select("word", time.alias("created_at"), F.explode(statuses).alias("status"))


def insert_words(table: DataFrame, words: DataFrame, created_at: Column) -> DataFrame:
    """Table with the normalised new words added; words it has already are left as they are."""
    merged = merged_words(table, words, created_at)
    return merged.where(F.col("status") != "conflict").select("word", "created_at")


def conflicting_words(table: DataFrame, words: DataFrame) -> DataFrame:
    return active_words(words).join(table, "word", "left_semi")


def delete_words(table: DataFrame, words: DataFrame) -> DataFrame:
    """Table without the normalised words; a word that is absent is no error."""
    return table.join(active_words(words), "word", "left_anti")


def normalized_changes(changes: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Change log (seq, op, word, changed_at) with norm_word and run, normalised once and kept in the shared folder.

    The log is dealt into runs of about equal numbers of rows by ranges of seq, however seq is spread. The run
    is written with each row: ranges are drawn from a sample, and readers must agree on them.
    """
    given = with_normalized(changes.select("seq", "op", "word", "changed_at"), F.col("word"), "norm_word")
    runs = max(1, -(-changes.count() // rows_per_run))
    return written(given.repartitionByRange(runs, "seq").withColumn("run", F.spark_partition_id()), "changes")


def change_statuses(table: DataFrame, log: DataFrame) -> DataFrame:
    """Outcome of each change in a normalised log, applied in order of seq.

    `op` is add or remove. An add is `added`, or `conflict` if the word is there at that point; a
    remove is always `removed`; a word that does not normalise is `invalid`. The table is keyed by
    the text as stored, so a word stored unnormalised neither conflicts nor is removed. `echo` is
    the word as reported back: normalised for an add, as given for a remove.

    Seq is unique. No task sorts all changes of a word: a run leaves one row of state for each of its words,
    and a scan over these gives the state that each later run starts from. Invalid rows are dealt out by seq.
    """
    marked = log.select(
        "*",
        (F.col("op") == "add").alias("is_add"),
        F.coalesce("norm_word", F.concat(F.lit("\0"), F.pmod(F.xxhash64("seq"), F.lit(1024)).cast("string"))).alias("key"),
    )
    run_ends = marked.where("norm_word IS NOT NULL").groupBy("key", "run").agg(F.max_by("is_add", "seq").alias("is_add_last"))
    earlier_runs = Window.partitionBy("key").orderBy("run")
    run_starts = run_ends.select("key", "run", F.lag("is_add_last").over(earlier_runs).alias("at_start"))
    stored = table.select(F.col("word").alias("key"), F.lit(True).alias("stored")).distinct()
    run_starts = run_starts.join(stored, "key", "left").select(
        "key", "run", F.coalesce("at_start", "stored", F.lit(False)).alias("at_start")
    )
    within_run = Window.partitionBy("key", "run").orderBy("seq")
    judged = (
        marked.withColumn("previous", F.lag("is_add").over(within_run))
        .join(run_starts, ["key", "run"], "left")
        .withColumn("present_before", F.coalesce("previous", "at_start"))
    )
    status = (
        F.when(F.col("norm_word").isNull(), "invalid")
        .when(~F.col("is_add"), "removed")
        .when(F.col("present_before"), "conflict")
        .otherwise("added")
    )
    echo = F.when(F.col("is_add"), F.coalesce("norm_word", "word")).otherwise(F.col("word"))
    return judged.select("seq", "op", "word", "norm_word", "changed_at", status.alias("status"), echo.alias("echo"))


def changed_table(table: DataFrame, log: DataFrame) -> DataFrame:
    """Table after a normalised log: a word is there if an add follows its last remove.

    The first such add sets the time, but not for a stored word that was never removed.
    """
    valid = log.where("norm_word IS NOT NULL").select(F.col("norm_word").alias("word"), "op", "seq", "changed_at")
    removed = valid.where("op <> 'add'").groupBy("word").agg(F.max("seq").alias("removed_seq"))
    added = (
        valid.where("op = 'add'")
        .join(removed, "word", "left")
        .where("removed_seq IS NULL OR seq > removed_seq")
        .groupBy("word")
        .agg(F.min_by("changed_at", "seq").alias("added_at"), F.lit(True).alias("added"))
    )
    state = removed.join(added, "word", "full_outer")
    stored = table.select("word", "created_at", F.lit(True).alias("stored"))
    never_removed = F.col("stored") & F.col("removed_seq").isNull()
    created_at = F.when(never_removed, F.col("created_at")).otherwise(F.col("added_at"))
    kept = F.coalesce(never_removed, F.lit(False)) | F.coalesce("added", F.lit(False))
    return stored.join(state, "word", "full_outer").where(kept).select("word", created_at.alias("created_at"))

