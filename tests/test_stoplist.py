import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hopboard.operators.stoplist import (
    active_words,
    change_statuses,
    changed_table,
    conflicting_words,
    delete_words,
    insert_words,
    normalized_changes,
    sorted_words,
)

START = datetime(2024, 1, 1)
TABLE = "word STRING, created_at TIMESTAMP"
CHANGES = "seq BIGINT, op STRING, word STRING, changed_at TIMESTAMP"


def table_of(spark, *words):
    return spark.createDataFrame([(word, START) for word in words], TABLE)


def log_of(spark, *changes):
    rows = [(i, op, word, START + timedelta(minutes=i + 1)) for i, (op, word) in enumerate(changes)]
    return spark.createDataFrame(rows, CHANGES)


def words(frame):
    return [row["word"] for row in frame.collect()]


def test_words_in_force(spark):
    table = table_of(spark, "click 14", " VIEW 1 ", "purchase", "   ", "CLICK  14", "x" * 257)
    assert words(sorted_words(active_words(table))) == ["click 14", "purchase", "view 1"]


def test_insert_reports_conflicts_and_normalises(spark):
    table = table_of(spark, "spam", "ads")
    new = table_of(spark, " SPAM ", "Ads", "new", "New ", " ")
    grown = insert_words(table, new, F.lit(START + timedelta(days=1)))
    assert sorted(words(grown)) == ["ads", "new", "spam"]
    assert grown.where("word = 'spam'").first()["created_at"] == START
    assert sorted(words(conflicting_words(table, new))) == ["ads", "spam"]


def test_delete_is_idempotent(spark):
    table = table_of(spark, "spam", "ads")
    assert words(delete_words(table, table_of(spark, "SPAM", "absent"))) == ["ads"]


def statuses_of(frame):
    return [row["status"] for row in frame.orderBy("seq").collect()]


@pytest.mark.parametrize("run", [1, 2, 1000])
def test_statuses_of_a_change_log(spark, run):
    log = log_of(
        spark, ("add", " SPAM "), ("add", "spam"), ("remove", "Spam"), ("add", "spam"),
        ("add", "ads"), ("remove", "absent"), ("add", "  "), ("remove", ""), ("add", "STORED RAW"),
    )
    statuses = change_statuses(table_of(spark, "ads", " stored raw"), normalized_changes(log, run))
    assert statuses_of(statuses) == [
        "added", "conflict", "removed", "added", "conflict", "removed", "invalid", "invalid", "added",
    ]
    echoes = [row["echo"] for row in statuses.orderBy("seq").collect()]
    assert echoes[0] == "spam" and echoes[2] == "Spam"


def fold(base, log):
    """One change after the other on a plain dictionary."""
    table, statuses = dict(base), []
    for seq, op, word, changed_at in log:
        word = " ".join(word.lower().split())
        if not word:
            statuses.append("invalid")
        elif op == "remove":
            table.pop(word, None)
            statuses.append("removed")
        elif word in table:
            statuses.append("conflict")
        else:
            table[word] = changed_at
            statuses.append("added")
    return table, statuses


@pytest.mark.parametrize("run, power", [(30, 1), (1000, 1), (30, 5)])
def test_change_log_equals_folding_one_by_one(spark, run, power):
    """With seq that runs on evenly, and with gaps that grow."""
    random.seed(run)
    texts = ["hot", " HOT", "hot ", "a", "B", "b", " ", "c  c", "C C"]
    log = [
        (seq**power, random.choice(["add", "remove"]), random.choice(texts), START + timedelta(minutes=seq + 1))
        for seq in range(300)
    ]
    base = {"hot": START, "z": START}
    table = spark.createDataFrame(list(base.items()), TABLE)
    changes = normalized_changes(spark.createDataFrame(log, CHANGES), run)
    statuses = change_statuses(table, changes)
    expected_table, expected_statuses = fold(base, log)
    assert statuses_of(statuses) == expected_statuses
    got = {row["word"]: row["created_at"] for row in changed_table(table, changes).collect()}
    assert got == expected_table


def test_runs_are_ranges_of_about_equal_numbers_of_rows(spark):
    log = spark.range(2000).selectExpr("id * id * id AS seq", "'add' AS op", "'hot' AS word", "TIMESTAMP'2024-01-01' AS changed_at")
    runs = normalized_changes(log.repartition(7), 200).groupBy("run").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    rows = runs.orderBy("run").collect()
    assert [row["run"] for row in rows] == list(range(10)) and max(row["n"] for row in rows) <= 400
    assert all(before["b"] < after["a"] for before, after in zip(rows, rows[1:]))


def test_a_hot_word_spans_runs_and_no_list_of_cuts_is_compared(spark):
    """Two words change in turn all over the log; at each run's start the state comes from the runs before."""
    log = [(seq, "add" if seq % 4 < 2 else "remove", ("hot", "rare")[seq % 97 == 0], START) for seq in range(1000)]
    changes = normalized_changes(spark.createDataFrame(log, CHANGES), 50)
    spans = changes.where("norm_word = 'hot'").select("run").distinct().count()
    assert spans == 20
    statuses = change_statuses(table_of(spark, "rare"), changes)
    assert statuses_of(statuses) == fold({"rare": START}, log)[1]
    plan = statuses._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan and "lambda" not in plan


def test_an_empty_log_changes_nothing(spark):
    changes = normalized_changes(log_of(spark, ("add", "a")).limit(0))
    assert change_statuses(table_of(spark, "a"), changes).collect() == []
    assert words(changed_table(table_of(spark, "a"), changes)) == ["a"]


def test_log_and_table_are_read_once(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # long paths in full
    table_of(spark, "a").write.parquet(str(tmp_path / "table"))
    log = normalized_changes(log_of(spark, ("add", "b"), ("remove", "a")))
    table = spark.read.parquet(str(tmp_path / "table"))
    for frame in (changed_table(table, log), change_statuses(table, log)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [word") + plan.count("/table") <= 3 and plan.count(f"{tmp_path}/table") == 1
