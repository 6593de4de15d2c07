"""Queries against their SQL, and stages of the pipeline against brute force."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hopboard.llm.common import written
from hopboard.llm.oracle import ORACLE_SQL
from hopboard.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_names():
    assert sorted(name.split("_")[0] for name in QUERIES) == sorted(["pipeline", *(f"op{n}" for n in range(1, 14))])
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLE_SQL[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = sorted(map(tuple, result.select(*columns).collect()), key=str)
    assert got == sorted(expected.fetchall(), key=str) and got


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF_DIR), name)
        steps[name] = (before, docs)
        assert docs.columns[:5] == columns

    before, after = steps["quality_classifier"]
    kept = {row["doc_id"] for row in after.collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [doc_id in kept for doc_id, quality in labels if quality == 1]
    bad = [doc_id in kept for doc_id, quality in labels if quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)

    before, after = steps["line_dedup"]
    lines = {}
    rows = before.orderBy("doc_id").collect()
    key = lambda line: line.encode().strip().lower()
    for row in rows:
        for line in row["text"].split("\n"):
            lines.setdefault(key(line), []).append(row["doc_id"])
    frequent = {k: min(ids) for k, ids in lines.items() if k and len(set(ids)) >= 10}
    assert frequent
    want = {}
    for row in rows:
        left = "\n".join(line for line in row["text"].split("\n") if frequent.get(key(line), row["doc_id"]) == row["doc_id"])
        if left.strip() or left == row["text"]:
            want[row["doc_id"]] = (left, len(left))
    assert {row["doc_id"]: (row["text"], row["n_chars"]) for row in after.collect()} == want

    before, after = steps["minhash_dedup"]
    sets = {row["doc_id"]: shingles(row["text"]) for row in before.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    by_shingle = {}
    for i in ids:
        for shingle in sets[i]:
            by_shingle.setdefault(shingle, []).append(i)
    pairs = {(a, b) for group in by_shingle.values() for a in group for b in group if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert linked and {row["doc_id"] for row in after.collect()} == {i for i in ids if root[i] == i}

    before, after = steps["decontamination"]
    clean = lambda text: " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= "\x80" else " " for c in "".join(c.lower() if c < "\x80" else c for c in text)).split())
    windows = set()
    for (text,) in duck.execute("SELECT text FROM benchmark").fetchall():
        words = clean(text).split()
        windows |= {" ".join(words[i : i + 10]) for i in range(max(1, len(words) - 9))}
    cleaned = {row["doc_id"]: f" {clean(row['text'])} " for row in before.collect()}
    tainted = {doc_id for doc_id, text in cleaned.items() if any(f" {window} " in text for window in windows)}
    assert tainted and {row["doc_id"] for row in after.collect()} == {row["doc_id"] for row in before.collect()} - tainted

    before, after = steps["mixing"]
    assert sorted(row["doc_id"] for row in after.collect()) == sorted(row["doc_id"] for row in before.collect())
    for row in after.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(row["sum(taken)"] - row["max(target)"]) <= 0.02 * row["max(target)"]


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "some words\nof a text"), (None, "some words\nof a text"), (3, " \n "), (4, "word " * 30_000)]
    frame = spark.createDataFrame([(*row, "en", None, 5, 0.5, "x") for row in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, row string")
    for clash in ("__no_text", "__text_key", "__row", "found_id", "no_text", "given"):
        frame = frame.withColumn(clash, F.lit("mine"))
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    # Without labels every score is 0.5, below the limit.
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:]:
        frame = written(stage(spark, frame, str(tmp_path)), name)
        assert frame.schema["score"].dataType.simpleString() == "double" and "row" in frame.columns
        assert frame.where("__no_text <> 'mine' OR __text_key <> 'mine' OR found_id <> 'mine' OR given <> 'mine'").isEmpty()
    got = sorted(((row["doc_id"], row["text"] and row["text"][:10], row["score"]) for row in frame.collect()), key=str)
    assert got == sorted([(1, None, 0.5), (2, "", 0.5), (None, "some words", 0.5), (3, " \n ", 0.5), (4, "word word ", 0.5)], key=str)
