import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopboard.llm import decontamination
from hopboard.llm.decontamination import WuManber, contamination


def words_of(text):
    kept = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return "".join(c if c >= "\x80" or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in kept).split(" ")


def brute_force(texts, items, window):
    patterns = []
    for item_id, text in items:
        words = [w for w in words_of(text) if w]
        patterns += [(item_id, words[i : i + window]) for i in range(max(1, len(words) - window + 1)) if words]
    out = []
    for i, text in enumerate(texts):
        words = [w for w in words_of(text) if w]
        hit, found = set(), set()
        for item_id, pattern in patterns:
            for at in range(len(words) - len(pattern) + 1):
                if words[at : at + len(pattern)] == pattern:
                    hit |= set(range(at, at + len(pattern)))
                    found |= {str(item_id)} if item_id is not None else set()
        out.append((i, len(words), len(hit), sorted(found), bool(hit)))
    return out


ITEMS = [
    (1, "Alpha beta, gamma DELTA epsilon zeta"), (2, "beta gamma delta"), (10, "short"), (10, "second text of ten more words"),
    (3, None), (4, " .,! "), (None, "nameless item here"), (5, "É ß 12 x"), (6, "aa aa aa"), (7, "beta gamma delta"),
]
TEXTS = [
    None, "", "...", "alpha beta gamma delta epsilon zeta", "beta-gamma_delta!", "alphabet gamma delta epsilon zeta", "SHORT", "shorts", "a short b short",
    "é ß 12 x", "É ß 12 x\x7f", "aa aa aa aa aa", "the nameless item here", "filler " * 20_000 + "gamma delta epsilon zeta", "second text of ten more",
    "x beta gamma\x00delta y beta gamma delta",
]


@pytest.mark.parametrize("window, shard", [(3, 1000), (3, 2), (4, 3), (10, 1000), (1, 5)])
def test_matches_brute_force(spark, docs, window, shard):
    benchmark = spark.createDataFrame([(*item, "clash") for item in ITEMS], "item_id long, text string, doc_id string")
    found = contamination(docs(TEXTS), benchmark, window, shard).orderBy("doc_id").collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found]
    assert got == brute_force(TEXTS, ITEMS, window)
    assert all(r["n_hit"] == sum(s["stop"] - s["start"] for s in r["hit_spans"]) for r in found)


def test_repeated_rows_and_empty_tables(spark, docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = spark.createDataFrame([(1, "short"), (1, "short"), (None, "short"), (None, None), (1, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in contamination(rows, benchmark, 3, 2).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 0, 0), (1, 1, 0)], key=str)
    assert not any(r["contaminated"] for r in contamination(docs(TEXTS), benchmark.limit(0)).collect())
    assert contamination(docs(["a"]).limit(0), benchmark).count() == 0


def test_documents_are_read_once_however_many_shards(spark, docs, tmp_path, monkeypatch):
    frame = docs(TEXTS * 3)
    frame.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontamination, "CHUNK", 200)
    found = contamination(stored, benchmark, 3, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan
    got = [(r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found.orderBy("doc_id").collect()]
    assert got == [row[1:] for row in brute_force(TEXTS * 3, ITEMS, 3)]


def test_tables_are_built_once_for_a_task_with_one_shard(spark, tmp_path, monkeypatch):
    built = []
    shard = decontamination._Shard
    monkeypatch.setattr(decontamination, "_Shard", lambda *args: built.append(args) or shard(*args))
    monkeypatch.setattr(decontamination, "CHUNK", 1)
    spark.createDataFrame([(b" a b ", "1", 0)], "string binary, item_id string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "w"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text_key": [0, 0], "text": ["x a b", "b a"]})
    rows = [row for out in decontamination._searched(str(tmp_path / "w"), 1)(iter([batch, batch])) for row in out.to_pylist()]
    assert [row["n_hit"] for row in rows] == [2, 0, 2, 0] and len(built) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), min_size=1, max_size=8), st.text("ab ", max_size=80))
def test_search_finds_every_occurrence(strings, text):
    strings = sorted({s.encode() for s in strings})
    text = text.encode()
    want = sorted((at, s) for s in strings for at in range(len(text)) if text.startswith(s, at))
    assert sorted(WuManber(strings).search(text)) == want
