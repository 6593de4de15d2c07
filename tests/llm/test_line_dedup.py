from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopboard.llm import line_dedup
from hopboard.llm.line_dedup import CuckooFilter, LineIndex, build_index, clean, line_keys

BLANK = " \t\n\v\f\r"


def expected(texts, min_docs, min_chars=1):
    key = lambda line: "".join(c.lower() if c < "\x80" else c for c in line.strip(BLANK))
    seen = {}
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    gone = {k for k, ids in seen.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


TEXTS = [
    None, "", "\n\n", "Shared Line\nown a", " shared line\t\nown b", "SHARED LINE\r\nSHARED LINE", "É line\nshared line ",
    "é line\nother", "É line\n" + "long " * 30_000, "twice\ntwice\ntwice", "twice", " shared line\nx", "own a", "É line",
]


def cleaned(frame, index, lines, **options):
    rows = clean(frame, index, lines, **options).orderBy("doc_id").collect()
    return [(row["n_lines"], row["n_dropped"], row["text"]) for row in rows]


def test_matches_brute_force(docs):
    frame = docs(TEXTS)
    for min_docs, min_chars in ((2, 1), (3, 1), (2, 6), (100, 1)):
        lines = line_keys(frame, min_chars)
        result = clean(frame, build_index(lines, min_docs), lines)
        assert sorted(result.columns) == sorted(["doc_id", "source", "n_chars", "score", "row", "text", "n_lines", "n_dropped"])
        assert cleaned(frame, build_index(lines, min_docs), lines) == expected(TEXTS, min_docs, min_chars)


def test_filters_decide_most_frequent_keys(spark):
    """On the small tables no key is hot: all frequent ones go through the filters."""
    lines = line_keys(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    index = build_index(lines, 10)
    frequent = index.counts.where("n_docs >= 10").count()
    members = sum((CuckooFilter.from_bytes(bytes(r["slots"])).slots > 0).sum() for r in index.filters.collect())
    assert frequent == members > 0
    assert index.counts.where(f"n_docs >= {line_dedup.HOT_DOCS}").isEmpty()
    without = replace(index, filters=index.filters.limit(0))
    assert without.frequent_lines(lines).isEmpty() and not index.frequent_lines(lines).isEmpty()


def test_hot_keys_are_decided_where_the_lines_are(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_DOCS", 1)
    frame = docs(TEXTS)
    lines = line_keys(frame)
    index = build_index(lines, 2)
    assert cleaned(frame, replace(index, filters=index.filters.limit(0)), lines) == expected(TEXTS, 2)


def test_documents_are_inserted_once_and_ghosts_refused(spark, docs):
    frame = docs(TEXTS)
    first, second = line_keys(frame.where("doc_id < 7")), line_keys(frame.where("doc_id >= 5"))
    whole = LineIndex.empty(spark, 2, 4).insert(first).insert(second)
    counts = lambda index: sorted(map(tuple, index.counts.collect()))
    assert counts(whole) == counts(build_index(line_keys(frame), 2)) == counts(whole.insert(second))
    # Known lines of documents that were never there: counts alone would not tell.
    ghosts = line_keys(frame.withColumn("doc_id", F.col("doc_id") + 100).limit(4))
    with pytest.raises(Exception, match="never inserted"):
        whole.delete(ghosts)
    with pytest.raises(Exception, match="never inserted"):
        whole.delete(second).delete(second)
    assert counts(whole.delete(second).insert(second)) == counts(whole)


def test_shards_split_and_full_filters_are_built_anew(spark, monkeypatch):
    rows = lambda first, n: spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(first, first + n))) for i in (1000 * first, 1000 * first + 1)], "doc_id long, text string")
    a, b = line_keys(rows(0, 300)), line_keys(rows(300, 3000))
    start = LineIndex.empty(spark, 2, 1).insert(a)
    grown = start.insert(b)
    assert grown.shards == 1 and grown.filters.count() == 1
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 200)
    split = start.insert(b)
    assert split.shards == 16 and split.filters.count() == 16
    for index in (grown, split):
        assert index.frequent_lines(b).count() == 6000 and index.frequent_lines(a).count() == 600
        back = index.delete(b)
        assert back.frequent_lines(a).count() == 600 and back.frequent_lines(b).count() == 0


def test_filters_decide_without_heavy_keys(docs, monkeypatch):
    monkeypatch.setattr("hopboard.llm.line_dedup.HEAVY", 0)
    frame = docs(TEXTS)
    lines = line_keys(frame)
    assert cleaned(frame, build_index(lines, 2), lines) == expected(TEXTS, 2)


def test_deletion_undoes_insertion(spark, docs):
    frame = docs(TEXTS)
    first, second = frame.where("doc_id % 2 = 0"), frame.where("doc_id % 2 = 1")
    base = LineIndex.empty(spark, 2, 4).insert(line_keys(first))
    more = base.insert(line_keys(second))
    back = more.delete(line_keys(second))
    counts = lambda index: sorted(map(tuple, index.counts.collect()))
    assert counts(back) == counts(base) != counts(more)
    assert counts(more) == counts(LineIndex.empty(spark, 2, 4).insert(line_keys(frame)))
    lines = line_keys(frame)
    assert cleaned(frame, back, lines) == cleaned(frame, base, lines)
    assert cleaned(frame, more, lines) == expected(TEXTS, 2)
    members = lambda index: sum((CuckooFilter.from_bytes(bytes(r["slots"])).slots > 0).sum() for r in index.filters.collect())
    assert members(back) == members(base) < members(more)


def test_deleting_what_is_not_there_raises(spark, docs):
    index = LineIndex.empty(spark, 2, 4).insert(line_keys(docs(["a"])))
    try:
        index.delete(line_keys(docs(["b"]))).counts.collect()
    except Exception as error:
        assert "never inserted" in str(error)
    else:
        raise AssertionError("no error")


def test_repeated_rows_count_once_and_are_all_cleaned(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (None, None), (2, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_keys(frame)
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in clean(frame, build_index(lines, 2), lines).collect()), key=str)
    assert got == sorted([(1, "b", 1), (1, "b", 1), (None, "c", 1), (None, "", 0), (2, "d", 0)], key=str)


def test_first_document_keeps_its_lines(docs):
    frame = docs(["a\nb", "a", "a\nc", "a\nb"])
    lines = line_keys(frame)
    assert [text for _, _, text in cleaned(frame, build_index(lines, 2), lines, keep_first=True)] == ["a\nb", "", "c", ""]


def test_saved_index_and_empty_input(spark, docs, tmp_path):
    empty = docs([""]).limit(0)
    lines = line_keys(empty)
    assert clean(empty, build_index(lines), lines).count() == 0
    frame = docs(TEXTS)
    index = build_index(line_keys(frame), 2)
    index.save(str(tmp_path / "index"))
    again = LineIndex.load(spark, str(tmp_path / "index"), 2, index.shards)
    assert cleaned(frame, again, line_keys(frame)) == expected(TEXTS, 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=180, unique=True), st.data())
def test_cuckoo_filter_holds_what_was_not_deleted(keys, data):
    high = np.array(keys, np.int64)
    low = (high * 7919) ^ (high << 13)
    some = CuckooFilter(buckets=128)
    assert some.insert(high, low)
    assert some.contains(high, low).all()
    gone = np.array(data.draw(st.lists(st.booleans(), min_size=len(keys), max_size=len(keys))))
    some.delete(high[gone], low[gone])
    assert some.contains(high[~gone], low[~gone]).all()
    assert (some.slots > 0).sum() == (~gone).sum()


def test_full_filter_is_reported():
    high = np.arange(300, dtype=np.int64) * 0x1234567
    assert not CuckooFilter(buckets=64).insert(high, high << 40)
