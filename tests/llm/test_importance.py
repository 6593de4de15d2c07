import random
import re
from collections import Counter
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pytest
from pyspark.errors import PySparkException

from hopboard.llm import importance
from hopboard.llm.importance import bucket_counts, feature_buckets, resample, span_crcs

ODD = [None, "", " ", "-- !", "ä", "ÄB Straße", "x" * 300_000, "one", "one Two", "word " * 30_000, "a\x00b", "one two three " * 10]


def test_crcs_of_spans_of_any_length():
    random.seed(1)
    data = bytes(random.randrange(256) for _ in range(40_000))
    lengths = [random.choice([0, 1, 2, 63, 64, 65, 127, 128, 129, 1000, 30_000]) for _ in range(1000)]
    starts = [random.randrange(len(data) - n) for n in lengths]
    got = span_crcs(np.frombuffer(data, np.uint8), np.array(starts), np.array(lengths))
    assert [int(crc) for crc in got] == [crc32(data[start : start + n]) for start, n in zip(starts, lengths)]


def test_many_spans_are_worked_on_in_pieces(monkeypatch):
    words = [b"w%d" % (i * 7919 % 1000) for i in range(5000)]
    want = [crc32(word) % 97 for word in words] + [crc32(a + b" " + b) % 97 for a, b in zip(words, words[1:])]
    for size in (1, 100, 4096, 1 << 21):
        monkeypatch.setattr(importance, "SPAN_BYTES", size)
        assert feature_buckets(words, 2, 97).tolist() == want


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=25, min_words=20, longest=2, buckets=10_000, seed=7):
    bucket = lambda feature: crc32(feature.encode()) % buckets
    source = Counter(bucket(f) for _, text in rows for f in features(text, longest)[1])
    wanted = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: floor(1000 * log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(found), weight, weight + floor(-1000 * log(-log((h + 0.5) / 2**32)))])
    order = lambda row: (-row[4], row[0] is not None, row[0] or 0, row[2], row[3], row[1])
    eligible = sorted((row for row in out if row[1] >= min_words), key=order)
    n = len(eligible) * percent // 100
    return [(*row, i) for i, row in enumerate(eligible[:n], 1)] + [
        (*row, None) for row in eligible[n:] + [row for row in out if row[1] < min_words]
    ]


def compared(frame, rows, target, **kwargs):
    targets = frame.sparkSession.createDataFrame([(text, "x") for text in target], "text string, doc_id string")
    got = resample(frame, targets, **kwargs)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, target, **kwargs)))


@pytest.mark.parametrize("settings", [{}, {"percent": 60, "min_words": 1, "longest": 3, "buckets": 50}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_against_brute_force_on_odd_texts(spark, docs, settings):
    rows = list(enumerate(ODD + ODD[-3:]))
    compared(docs([text for _, text in rows]), rows, ["one two", None, "", "Three one two", "ÄB"], **settings)


def test_repeated_rows_ties_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 4)
    text = "some words of a text that is long enough " * 4
    rows = [(3, text)] * 23 + [(None, text)] * 5 + [(5, text), (5, text + "more"), (6, text)] + [(i, text) for i in range(100, 140)]
    compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, ["some text"], percent=70)


def test_empty_tables(spark, docs):
    compared(docs(["word " * 30, None]), [(0, "word " * 30), (1, None)], [], percent=100)
    assert resample(docs([]), docs(["word"])).count() == 0


def test_no_text_is_shuffled(spark, docs):
    frame = docs(["word " * 30])
    assert bucket_counts(frame).sum() == 59
    plan = frame.select("text").mapInArrow(importance._counted(2, 10), "bucket bigint, n bigint").groupBy("bucket").count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(line for line in text.splitlines() if "Exchange" in line)


def test_text_ids(spark):
    frame = spark.createDataFrame([("b", "w " * 30), ("a", "w " * 30)], "doc_id string, text string")
    assert {row["doc_id"]: row["rank"] is None for row in resample(frame, frame, percent=50).collect()}.keys() == {"a", "b"}
    with pytest.raises(PySparkException):
        resample(frame.drop("text"), frame).collect()
