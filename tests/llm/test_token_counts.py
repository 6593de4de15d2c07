import time

import numpy as np
import pytest

from hopboard.llm.token_counts import RULES, attribute, encoding, read_vocabulary, token_counts

TEXTS = [
    None, "", "\n", "one line", "two\nlines\n", "a\n\n\nb   \n  c", "tabs\t\tand  \n\n   spaces ", "über Größe\nnaïve café\n漢字かな交じり文 🎉🎊\n",
    "x" * 30_000, "word " * 20_000 + "\nend", "<|endoftext|>", "\r\n\r\n",
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return read_vocabulary(spark)


def brute_force(tokens, starts, stops, rule):
    counts, crossing, at = [0.0] * len(starts), 0, 0
    for length in tokens:
        common = [max(0, min(at + length, stop) - max(at, start)) for start, stop in zip(starts, stops)]
        crossing += 0 < max(common, default=0) < length
        if rule == "shared":
            counts = [c + part / length for c, part in zip(counts, common)]
        elif rule == "first":
            counts = [c + (start <= at < stop) for c, start, stop in zip(counts, starts, stops)]
        elif max(common, default=0):
            counts[common.index(max(common))] += 1
        at += length
    return counts, crossing


@pytest.mark.parametrize("rule", RULES)
def test_attribution_matches_brute_force(rule):
    random = np.random.default_rng(4)
    for _ in range(200):
        tokens = random.integers(1, 6, random.integers(0, 15))
        cuts = np.sort(random.integers(0, tokens.sum() + 4, 2 * random.integers(0, 5)))
        starts, stops = cuts[::2], cuts[1::2]
        counts, crossing = attribute(np.cumsum(tokens), starts, stops, rule)
        want, want_crossing = brute_force(tokens.tolist(), starts.tolist(), stops.tolist(), rule)
        assert counts.tolist() == pytest.approx(want) and crossing == want_crossing


@pytest.mark.parametrize("rule", RULES)
def test_lines_add_up_to_whole_documents(docs, vocabulary, rule):
    tokenizer, lengths = encoding(vocabulary)
    rows = token_counts(docs(TEXTS), vocabulary, rule).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS):
        tokens = tokenizer.encode_ordinary(text or "")
        assert tokenizer.decode(tokens) == (text or "")
        assert row["n_tokens"] == len(tokens) and row["n_sections"] == (text or "").count("\n") + 1
        assert sum(row["section_tokens"]) == pytest.approx(len(tokens)) and row["n_outside"] == pytest.approx(0)
        line_bytes = [len(line.encode()) for line in (text or "").split("\n")]
        stops = np.cumsum([n + 1 for n in line_bytes])
        stops[-1] -= 1
        want, crossing = brute_force(lengths[tokens].tolist() if len(tokens) < 500 else [], [0, *stops[:-1]], stops, rule)
        if len(tokens) < 500:
            assert row["section_tokens"] == pytest.approx(want) and row["n_crossing"] == crossing


def test_given_sections(spark, docs, vocabulary):
    sections = [(3, "head", 0, 3), (3, "tail", 3, 99), (7, "first", 0, 10), (7, "mid", 10, 22), (5, "none", 2, 2), (1, "empty", 0, 5), (77, "other", 0, 1)]
    table = spark.createDataFrame(sections, "doc_id long, name string, start int, stop int")
    rows = {row["doc_id"]: row for row in token_counts(docs(TEXTS), vocabulary, "first", table).collect()}
    assert rows[3]["section_names"] == ["head", "tail"] and rows[3]["section_tokens"] == [1, 1] and rows[3]["n_outside"] == 0
    assert rows[7]["section_tokens"][0] == len(encoding(vocabulary)[0].encode_ordinary("über Größe"))
    assert sum(rows[7]["section_tokens"]) + rows[7]["n_outside"] == rows[7]["n_tokens"]
    assert rows[5]["section_tokens"] == [0] and rows[4]["n_sections"] == 0 and rows[4]["n_outside"] == rows[4]["n_tokens"]
    overlapping = spark.createDataFrame([(3, "a", 0, 3), (3, "b", 2, 5)], "doc_id long, name string, start int, stop int")
    with pytest.raises(Exception, match="overlap"):
        token_counts(docs(TEXTS), vocabulary, "first", overlapping).collect()


def test_sections_without_bounds_or_name(spark, docs, vocabulary):
    rows = [(0, "head", None, 5), (0, None, 5, None), (1, "all", None, None), (2, "none", None, 0)]
    sections = spark.createDataFrame(rows, "doc_id long, name string, start long, stop long")
    found = {row["doc_id"]: row for row in token_counts(docs(["some words of a text", "more words", None]), vocabulary, "shared", sections).collect()}
    assert found[0]["section_names"] == ["head", None]
    assert sum(found[0]["section_tokens"]) == pytest.approx(found[0]["n_tokens"]) and found[0]["n_outside"] == pytest.approx(0)
    assert found[1]["section_tokens"] == [found[1]["n_tokens"]] and found[2]["section_tokens"] == [0]


def test_odd_inputs(spark, docs, vocabulary):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(rows, vocabulary).collect()), key=str) == sorted([(1, 2), (1, 2), (None, 1), (None, 0)], key=str)
    assert token_counts(docs(["a"]).limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        token_counts(rows, vocabulary, "other")


def test_long_runs_take_bounded_time(vocabulary):
    tokenizer, _ = encoding(vocabulary)
    started = time.perf_counter()
    tokenizer.encode_ordinary("a" * 300_000)
    assert time.perf_counter() - started < 20
