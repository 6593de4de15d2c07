import random

import numpy as np
import pyarrow as pa
import pytest

from hopboard.llm import minhash_dedup
from hopboard.llm.minhash_dedup import near_duplicates, similar


def brute_force(texts, words, percent):
    sets = []
    for text in texts:
        found = "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\f", " ").split()
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(x), label[i], i == label[i]) for i, x in enumerate(sets)]


def variants(seed, n):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(6):
        base = random.choices(vocabulary, k=80)
        texts.append(" ".join(base))
        for _ in range(n):
            base = list(base)
            base[random.randrange(80)] = random.choice(vocabulary)
            texts.append(" ".join(base))
    return texts


ODD = [None, "", " \n\t", "one", "One", "two words", "words two", "ä É", "Ä É", "a b c", "A  B\nC", "a b c d", "word " * 5000, "word " * 90]


@pytest.mark.parametrize("words, percent, block", [(3, 85, 256), (5, 80, 256), (3, 85, 3), (2, 50, 8)])
def test_matches_brute_force(docs, words, percent, block):
    texts = ODD + variants(words + block, 7) + ODD[3:6]
    rows = near_duplicates(docs(texts), words, percent, block).orderBy("doc_id").collect()
    got = [(row["doc_id"], row["n_shingles"], row["component_id"], row["kept"]) for row in rows]
    if percent >= 80:
        assert got == brute_force(texts, words, percent)
    else:
        # Lower limits are outside of what the trees are made for; what is linked must still be right.
        assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in brute_force(texts, words, percent)]


def crowd(n, length=60):
    """Texts in pairs at a similarity of about 0.85 to 0.97."""
    draw = random.Random(n)
    texts = []
    for i in range(n // 2):
        words = [f"v{draw.randrange(10**6)}" for _ in range(length)]
        texts.append(" ".join(words))
        at = draw.randrange(length - 4)
        other = list(words)
        other[at : at + draw.choice([1, 2])] = [f"x{i}"]
        texts.append(" ".join(other))
    return texts


def test_pairs_in_crowded_regions_are_found(spark, monkeypatch):
    """5,000 texts in one region of each tree: the first three minima of every label are made equal."""
    texts = crowd(5000)
    pairs = {}
    for i in range(0, len(texts), 2):
        x, y = ({tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for t in texts[i : i + 2])
        share = 100 * len(x & y) / len(x | y)
        if share >= 85:
            pairs[i] = share
    assert len(pairs) > 2000 and max(pairs.values()) < 98
    plain, width = minhash_dedup._features, minhash_dedup.LABEL

    def coarse(signature):
        minima = np.frombuffer(signature, ">u2").reshape(-1, width).copy()
        minima[:, :3] = 0
        return minima.astype(">u2").tobytes()

    def features(words):
        def run(batches):
            for batch in plain(words)(batches):
                coarsened = [data and coarse(data) for data in batch["signature"].to_pylist()]
                yield batch.set_column(batch.schema.names.index("signature"), "signature", pa.array(coarsened, pa.binary()))

        return run

    monkeypatch.setattr(minhash_dedup, "_features", features)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {row["doc_id"]: row["component_id"] for row in near_duplicates(frame, 2, 85, margin=0.5).collect()}
    right = [found[i] == found[i + 1] for i in pairs]
    assert np.mean(right) >= 0.99


def test_regions_are_as_deep_as_their_crowd(spark):
    """Blocks are bounded: whole labels are told apart before any region is compared in more than one block."""
    labels = np.zeros((600, minhash_dedup.TREES, minhash_dedup.LABEL), ">u2")
    labels[:, :, 3] = np.arange(600)[:, None] % 3
    labels[:, :, 4] = np.arange(600)[:, None] % 5
    labels[:100, :, 5] = np.arange(1, 101)[:, None]
    rows = [(i, labels[i].tobytes()) for i in range(600)]
    classes = spark.createDataFrame(rows, "class_id long, signature binary")
    sizes = lambda deepest: sorted(r["size"] for r in minhash_dedup._regions(classes, 50, deepest).where("tree = 0").select("region", "size").distinct().collect())
    assert sizes(3) == [600] and sizes(4) == [200] * 3 and sizes(5) == [40] * 15
    wide = lambda block: minhash_dedup._regions(classes, block, 6).where("tree = 0").groupBy("region", "size").count().collect()
    assert all(row["count"] == row["size"] for row in wide(10))
    assert sum(row["size"] for row in wide(10)) == 500


def test_neighbours_share_the_longest_prefixes():
    signatures = np.zeros((4, minhash_dedup._MINIMA), np.uint16)
    signatures[:, :6] = [[1, 2, 3, 9, 9, 9], [1, 2, 3, 4, 5, 6], [7, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 8]]
    x, y = minhash_dedup._neighbours(signatures, 0)
    assert list(zip(x.tolist(), y.tolist())) == [(1, 3), (3, 0), (0, 2)]


@pytest.mark.parametrize("deepest, margin", [(3, 1.0), (4, 0.18), (6, 0.18)])
def test_settings_agree_on_clear_cases(docs, deepest, margin):
    texts = ODD + variants(5, 9)
    rows = near_duplicates(docs(texts), 3, 85, 8, deepest, margin).orderBy("doc_id").collect()
    got = [(row["doc_id"], row["n_shingles"], row["component_id"], row["kept"]) for row in rows]
    assert got == brute_force(texts, 3, 85)


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (3, "x y z"), (None, "a b c d"), (None, "q"), (None, None), (7, None), (7, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=str)
    assert got == sorted([
        (3, 2, 3, True), (3, 2, 3, True), (3, 1, 3, True), (None, 2, 3, False), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True),
    ], key=str)


def test_empty_table(docs):
    assert near_duplicates(docs(["a"]).limit(0)).count() == 0


def test_limit_is_exact():
    x, y = np.arange(20, dtype=np.uint64), np.arange(3, 20, dtype=np.uint64)
    assert similar(x, y, 85) and not similar(x, y, 86) and not similar(x, y[1:], 85)
