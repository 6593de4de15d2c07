from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hopboard.llm import mixing
from hopboard.llm.mixing import mix, source_targets


def by_rounds(sizes):
    """Targets as told: share, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    weight = {name: 1 + i % 3 for i, name in enumerate(names)}
    target, left, free = {name: 0.0 for name in names}, float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[n] for n in free)
        left = 0.0
        for name in sorted(free, key=str):
            target[name] += weight[name] * share
            if target[name] > 3 * sizes[name]:
                left += target[name] - 3 * sizes[name]
                target[name] = float(3 * sizes[name])
        free = {n for n in free if target[n] < 3 * sizes[n]}
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 5}, {"Z": 5, "a": 0, "é": 7, None: 1}, {"a": 0}, {"x": 9}, {},
    {f"s{i}": (i * 37) % 101 + 1 for i in range(40)},
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(name, size) for name, size in sizes.items()], "source string, size long")
    got = {row["source"]: row["target"] for row in source_targets(rows).collect()}
    assert got == pytest.approx(by_rounds(sizes))


@pytest.fixture
def corpus(spark):
    rows = []
    for i in range(400):
        source = None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}"
        text = None if i % 50 == 7 else "" if i % 50 == 8 else "w " * (5000 if i % 97 == 0 else i % 83)
        rows.append((i, text, source, -1, "x"))
    rows += rows[:20]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, words string")


def test_mix_meets_targets_within_limits(corpus):
    rows = mix(corpus.repartition(4), ["doc_id", "source", "size", "words"], block_words=16, slots_per_shard=50).documents.collect()
    assert len(rows) == 420
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for row in rows:
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] += row["taken"]
        size[row["source"]] += row["size"]
        target[row["source"]] = row["target"]
        assert row["words"] == "x"
    assert target == pytest.approx(by_rounds(size))
    for row in rows:
        assert row["source_size"] == size[row["source"]]
    for source in target:
        assert abs(taken[source] - target[source]) <= 3 * 16 + target[source] / 400


def test_result_does_not_depend_on_partitions(corpus):
    key = lambda frame: sorted(map(str, mix(frame, ["doc_id"], block_words=16).documents.collect()))
    assert key(corpus.repartition(1)) == key(corpus.repartition(7))


def test_slots_are_permutations_and_shards_are_filled(corpus):
    found = mix(corpus, ["doc_id"], block_words=16, slots_per_shard=50)
    blocks = {row["source_no"]: row["blocks"] for row in found.sources.collect()}
    passes = defaultdict(list)
    shards = defaultdict(int)
    for row in found.slots.collect():
        passes[row["source_no"], row["slot"] // blocks[row["source_no"]]].append(row["index"])
        shards[row["shard"]] += 1
    for (source, _), indexes in passes.items():
        assert len(set(indexes)) == len(indexes) and set(indexes) <= set(range(blocks[source]))
    assert len(shards) > 1 and max(shards.values()) < 3 * min(shards.values())
    words = defaultdict(int)
    for row in found.pieces.collect():
        words[row["source_no"], row["block"]] += row["words"]
    assert all(n <= 16 for n in words.values())
    assert all(words[s, b] == 16 for s, n in blocks.items() for b in range(n - 1))


def brute_mix(corpus, found, block_words):
    """Words taken of each document, by laying out words one by one and filling every slot."""
    layout = defaultdict(list)
    starts = {}
    for row in found.pieces.collect():
        starts[row["source_no"], row["block"], row["from_word"], row["row_no"]] = row["words"]
    for (source, block, _, row_no), words in starts.items():
        layout[source, block] += [row_no] * words
    assert all(len(words) <= block_words for words in layout.values())
    taken = defaultdict(int)
    for slot in found.slots.collect():
        for row_no in layout[slot["source_no"], slot["index"]]:
            taken[row_no] += 1
    return sorted(taken.values())


def test_taken_equals_filling_slots_word_by_word(corpus):
    found = mix(corpus, ["doc_id"], block_words=16, slots_per_shard=50)
    got = sorted(row["taken"] for row in found.documents.collect() if row["taken"])
    assert got == brute_mix(corpus, found, 16)


def test_counts_in_shards_are_drawn(spark):
    """Chi-square of the counts in 60 shards, and of single sources over shards: neither too large nor too small."""
    sizes = [("a", 4000), ("b", 3000), ("c", 2000), ("d", 1000)]
    sources = spark.createDataFrame([(i + 1, slots) for i, (_, slots) in enumerate(sizes)], "source_no int, slots long")
    rows = mixing._drawn(sources, 200, 5).collect()
    shards = defaultdict(dict)
    for row in rows:
        shards[row["shard"]][row["source_no"]] = row["n"]
    assert len(shards) == 50 and all(sum(counts.values()) == 200 for counts in shards.values())
    expected = {i + 1: 200 * slots / 10_000 for i, (_, slots) in enumerate(sizes)}
    chi = sum((counts.get(s, 0) - e) ** 2 / e for counts in shards.values() for s, e in expected.items())
    # 150 degrees of freedom: mean 150, standard deviation 17.
    assert 80 < chi < 220


def test_draws_decide_the_mix(corpus):
    """Slots of a shard are as many as it drew, up to the limit on totals; another seed takes other words."""
    found = mix(corpus, ["doc_id"], block_words=16, slots_per_shard=50)
    slots = found.slots.groupBy("source_no", "shard").count().collect()
    drawn = {(row["source_no"], row["shard"]): row["n"] for row in mixing._drawn(found.sources, 50, 42).collect()}
    total, held = defaultdict(int), defaultdict(int)
    for (source, _), n in drawn.items():
        total[source] += n
    for row in slots:
        held[row["source_no"]] += row["count"]
    for row in found.sources.collect():
        s, spare = row["source_no"], row["slots"] // mixing.SPARE
        assert abs(held[s] - row["slots"]) <= spare and held[s] <= 3 * row["blocks"]
        if row["slots"] - spare <= total[s] <= min(row["slots"] + spare, 3 * row["blocks"]):
            assert held[s] == total[s]
    for row in slots:
        near = drawn.get((row["source_no"], row["shard"]), 0) * held[row["source_no"]] / max(1, total[row["source_no"]])
        assert abs(row["count"] - near) <= 1 or not total[row["source_no"]]
    taken = lambda **kwargs: {row["doc_id"]: row["taken"] for row in mix(corpus, ["doc_id"], block_words=16, **kwargs).documents.collect()}
    base = taken(slots_per_shard=50)
    assert base == taken(slots_per_shard=50) != taken(slots_per_shard=50, seed=7)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 2**40])
def test_permutations(spark, n):
    rows = spark.range(min(n, 1000)).select("id", mixing._permuted(F.col("id"), F.lit(n), [F.lit(1)]).alias("a"), mixing._permuted(F.col("id"), F.lit(n), [F.lit(2)]).alias("b")).collect()
    for name in "ab":
        values = [row[name] for row in rows]
        assert len(set(values)) == len(values) and all(0 <= v < n for v in values)
    if n >= 97:
        assert sum(row["a"] == row["b"] for row in rows) < 15
        steps = Counter((b["a"] - a["a"]) % n for a, b in zip(rows, rows[1:]))
        assert max(steps.values()) < 15
        # The first quarter of the numbers falls evenly on the halves.
        assert 0.3 < sum(row["a"] < n / 2 for row in rows) / len(rows) < 0.7


def test_equal_rows_are_dealt_into_parts(spark):
    frame = spark.createDataFrame([(1, "w " * 5, "s")] * 3000 + [(i, "w " * 7, "s") for i in range(2, 400)], "doc_id long, text string, source string")
    found = mix(frame.repartition(4), ["doc_id"], block_words=16)
    words = defaultdict(int)
    for row in found.pieces.collect():
        words[row["block"]] += row["words"]
    total = 3000 * 5 + 398 * 7
    assert sum(words.values()) == total and all(words[b] == 16 for b in range(total // 16))
    plan = found.pieces._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("part#" in line.split("], [")[1] for line in windows if "row_no" in line)


def test_empty_input(corpus):
    assert mix(corpus.limit(0), ["doc_id"]).documents.count() == 0


def test_plan_is_native(corpus):
    plan = mix(corpus, ["doc_id"]).documents._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
