"""Main text of web pages: gradient-boosted trees over the nodes of a page, decoded along its tree.

Every block element, and every text beside other elements, is a node. Its features are the density of texts, links,
marks and controls below it, depth, place among and contrast to its siblings, share of the page, and what its
attribute tokens and those above it say; the latter is counted on training pages as the log odds of a token
standing at content. Boosted trees give each node the chances that what is below it is all content, none of it,
or both. Decoding picks the most likely choice for the whole tree under the rules that all below "all" is "all", and all
below "none" is "none", so that no node contradicts those above and below; a node with a text of its own is one or the
other. The best total below each node is worked out from the leaves up, and choices are read off from the root down.

The model is trained on pages put together here, as no labels come with pages: TRAIN_PAGES layouts, with and without
telling tags and attributes, closed and unclosed elements, around menus, banners, notices, adverts, forms, comments and
articles whose words are those of at most SAMPLE pages (smallest hashes of ids, WORDS_PER_PAGE words each). Attribute
tokens are counted on one half of these pages, trees grown on the other. All pages are extracted, from the whole HTML.

Defined cases: null, empty and blank pages, and pages without content, give an empty text. Repeated rows get equal
texts. White space is that of Unicode, references to it included. A tag that the end of the page cuts off is no
text. Other columns are passed on if asked for.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopboard.llm.dom import TEXT, Tree, parse
from hopboard.llm.training_pages import MARK, training_pages

SAMPLE = 200
WORDS_PER_PAGE = 2000
TRAIN_PAGES = 800
SEED = 11

ROUNDS = 30
DEPTH = 4
RATE = 0.3
BINS = 32
# Weight of no evidence in a leaf, and the least number of training nodes on each side of a split.
PRIOR = 1.0
LEAST = 8
# Characters of HTML whose nodes are described together.
PAGE_BATCH = 4_000_000

ALL, NONE, BOTH = range(3)


class Nodes:
    """The nodes of some pages, side by side, with sums over what is below them."""

    def __init__(self, trees: list[Tree]):
        counts = np.array([len(tree.tags) for tree in trees], np.int64)
        first = np.cumsum(counts) - counts
        self.n = int(counts.sum())
        self.page = np.repeat(np.arange(len(trees)), counts)
        self.root = first[self.page] if self.n else first
        own = np.concatenate([np.array(tree.parents, np.int64) for tree in trees]) if trees else np.zeros(0, np.int64)
        self.parent = np.where(own < 0, -1, own + np.repeat(first, counts))
        self.tags = [tag for tree in trees for tag in tree.tags]
        self.tokens = [tokens for tree in trees for tokens in tree.tokens]
        self.controls = np.array([c for tree in trees for c in tree.controls], np.float64)
        self.texts = [text for tree in trees for text in tree.texts]
        self.owner = np.array([o + base for tree, base in zip(trees, first.tolist()) for o in tree.owners], np.int64)
        self.text_page = np.repeat(np.arange(len(trees)), [len(tree.texts) for tree in trees])
        self.linked = np.array([c for tree in trees for c in tree.linked], np.float64)
        self.levels = self._levels()

    def _levels(self) -> list[np.ndarray]:
        """Nodes by depth. Parents have smaller numbers, hence one pass sets all depths."""
        depth = [0] * self.n
        for node, parent in enumerate(self.parent.tolist()):
            if parent >= 0:
                depth[node] = depth[parent] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if self.n else []

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it."""
        total = own.astype(np.float64)
        for level in reversed(self.levels[1:]):
            np.add.at(total, self.parent[level], total[level])
        return total

    def largest_below(self, own: np.ndarray) -> np.ndarray:
        total = own.astype(np.float64)
        for level in reversed(self.levels[1:]):
            np.maximum.at(total, self.parent[level], total[level])
        return total

    def above(self, own: np.ndarray, combine: Callable) -> np.ndarray:
        """Values of each node and all above it, combined."""
        total = own.astype(np.float64)
        for level in self.levels[1:]:
            total[level] = combine(total[level], total[self.parent[level]])
        return total

    def at_owner(self, values) -> np.ndarray:
        return np.bincount(self.owner, values, self.n) if len(self.owner) else np.zeros(self.n)


def _evidence(nodes: Nodes, odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What tokens say: the tag, and the lowest, highest and summed value of the attributes."""
    tag = np.array([odds.get(f"<{name}>", 0.0) for name in nodes.tags])
    low, high, total = np.zeros(nodes.n), np.zeros(nodes.n), np.zeros(nodes.n)
    for node, tokens in enumerate(nodes.tokens):
        if tokens:
            values = [odds.get(token, 0.0) for token in tokens]
            low[node], high[node], total[node] = min(values), max(values), sum(values)
    return tag, low, high, total


def features(nodes: Nodes, odds: dict[str, float]) -> np.ndarray:
    """One row for each node."""
    texts = nodes.texts
    chars = np.array([len(text) for text in texts], np.float64)
    words = np.array([text.count(" ") + 1 for text in texts], np.float64)
    ends = np.array([text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?", "…", "。")) for text in texts], np.float64)
    commas = np.array([text.count(",") for text in texts], np.float64)
    ended = np.array([text.endswith((".", "!", "?", ":", "…", "。")) for text in texts], np.float64)
    bars = np.array([text.count("|") + text.count("·") + text.count("©") + text.count("»") for text in texts], np.float64)
    at = nodes.at_owner
    own_chars = at(chars)
    c, w, link = nodes.below(own_chars), nodes.below(at(words)), nodes.below(at(nodes.linked))
    blocks = nodes.below(at(np.ones(len(texts))))
    size, controls = nodes.below(np.ones(nodes.n)), nodes.below(nodes.controls)
    sentences, comma, finished, bar = (nodes.below(at(v)) for v in (ends, commas, ended, bars))
    longest = nodes.largest_below(own_chars)
    root, parent = nodes.root, nodes.parent
    up = np.where(parent < 0, np.arange(nodes.n), parent)

    share = lambda part, whole: part / np.maximum(whole, 1)
    order = np.lexsort((np.arange(nodes.n), parent))
    same = np.concatenate([[False], parent[order][1:] == parent[order][:-1]]) if nodes.n else np.zeros(0, bool)
    place = np.zeros(nodes.n)
    starts = np.flatnonzero(~same)
    run = np.arange(nodes.n) - np.repeat(starts, np.diff(np.append(starts, nodes.n)))
    place[order] = run
    children = np.bincount(parent[parent >= 0], minlength=nodes.n).astype(np.float64)
    siblings = np.where(parent < 0, 1, children[up])

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        out = np.full(nodes.n, -1.0)
        if step < 0:
            out[order[1:][same[1:]]] = values[order[:-1][same[1:]]]
        else:
            out[order[:-1][same[1:]]] = values[order[1:][same[1:]]]
        return out

    # Text before a node on its page: that of earlier numbers, less that above it, which is none.
    running = np.cumsum(own_chars)
    before = running - own_chars - np.where(root > 0, running[root - 1], 0) if nodes.n else running
    tag, low, high, total = _evidence(nodes, odds)
    path = tag + total
    density, links = share(c, size), share(link, c)
    depth = nodes.depth.astype(np.float64)
    kinds = nodes.tags
    is_heading = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in kinds], np.float64)
    return np.column_stack([
        np.log1p(c), np.log1p(w), share(c, w), links, np.log1p(link), density, np.log1p(size), np.log1p(blocks),
        share(w, blocks), np.log1p(longest), share(longest, c), share(sentences, w), share(comma, w), share(finished, blocks),
        share(bar, blocks), controls, share(controls, blocks), share(c, c[root]), share(c, c[up]), share(before, c[root]),
        depth, share(place, siblings), siblings, children, is_heading, np.array([t == TEXT for t in kinds], np.float64),
        np.array([t == "li" for t in kinds], np.float64), np.array([t == "p" for t in kinds], np.float64),
        beside(np.log1p(w), -1), beside(np.log1p(w), 1), beside(links, -1), beside(links, 1), links[up], density[up], share(w, blocks)[up],
        share(density, density[up]), tag, low, high, total, tag[up], total[up], beside(path, -1), beside(path, 1),
        nodes.above(path, np.minimum), nodes.above(path, np.maximum), nodes.above(path, np.add),
        nodes.largest_below(path), -nodes.largest_below(-path), share(nodes.below(path), size), c[root] > 0, np.log1p(c[root]),
    ]).astype(np.float32)


def states(nodes: Nodes, is_content: np.ndarray) -> np.ndarray:
    """What is below each node, from what each text is; nodes without text are like their parents (NONE at the top)."""
    good = nodes.below(nodes.at_owner(is_content.astype(np.float64)))
    count = nodes.below(nodes.at_owner(np.ones(len(nodes.texts))))
    found = np.where(good == 0, NONE, np.where(good == count, ALL, BOTH))
    for level in nodes.levels[1:]:
        empty = level[(count[level] == 0) & (found[nodes.parent[level]] == ALL)]
        found[empty] = ALL
    return found


@dataclass
class Trees:
    """Boosted trees of fixed depth for each of three classes: features, bins they are split above, and leaf values."""

    edges: list[np.ndarray]
    base: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    def binned(self, rows: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(edges, rows[:, i], "left") for i, edges in enumerate(self.edges)]
        return np.array(columns, np.uint8)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        out = np.tile(self.base, (len(rows), 1))
        everyone = np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[self.feature[tree][node], everyone] > self.above[tree][node])
            out[:, tree % 3] += self.leaf[tree][node - (2**DEPTH - 1)]
        return out


def log_chances(scores: np.ndarray) -> np.ndarray:
    shifted = scores - scores.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def grow(rows: np.ndarray, classes: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Boosting by Newton steps on the multinomial likelihood; splits are searched in histograms of quantile bins."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(width)]
    target = np.eye(3)[classes]
    base = np.log(target.mean(axis=0) + 1e-3)
    trees = Trees(edges, base, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH)))
    bins = trees.binned(rows)
    cell = (np.arange(width)[:, None] * BINS + bins).astype(np.int64)
    scores = np.tile(base, (n, 1))
    feature, above, leaf = [], [], []
    for _ in range(rounds):
        chances = np.exp(log_chances(scores))
        for k in range(3):
            slope, bend = chances[:, k] - target[:, k], np.maximum(chances[:, k] * (1 - chances[:, k]), 1e-6)
            f, a, values, at = _tree(bins, cell, slope, bend)
            scores[:, k] += RATE * values[at]
            feature.append(f)
            above.append(a)
            leaf.append(RATE * values)
    trees.feature, trees.above, trees.leaf = np.array(feature), np.array(above), np.array(leaf)
    return trees


def _tree(bins: np.ndarray, cell: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree, level by level: split features and bins, leaf values, and the leaf of each row."""
    width, n = bins.shape
    feature, above = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
    at, everyone = np.zeros(n, np.int64), np.arange(n)
    for level in range(DEPTH):
        nodes, span = 2**level, width * BINS
        place = (at * span + cell).ravel()
        sums = [
            np.bincount(place, np.broadcast_to(weight, (width, n)).ravel(), nodes * span).reshape(nodes, width, BINS).cumsum(axis=2)
            for weight in (slope, bend, np.ones(n))
        ]
        (g, h, c), totals = sums, [part[:, :1, -1:] for part in sums]
        gain = g**2 / (h + PRIOR) + (totals[0] - g) ** 2 / (totals[1] - h + PRIOR) - totals[0] ** 2 / (totals[1] + PRIOR)
        gain[(c < LEAST) | (totals[2] - c < LEAST)] = 0
        best = gain.reshape(nodes, span).argmax(axis=1)
        split = gain.reshape(nodes, span)[np.arange(nodes), best] > 1e-6
        first = nodes - 1
        feature[first : first + nodes] = np.where(split, best // BINS, 0)
        above[first : first + nodes] = np.where(split, best % BINS, BINS)
        at = 2 * at + (bins[feature[first + at], everyone] > above[first + at])
    g, h = np.bincount(at, slope, 2**DEPTH), np.bincount(at, bend, 2**DEPTH)
    return feature, above, -g / (h + PRIOR), at


def decode(nodes: Nodes, chances: np.ndarray) -> np.ndarray:
    """Most likely states under the rules of the tree, from the logarithms of the chances of each node."""
    best = chances.astype(np.float64).copy()
    best[nodes.owner, BOTH] = -np.inf
    free = np.zeros(nodes.n)
    for level in reversed(nodes.levels):
        # Below BOTH every child is free to choose; `free` has been summed up from the children.
        best[level, BOTH] += free[level]
        parents = nodes.parent[level]
        inner = parents >= 0
        level, parents = level[inner], parents[inner]
        for state in (ALL, NONE):
            np.add.at(best[:, state], parents, best[level, state])
        np.add.at(free, parents, best[level].max(axis=1))
    chosen = best.argmax(axis=1)
    for level in nodes.levels[1:]:
        forced = chosen[nodes.parent[level]]
        chosen[level] = np.where(forced == BOTH, chosen[level], forced)
    return chosen


@dataclass
class Model:
    odds: dict[str, float]
    trees: Trees

    def kept(self, nodes: Nodes) -> np.ndarray:
        """Whether each text is content."""
        if not nodes.n:
            return np.zeros(0, bool)
        return decode(nodes, log_chances(self.trees.scores(features(nodes, self.odds))))[nodes.owner] == ALL


def token_odds(nodes: Nodes, found: np.ndarray) -> dict[str, float]:
    """Log odds of a token standing at ALL against NONE; tokens seen little are near 0."""
    counts: dict[str, Counter] = {}
    has_text = nodes.below(nodes.at_owner(np.ones(len(nodes.texts)))) > 0
    for tag, tokens, state, counted in zip(nodes.tags, nodes.tokens, found.tolist(), has_text.tolist()):
        if counted:
            for token in {f"<{tag}>", *tokens}:
                counts.setdefault(token, Counter())[state] += 1
    return {token: log((c[ALL] + 0.5 * c[BOTH] + 1) / (c[NONE] + 1)) for token, c in counts.items()}


def fit(pages: list[str]) -> Model:
    """Model from training pages, whose content texts bear MARK."""
    halves = []
    for part in (pages[0::2], pages[1::2]):
        trees = [parse(html) for html in part]
        is_content = np.array([MARK in text for tree in trees for text in tree.texts], bool)
        for tree in trees:
            tree.linked = [max(0, n - text.count(MARK)) for n, text in zip(tree.linked, tree.texts)]
            tree.texts = [text.replace(MARK, "") for text in tree.texts]
        nodes = Nodes(trees)
        halves.append((nodes, states(nodes, is_content)))
    odds = token_odds(*halves[0])
    nodes, found = halves[1]
    return Model(odds, grow(features(nodes, odds), found))


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html in batch["html"].to_pylist():
            texts = parse(html or "").texts
            found.append(" ".join(sorted(texts, key=len, reverse=True)).split()[:WORDS_PER_PAGE])
        yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "words": pa.array(found, pa.list_(pa.string()))})


def train(pages: DataFrame, sample: int = SAMPLE, train_pages: int = TRAIN_PAGES) -> Model:
    """Model for pages (page_id, html), from layouts filled with words of at most `sample` of them."""
    ids = pages.where("page_id is not null").select("page_id").distinct()
    picked = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = (
        pages.select("page_id", "html").join(F.broadcast(picked), "page_id")
        .mapInArrow(_sampled_words, f"page_id {kind}, words array<string>")
        .groupBy("page_id").agg(F.max("words").alias("words"))
        .orderBy(F.xxhash64("page_id"), "page_id").collect()
    )
    return fit(training_pages([word for row in rows for word in row["words"]], train_pages, random.Random(SEED)))


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """Main text of each page: kept texts in page order, two line ends between them."""
    nodes = Nodes([parse(html) for html in pages])
    kept = model.kept(nodes)
    found: list[list[str]] = [[] for _ in pages]
    for page, text, keep in zip(nodes.text_page.tolist(), nodes.texts, kept.tolist()):
        if keep:
            found[page].append(text)
    return ["\n\n".join(texts) for texts in found]


def extract(pages: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Pages with `text` and `n_chars`; `columns` are passed on, but for those of these two names."""
    passed = [name for name in columns if name not in ("text", "n_chars")]
    packed = pages.select(F.struct(*passed).alias("row"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            held: list[str] = []
            size = 0
            for html in batch["html"].to_pylist():
                if held and size + len(html or "") > PAGE_BATCH:
                    found += main_texts(model, held)
                    held, size = [], 0
                held.append(html or "")
                size += len(html or "")
            found += main_texts(model, held)
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "text": pa.array(found, pa.string())})

    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return found.select(*[F.col(f"row.`{name}`").alias(name) for name in passed], "text", F.length("text").cast("bigint").alias("n_chars"))
