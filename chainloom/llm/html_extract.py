"""Main text of web pages by a tree-structured graphical model over their elements."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import Batches, in_slices
from chainloom.llm.dom import BLOCK, Page, blocks, read_page
from chainloom.llm.labelled_pages import labelled_pages

_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
#: How an edge of the tree counts, by the child: potentials are learned for each.
_KINDS = ("text", "inline", "paragraph", "heading", "item", "table", "container", "landmark")
_KIND_OF = {"#text": 0, "p": 2, "pre": 2, "blockquote": 2, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 3), **dict.fromkeys(("li", "dd", "dt", "ul", "ol", "dl", "menu"), 4), **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), 5), **dict.fromkeys(("article", "main", "aside", "nav", "header", "footer", "form", "section", "search", "dialog"), 7)}
_SCALE = np.array([0, 8, 25, 60, 150, 400, 1200, 4000])


def _kind(tag: str) -> int:
    return _KIND_OF.get(tag, 6 if tag in BLOCK else 1)


def _bin(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SCALE, values, side="right") - 1


@dataclass
class Forest:
    """The elements and text runs of some pages as one array of nodes, level by level below their pages.

    parent and level by node; kind of the edge to the parent; pairs (node, feature) in two arrays. Text lengths and link
    shares come from the pages themselves."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    starts: list[int]


def _element_features(tag: str, names: str, inside: bool, memo: dict) -> tuple[str, ...]:
    """What an element says of itself: its tag, words of its names, and the tag once more where an article is around it."""
    key = (tag, names, inside)
    if key not in memo:
        words = set()
        for part in names.split():
            words.update(w.lower() for w in _WORD.findall(part.partition("=")[2] or part))
        found = [f"t:{tag}", f"k:{_kind(tag)}", *(f"n:{w}" for w in sorted(words))]
        if inside:
            found.append(f"in:{tag}")
        if len(memo) > 100_000:
            memo.clear()
        memo[key] = tuple(found)
    return memo[key]


def plant(pages: Sequence[Page], index: dict[str, int], grow: bool = False, memo: dict | None = None) -> Forest:
    """The forest of some pages. index: number of each feature; where it may grow, new ones are added, else passed over."""
    memo = {} if memo is None else memo
    parent, kind, node, feature, starts, depth = [], [], [], [], [], []

    def add(k: int, name: str) -> None:
        at = index.setdefault(name, len(index)) if grow else index.get(name)
        if at is not None:
            node.append(k)
            feature.append(at)

    for page in pages:
        base, n = len(parent), len(page.tags)
        starts.append(base)
        own = np.array([len(t) for t in page.texts])
        linked, inside, level = [False] * n, [False] * n, [0] * n
        for k in range(1, n):
            up = page.parents[k]
            linked[k] = linked[up] or page.tags[k] == "a"
            inside[k] = inside[up] or page.tags[up] in ("article", "main")
            level[k] = level[up] + 1
        chars, links = own.astype(np.int64), np.where(linked, own, 0).astype(np.int64)
        for k in range(n - 1, 0, -1):
            chars[page.parents[k]] += chars[k]
            links[page.parents[k]] += links[k]
        sizes, dense, share = _bin(chars), 5 * links // np.maximum(chars, 1), 5 * chars // max(1, chars[0])
        paragraphs, block = [0] * n, [0] * n  # paragraphs right below a node, and the nearest block around it
        for k in range(1, n):
            paragraphs[page.parents[k]] += page.tags[k] == "p"
            block[k] = page.parents[k] if page.tags[page.parents[k]] in BLOCK else block[page.parents[k]]
        for k in range(n):
            tag, up = page.tags[k], page.parents[k]
            parent.append(base + up if up >= 0 else -1)
            depth.append(level[k])
            kind.append(_kind(tag))
            if kind[-1] < 2:
                add(base + k, f"bl:{page.tags[block[k]]}:{dense[block[k]]}:{linked[k]}")
            if tag == "#text":
                text = page.texts[k]
                add(base + k, f"s:{sizes[k]}:{linked[k]}")
                add(base + k, "mark" if text[-1] in ".?!:。" else "open")
                add(base + k, f"of:{page.tags[up]}:{inside[k]}")
                add(base + k, f"sh:{share[up]}")
            elif tag != "#space":
                for name in _element_features(tag, page.names[k], inside[k], memo):
                    add(base + k, name)
                add(base + k, f"z:{_KINDS[kind[-1]]}:{sizes[k]}")
                add(base + k, f"l:{_KINDS[kind[-1]]}:{dense[k]}")
                add(base + k, f"sh:{_KINDS[kind[-1]]}:{share[k]}")
                add(base + k, f"ps:{min(4, paragraphs[k])}" if kind[-1] > 4 else f"by:{min(4, paragraphs[up])}:{tag}")
    depth_of = np.array(depth, np.int64)
    order = np.argsort(depth_of, kind="stable")
    levels = np.split(order, np.searchsorted(depth_of[order], np.arange(1, depth_of.max() + 1))) if len(order) else []
    return Forest(np.array(parent, np.int64), levels, np.array(kind, np.int64), np.array(node, np.int64), np.array(feature, np.int64), starts)


def sum_product(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals: for each node the chance that it is content, for each edge that of (parent, child) states.

    Messages go up from the leaves, level by level, and then down from the pages; a node's belief is its own potential
    and all messages that reach it, an edge's that of both ends without what they told one another."""
    n = len(forest.parent)
    own = [np.zeros(n), np.bincount(forest.node, weights[forest.feature], n)]
    told = [np.zeros(n), np.zeros(n)]  # what a child says of each state of its parent
    for level in forest.levels[:0:-1]:
        kind, up = forest.kind[level], forest.parent[level]
        for state in (0, 1):
            message = np.logaddexp(edges[kind, state, 0] + own[0][level], edges[kind, state, 1] + own[1][level])
            told[state][level] = message
            np.add.at(own[state], up, message)
    belief = [x.copy() for x in own]
    for level in forest.levels[1:]:
        kind, up = forest.kind[level], forest.parent[level]
        rest = [belief[state][up] - told[state][level] for state in (0, 1)]
        for state in (0, 1):
            belief[state][level] += np.logaddexp(edges[kind, 0, state] + rest[0], edges[kind, 1, state] + rest[1])
    chance = 1 / (1 + np.exp(np.clip(belief[0] - belief[1], -700, 700)))
    child = np.flatnonzero(forest.parent >= 0)
    kind, up = forest.kind[child], forest.parent[child]
    joint = np.stack([edges[kind, a, b] + own[b][child] + belief[a][up] - told[a][child] for a in (0, 1) for b in (0, 1)], axis=1)
    joint = np.exp(joint - joint.max(axis=1, keepdims=True))
    pairs = np.zeros((n, 4))
    pairs[child] = joint / joint.sum(axis=1, keepdims=True)
    return chance, pairs


@dataclass(frozen=True)
class Extractor:
    """A trained model: number and weight of each feature of content, and potentials of (kind, parent, child)."""

    index: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def states(page: Page, main_text: str) -> np.ndarray:
    """Which nodes are content, given the main text without white space: text runs that make it up in their order, and
    elements that hold some of it. Where runs repeat, the first way through that uses up all of the text counts."""
    runs = [k for k, t in enumerate(page.tags) if t == "#text"]
    squeezed = ["".join(page.texts[k].split()) for k in runs]
    reached: list[dict[int, bool]] = [{0: False}]  # places in the main text that can be reached after each run
    for run in squeezed:
        now = dict.fromkeys(reached[-1], False)
        for at in reached[-1]:
            if main_text.startswith(run, at):
                now[at + len(run)] = True
        reached.append(now)
    at = max(reached[-1])
    found = np.zeros(len(page.tags), bool)
    for step in range(len(runs) - 1, -1, -1):
        if at in reached[step] and not (reached[step + 1][at] and at - len(squeezed[step]) in reached[step]):
            continue
        found[runs[step]] = True
        at -= len(squeezed[step])
    mine = np.zeros(len(found), int)
    for k in range(len(found) - 1, -1, -1):
        mine[k] += found[k]
        if k:
            mine[page.parents[k]] += mine[k]
    found |= mine > 0
    return found


def train(pages: Sequence[tuple[str, str]], rounds: int = 150, strength: float = 0.3) -> Extractor:
    """The model that makes the labelled states of the pages' nodes likeliest, by gradients: what is seen of each feature
    and edge less what the marginals expect, with a quadratic penalty. pages: (html, main text)."""
    if not pages:
        raise ValueError("no labelled pages to train on")
    trees = [read_page(html) for html, _ in pages]
    index: dict[str, int] = {}
    forest = plant(trees, index, grow=True)
    y = np.concatenate([states(t, "".join(unescape(text).split())) for t, (_, text) in zip(trees, pages, strict=True)]).astype(int)
    m = len(index)
    child = np.flatnonzero(forest.parent >= 0)
    cell = lambda a, b: np.bincount(forest.kind[child] * 4 + a * 2 + b, minlength=4 * len(_KINDS))
    seen_edges = cell(y[forest.parent[child]], y[child]).reshape(-1, 2, 2).astype(float)
    seen = np.bincount(forest.feature, y[forest.node], m)
    theta, moment, square = np.zeros(m + 4 * len(_KINDS)), 0.0, 0.0
    for step in range(1, rounds + 1):
        weights, edges = theta[:m], theta[m:].reshape(-1, 2, 2)
        nodes, pairs = sum_product(forest, weights, edges)
        slope = seen - np.bincount(forest.feature, nodes[forest.node], m)
        expected = np.stack([np.bincount(forest.kind[child], pairs[child, k], len(_KINDS)) for k in range(4)], axis=1)
        slope = np.concatenate([slope, (seen_edges.reshape(-1, 4) - expected).ravel()]) - strength * theta
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        rate = 0.25 * min(1.0, 3 * (1 - step / (rounds + 1)))
        theta = theta + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Extractor(index, theta[:m], theta[m:].reshape(-1, 2, 2))


@cache
def default_extractor(pages: int = 1_500) -> Extractor:
    """Trained on the package's own labelled pages."""
    return train(labelled_pages(pages))


def learn(labelled: DataFrame, most: int = 2_000) -> Extractor:
    """Trained on labelled(html, text) rows, text being the main text: on the most rows with the smallest hash, which come
    to the driver. Rows without html or text are passed over."""
    rows = labelled.select("html", "text").filter("html is not null and text is not null").orderBy(F.xxhash64("html", "text"), "html", "text").limit(most).collect()
    return train([(r["html"], r["text"]) for r in rows])


def _texts(model: Extractor, least: float, nodes_at_once: int = 50_000):
    def of(batches: Batches) -> Batches:
        memo: dict = {}
        for batch in batches:
            out: list[str] = []
            waiting: list[Page] = []
            held = 0
            for k, html in enumerate(batch.column(0).to_pylist()):
                waiting.append(read_page(html))
                held += len(waiting[-1].tags)
                if held > nodes_at_once or k == len(batch) - 1:
                    forest = plant(waiting, model.index, memo=memo)
                    chance = sum_product(forest, model.weights, model.edges)[0]
                    for page, start in zip(waiting, forest.starts, strict=True):
                        out.append(blocks(page, (chance[start : start + len(page.tags)] >= least).tolist()))
                    waiting, held = [], 0
            yield pa.record_batch([pa.array(out, pa.string()), batch.column(1)], names=["text", "row"])

    return of


def extract(pages: DataFrame, model: Extractor | None = None, least: float = 0.5) -> DataFrame:
    """One row per row of pages(html): text, the main text, and row, the row as it was.

    A page is a tree of elements with text runs as leaves. Each node is content or not; features of a node (tag, words of
    class, id and role, size, share of links, how a text ends) and pairs of parent and child, by the child's kind, have
    learned potentials, and two sweeps of messages give each node's exact chance. Text runs with a chance of least or more
    make up the text: in page order, blocks apart by two line ends, white space within a block as one space, character
    references decoded. Scripts, styles, the head and the fields of forms are no nodes at all.

    Null or empty html, and pages without content, give ''. Rows that repeat are rows of their own. Whole pages are read,
    however long or deep. No shuffle: a page needs no other. The model goes to the tasks; it is as large as what it was
    trained on (some thousand numbers).
    """
    model = model or default_extractor()
    schema = pages.select(F.lit("").alias("text"), F.struct("*").alias("row")).schema
    rows = pages.select(F.col("html").cast("string").alias("html"), F.struct("*").alias("row"))
    return rows.mapInArrow(in_slices(_texts(model, least)), schema)
