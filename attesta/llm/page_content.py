"""Main text of web pages: a tree-structured graphical model over DOM nodes, solved by message passing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, shared
from .page_samples import MARK, UNMARK, labelled_pages
from .page_tree import Tree, attributes_of, parse

NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[^\W\d_a-zA-Z]+")
NAMED_BY = ("class", "id", "role", "itemprop")
# kinds of edges, each with its own potential: to a leaf, to a plain container, to any other element
LEAF, PLAIN, OTHER = range(3)
ZONES = frozenset("article main section aside nav header footer form ul ol table dialog blockquote".split())
PLAIN_TAGS = frozenset("html body div section center table tbody tr td".split())
CACHE = 20_000


def _size(n: float) -> int:
    return int(n).bit_length()


def names_of(raw: str) -> list[str]:
    """Words in the names that a page gives to an element, in lower case, endings cut to six letters."""
    if not raw:
        return []
    got = attributes_of(raw)
    words = [w.lower() for a in NAMED_BY if a in got for w in NAME.findall(got[a])]
    return sorted({w.rstrip("s")[:6] or w for w in words})


def features(tree: Tree, cache: dict) -> list[list[str]]:
    """Named features of each node: its own, and what its leaves add up to."""
    n = len(tree.tags)
    chars, linked, leaves, stops, para = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    named: list[list[str]] = [[]] * n
    before = [0] * n  # characters of the page before the node
    total = 0
    for i in range(n):
        before[i] = total
        text = tree.texts[i]
        if text:
            chars[i], linked[i], leaves[i] = len(text), tree.linked[i], 1
            stops[i] = text.count(".") + text.count(",") + text.count("?") + text.count("!")
            total += len(text)
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        leaves[p] += leaves[i]
        stops[p] += stops[i]
        para[p] += tree.tags[i] == "p"
    depth, zone, below = [0] * n, ["-"] * n, [()] * n  # nearest telling element above, names of the nearest named one
    whole = sorted({t for t in tree.tags if t in ("article", "main")})
    out = []
    for i in range(n):
        p, tag = tree.parents[i], tree.tags[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            zone[i] = tree.tags[p] if tree.tags[p] in ZONES else zone[p]
            below[i] = named[p] or below[p]
        density = min(4, 5 * linked[i] // max(chars[i], 1)) if linked[i] else -1
        kind = "l" if tag == "#text" else "e"
        own = [f"{kind}1", f"{kind}s{_size(chars[i])}", f"{kind}d{density}", f"{kind}.{min(_size(stops[i]), 5)}"]
        own.append(f"{kind} within {zone[i]}")
        own += [f"{kind} below {w}" for w in below[i]]
        if tag == "#text":
            own += [f"in {tree.tags[p]}", f"in {tree.tags[p]} d{density}"]
            if chars[i] < 400 and "©" in tree.texts[i]:
                own.append("l©")
        else:
            raw = tree.attributes[i]
            names = cache.get(raw)
            if names is None:
                if len(cache) >= CACHE:
                    cache.clear()
                names = cache[raw] = names_of(raw)
            own += [f"<{tag}", f"en{min(_size(leaves[i]), 6)}", f"ep{min(para[i], 4)}", f"eh{min(depth[i], 6)}"]
            named[i] = names
            own += [f"named {w}" for w in names]
            own += [f"<{tag} of {w}" for w in whole]
            if not names and tag in PLAIN_TAGS:
                own.append("unnamed")
            own.append("e|" + ("0" if not before[i] else "1" if before[i] * 2 < total else "2"))
            if not chars[i]:
                own.append("e0")
        out.append(own)
    return out


@dataclass
class ContentModel:
    """Weights of features for "content", and potentials [kind of edge, parent, child]."""

    names: dict
    weights: np.ndarray
    edges: np.ndarray


@dataclass
class Forest:
    """Trees side by side, nodes of a tree with parents first; features as (node, feature) pairs."""

    parents: np.ndarray
    kinds: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    levels: list[tuple]  # by depth, without the roots: nodes, where a new parent's children start, these parents

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights[self.feature], len(self.parents))


def forest(trees: list[Tree], names: dict, cache: dict, learn: bool = False) -> Forest:
    parents, kinds, node, feature, depth = [], [], [], [], []
    for tree in trees:
        base = len(parents)
        for i, own in enumerate(features(tree, cache)):
            for name in own:
                at = names.setdefault(name, len(names)) if learn else names.get(name)
                if at is not None:
                    node.append(base + i)
                    feature.append(at)
            p = tree.parents[i]
            parents.append(base + p if p >= 0 else -1)
            depth.append(depth[base + p] + 1 if p >= 0 else 0)
            kinds.append(LEAF if tree.tags[i] == "#text" else PLAIN if tree.tags[i] in PLAIN_TAGS else OTHER)
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    bounds = np.cumsum(np.bincount(depth)) if len(depth) else np.empty(0, np.int64)
    parents = np.array(parents, np.int64)
    levels = []
    for nodes in (order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)):
        above = parents[nodes]
        # nodes stand in page order, so the children of one parent are neighbours in their level
        starts = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        levels.append((nodes, starts, above[starts]))
    return Forest(parents, np.array(kinds, np.int64), np.array(node, np.int64), np.array(feature, np.int64), levels)


def marginals(f: Forest, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(content) by node, P(parent, child) by edge, log of the partition function), by sum-product.

    Messages go up, deepest level first, and down again; both states of a node are kept as logarithms.
    Exact, since the nodes of a page form a tree.
    """
    n = len(f.parents)
    local = np.zeros((n, 2))
    local[:, 1] = unary
    up = local.copy()  # own potential and messages of all children
    sent = np.zeros((n, 2))  # message of a node to its parent, by the parent's state
    pair = edges[f.kinds]
    for level, starts, above in reversed(f.levels):
        sent[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
        up[above] += np.add.reduceat(sent[level], starts)
    roots = f.parents < 0
    log_z = float(np.logaddexp(up[roots, 0], up[roots, 1]).sum())
    whole = up.copy()  # with the message from above
    joint = np.zeros((n, 2, 2))
    for level, _, _ in f.levels:
        rest = whole[f.parents[level]] - sent[level]  # the parent without this child
        both = rest[:, :, None] + pair[level] + up[level, None, :]
        whole[level] = np.logaddexp(both[:, 0], both[:, 1])
        top = both.reshape(len(level), 4)
        share = np.exp(top - top.max(axis=1, keepdims=True))
        joint[level] = (share / share.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
    content = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700)))
    return content, joint, log_z


def labels_of(tree: Tree) -> np.ndarray:
    """1 for content: leaves by the nearest mark above them, elements by the greater part of their text."""
    n = len(tree.tags)
    marked, main, chars = [0] * n, np.zeros(n), np.zeros(n)
    for i in range(n):
        got = attributes_of(tree.attributes[i]) if tree.attributes[i] else {}
        marked[i] = 1 if MARK in got else 0 if UNMARK in got else marked[tree.parents[i]] if i else 0
        chars[i] = len(tree.texts[i])
        main[i] = marked[i] * chars[i]
    for i in range(n - 1, 0, -1):
        chars[tree.parents[i]] += chars[i]
        main[tree.parents[i]] += main[i]
    return np.where(chars > 0, 2 * main > chars, np.array(marked, bool)).astype(np.int64)


def _climb(value_and_slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """A maximum of a concave function, by steps that learn its curvature from the last slopes (L-BFGS)."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, d in reversed(past):
            share = (s @ way) / (s @ d)
            way -= share * d
            kept.append(share)
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(slope).sum()))
        for (s, d), share in zip(past, reversed(kept), strict=True):
            way += (share - (d @ way) / (s @ d)) * s
        length, gain = 1.0, float(slope @ way)
        for _ in range(30):
            found, after = value_and_slope(x + length * way)
            if found >= value + 1e-4 * length * gain:
                break
            length /= 2
        else:
            break
        s, d = length * way, slope - after
        x, done = x + s, found - value < 1e-7 * abs(found)
        value, slope = found, after
        if done:
            break
        if s @ d > 1e-10:
            past = [*past[-memory + 1 :], (s, d)]
    return x


def fit(pages: list[str] | None = None, steps: int = 120, penalty: float = 0.3) -> ContentModel:
    """Conditional maximum likelihood on labelled pages (see `labelled_pages`).

    The slope is what the labels show less what the marginals expect, for each feature and each pair of
    states of an edge. Without `pages` those made by rule are used, a fixed number whatever the input.
    """
    trees = [parse(p) for p in (labelled_pages() if pages is None else pages)]
    names: dict = {}
    f = forest(trees, names, {}, learn=True)
    y = np.concatenate([labels_of(t) for t in trees])
    inner = f.parents >= 0
    shown = np.zeros((3, 2, 2))
    np.add.at(shown, (f.kinds[inner], y[f.parents[inner]], y[inner]), 1)
    counted = np.bincount(f.feature, y[f.node].astype(float), len(names))
    of_kind = [inner & (f.kinds == k) for k in range(3)]

    def likelihood(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, edges = x[:-12], x[-12:].reshape(3, 2, 2)
        content, joint, log_z = marginals(f, f.unary(weights), edges)
        value = counted @ weights + (shown * edges).sum() - log_z - penalty / 2 * (x @ x)
        slope = np.concatenate(
            [counted - np.bincount(f.feature, content[f.node], len(names)), (shown - np.stack([joint[k].sum(axis=0) for k in of_kind])).ravel()]
        )
        return value, slope - penalty * x

    x = _climb(likelihood, np.zeros(len(names) + 12), steps)
    return ContentModel(names, x[:-12], x[-12:].reshape(3, 2, 2))


def blocks_of(trees: list[Tree], model: ContentModel, cache: dict) -> Iterator[list[tuple[str, float]]]:
    """(text, content marginal) of the leaves of each page, in page order."""
    f = forest(trees, model.names, cache)
    content, _, _ = marginals(f, f.unary(model.weights), model.edges)
    at = 0
    for tree in trees:
        yield [(t, float(content[at + i])) for i, t in enumerate(tree.texts) if t]
        at += len(tree.texts)


def main_text(pages: DataFrame, model: ContentModel, keep: list[str], html: str = "html", threshold: float = 0.5) -> DataFrame:
    """keep..., text, n_chars: the main text of each page, its blocks joined by an empty line.

    A block is kept where the marginal of its leaf reaches `threshold`. Null and empty pages, and pages
    without such a block, have an empty text. Every row gives one row; other columns are not read.
    """
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    # the model grows with the labelled pages only
    held = shared(pages, model)

    def run(cols, own):
        model, cache = own
        *kept, raw = cols
        trees = [parse((h or b"").decode("utf-8", "replace")) for h in raw]
        texts = ["\n\n".join(t for t, p in blocks if p >= threshold) for blocks in blocks_of(trees, model, cache)]
        kept = [[v.decode() if isinstance(v, bytes) else v for v in c] for c in kept]
        return [*kept, texts, [len(t) for t in texts]]

    schema = ", ".join([*kinds, "text string, n_chars bigint"])
    return map_batches(pages.select(*keep, html), run, schema, lambda: (held(), {}))
