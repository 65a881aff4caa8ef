"""HTML extraction (operator 1): main text by a graphical model on the tree of the page.

A page is parsed into a tree whose nodes are its elements (inline elements without attributes of their
own belong to their parent). Each node is content or not; a node's potential comes from its tag, the
words of its class and id, the amount, links and punctuation of its text and its place; each edge has
a parent-child potential by the kind of the child. Sum-product messages go up the tree and down again,
which on a tree gives exact marginals. A text belongs to the main text where its element's marginal is
0.5 or more. Potentials are fitted by gradient ascent on the likelihood of labelled pages, which are
generated (training_pages.py): the gradient is the observed less the expected counts, and the expected
ones come from the same messages.

All pages of a batch are one forest: messages are computed for all nodes of a depth at once.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones left out and the others joined by two line feeds. Blocks begin and end with
block elements; a line break is white space. Scripts, styles and other elements whose content is no
markup have no text; what stands in noscript, object and canvas is read as by a browser without
scripts; drawings and lists to choose from have no text and end where a block begins in them.

Defined results: null and empty pages have an empty text; broken markup is read as browsers do (tags
that are left open end with their parent, unknown end tags don't count, an unfinished tag or comment
at the end of the page is dropped; where a quoted attribute never ends, it ends with its tag); pages of
any length and depth are read whole, in time that grows with their length. Repeated rows are extracted
each.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.llm.common import map_texts
from sparkfolio.llm.training_pages import labelled_pages

PAGES, PASSES, RATE, DECAY = 1200, 150, 0.15, 1e-4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What stands in them is no markup and no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes template".split())
#: Their text is no text of the page, up to their end or the beginning of a block.
MUTE = frozenset("svg math select datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
LISTS, CELLS = frozenset(("ul", "ol", "menu", "dir")), frozenset(("td", "th", "caption"))
#: End tags that reach over the border of a cell.
OVER = frozenset(("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"))
#: A start tag of the key ends an open element of these, up to a border.
ENDS = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))")
#: A tag whose quotes don't count.
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"\S+")
SENTENCE = re.compile(r"[.!?。！？][\s\"'»”)]")
#: Kinds of edges by the child's tag.
KINDS = {**dict.fromkeys(INLINE, 1), **dict.fromkeys(("p", "pre", "blockquote", "figcaption"), 2), **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), 3),
         **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 4), **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), 5),
         **dict.fromkeys(("article", "main", "section"), 6), **dict.fromkeys(("nav", "header", "footer", "aside", "form"), 7), "html": 8, "body": 8}
EDGES = 9


@dataclass
class Tree:
    """A page: for each node its parent, tag and names (of class, id and role), and the pieces of text in page order.

    pieces: (node, text, linked) with node < 0 for the border of a block.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and whether the element is hidden."""
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            out += [x.lower() for x in NAMES.findall(value)]
        elif key == "role":
            out.append(f"role-{value.strip().lower()}")
        elif key == "hidden" or (key == "style" and HIDDEN.search(value)) or (key == "aria-hidden" and value.strip().lower() == "true"):
            out.append("is-hidden")
    return tuple(dict.fromkeys(out))


class Stack:
    """Open elements (tag, node), plain inline ones with their parent's node, and where each tag stands among them."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.where: dict[str, list[int]] = {}
        self.blocks, self.cells, self.mutes = [0], [0], [0]  # numbers of elements that aren't inline, of cells, and of those without text

    def push(self, tag: str, node: int) -> None:
        k = len(self.open)
        self.open.append((tag, node))
        self.where.setdefault(tag, []).append(k)
        for test, at in ((tag not in INLINE and tag not in MUTE, self.blocks), (tag in CELLS, self.cells), (tag in MUTE, self.mutes)):
            if test:
                at.append(k)

    def cut(self, to: int) -> bool:
        """End the open elements from number to on; whether a block that may have text was among them."""
        shown = self.mutes[1] if len(self.mutes) > 1 else len(self.open)
        block = bisect_left(self.blocks, to) < bisect_left(self.blocks, shown)
        for tag, _ in self.open[to:]:
            self.where[tag].pop()
        del self.open[to:]
        for at in (self.blocks, self.cells, self.mutes):
            while at[-1] >= to:
                at.pop()
        return block

    def last(self, tags: Iterable[str]) -> int:
        """Number of the innermost open element of these tags, 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.where.get(t))), default=0)


def parse(page: str) -> Tree:
    tree = Tree()
    parent, tags, names, pieces = tree.parent, tree.tag, tree.names, tree.pieces
    stack = Stack()
    at, end, seek, match = 0, len(page), page.find, TAG.match
    ends: dict[str, int] = {}  # where a raw element's end tag was looked for in vain

    def close(to: int) -> None:
        if stack.cut(to):
            pieces.append((-1, "", False))

    def text(piece: str) -> None:
        if not stack.mutes[-1]:
            pieces.append((stack.open[-1][1], html.unescape(piece) if "&" in piece else piece, bool(stack.where.get("a"))))

    while at < end:
        begin = seek("<", at)
        m = None
        while begin >= 0 and (m := match(page, begin)) is None:
            if page[begin + 1 : begin + 2].isascii() and page[begin + 1 : begin + 2].isalpha() or (page[begin + 1 : begin + 2] == "/" and page[begin + 2 : begin + 3].isalpha()):
                match = BARE.match  # a quote that never ends
                if (m := match(page, begin)) is None:
                    break
                break
            begin = seek("<", begin + 1)
        if begin < 0 or m is None:
            if rest := page[at : begin if begin >= 0 else end]:  # behind it, an unfinished tag
                text(rest)
            break
        if begin > at:
            text(page[at:begin])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text("\n")
            continue
        if m[1]:
            k = stack.last((tag,))
            if k and not (tag in INLINE and stack.blocks[-1] > k) and not (tag not in OVER and stack.cells[-1] > k):
                close(k)
            continue
        if stack.mutes[-1] and tag in BLOCKS:
            close(stack.mutes[1])
        if tag in VOID:
            if tag == "hr":
                pieces.append((-1, "", False))
            continue
        if tag in RAW:
            if tag not in ends:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if stop is None:
                    ends[tag] = at
                at = stop.end() if stop else end
            continue
        own = names_of(m[3]) if m[3] else ()
        if tag in INLINE:
            if tag == "a" and (k := stack.last(("a",))) and stack.blocks[-1] < k:
                close(k)
            if not own:
                stack.push(tag, stack.open[-1][1])
                continue
        else:
            k, border = (stack.last(ENDS[tag][0]), stack.last(ENDS[tag][1])) if tag in ENDS else (0, 0)
            if k <= border:
                k, border = stack.last(("p",)), stack.cells[-1]
            if k > border and tag not in MUTE and (k > stack.mutes[-1] or not stack.mutes[-1]):
                close(k)
            if tag not in MUTE and not stack.mutes[-1]:
                pieces.append((-1, "", False))
        parent.append(stack.open[-1][1])
        tags.append(tag)
        names.append(own)
        if m[3][-1:] != "/" or tag not in MUTE:
            stack.push(tag, len(parent) - 1)
    return tree


def bucket(n: float) -> int:
    return min(9, int(math.log2(n + 1)))


def features_of(tree: Tree) -> list[list[str]]:
    """Features of each node, from itself and all that is below it."""
    n = len(tree.parent)
    parent = np.array(tree.parent)
    own = np.zeros((n, 4))  # words, linked words, ends of sentences, signs of a notice of rights
    before = np.zeros(n)
    seen = 0
    for node, piece, linked in tree.pieces:
        if node < 0 or piece.isspace():
            continue
        words = piece.count(" ") + 1
        own[node] += (words, words if linked else 0, len(SENTENCE.findall(piece + " ")), "©" in piece)
        seen += words
    total = own.copy()
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    where = 0.0
    for k in range(n):
        before[k] = where
        where += own[k, 0]
    inside = [""] * n
    out = []
    for k in range(n):
        tag = tree.tag[k]
        up = inside[tree.parent[k]] if k else ""
        inside[k] = "article" if tag in ("article", "main") or (up == "article" and tag not in ("aside", "nav", "form")) else up
        if tag in ("nav", "aside", "form"):
            inside[k] = "side"
        elif tag in ("header", "footer") and up != "article":
            inside[k] = "edge"
        words, linked, ends, rights = total[k]
        density = int(4 * linked / words) if words else 5
        place = int(4 * before[k] / (where + 1)) if where else 0
        fs = [f"tag:{tag}", f"in:{up}:{tag}", f"words:{bucket(words)}", f"links:{density}", f"kind:{KINDS.get(tag, 0)}:{density}:{bucket(words) // 2}", f"ends:{bucket(ends)}", f"place:{place}", f"share:{int(5 * words / (seen + 1))}"]
        fs += [f"name:{x}" for x in tree.names[k]]
        if not tree.names[k]:
            fs.append("name:")
        if rights and words < 60:
            fs.append("rights")
        if k:
            fs.append(f"under:{tree.tag[tree.parent[k]]}:{KINDS.get(tag, 0)}")
        out.append(fs)
    return out


class Forest:
    """Trees side by side, with their nodes dealt by depth."""

    def __init__(self, trees: Iterable[Tree]) -> None:
        parent, kind, depth = [], [], []
        for t in trees:
            base = len(parent)
            for k, p in enumerate(t.parent):
                parent.append(base + p if k else -1)
                kind.append(KINDS.get(t.tag[k], 0))
                depth.append(depth[base + p] + 1 if k else 0)
        self.parent, self.kind, deep = np.array(parent, np.int64), np.array(kind, np.int64), np.array(depth, np.int64)
        order = np.argsort(deep, kind="stable")
        ends = np.searchsorted(deep[order], np.arange(deep.max() + 2 if len(deep) else 1))
        self.levels = [order[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of both states of each node, and of the states of parent and child for each node but the roots.

        unary: log potentials (n, 2); pair: log potentials (kind, parent's state, child's state).
        """
        n = len(self.parent)
        up, message = unary.copy(), np.zeros((n, 2))  # message: from a node to its parent
        edge = pair[self.kind]
        for level in reversed(self.levels[1:]):
            x = edge[level] + up[level][:, None, :]
            message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        down = np.zeros((n, 2))  # from the parent to a node
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = up[p] + down[p] - message[level]  # the parent without this child
            x = edge[level] + rest[:, :, None]
            down[level] = np.logaddexp(x[:, 0, :], x[:, 1, :])
            down[level] -= down[level].max(axis=1, keepdims=True)
            full = x + up[level][:, None, :]
            full -= full.max(axis=(1, 2), keepdims=True)
            e = np.exp(full)
            both[level] = e / e.sum(axis=(1, 2), keepdims=True)
        total = up + down
        total -= total.max(axis=1, keepdims=True)
        e = np.exp(total)
        return e / e.sum(axis=1, keepdims=True), both


@dataclass
class Model:
    """Weights of features for the state content, and of pairs of states by the kind of the child."""

    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def unary(self, features: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.weights
        score = np.array([sum(w[i] for f in fs if (i := get(f)) is not None) for fs in features])
        return np.stack([np.zeros(len(score)), score], axis=1)


def fit(pages: list[tuple[str, list[bool]]], passes: int = PASSES) -> Model:
    """pages: each with a label for every node of its tree."""
    trees = [parse(p) for p, _ in pages]
    for t, (p, labels) in zip(trees, pages, strict=True):
        if len(t.parent) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(t.parent)} nodes: {p[:200]}")
    gold = np.array([x for _, labels in pages for x in labels], np.int64)
    features = [fs for t in trees for fs in features_of(t)]
    counts: dict[str, int] = {}
    for fs in features:
        for f in fs:
            counts[f] = counts.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c > 2))}
    rows = np.array([k for k, fs in enumerate(features) for f in fs if f in index])
    cols = np.array([index[f] for fs in features for f in fs if f in index])
    forest = Forest(trees)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.kind[child], gold[forest.parent[child]], gold[child]), 1)
    w, pair = np.zeros(len(index)), np.zeros((EDGES, 2, 2))
    mw, vw, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)
    n = len(gold)
    for t in range(1, passes + 1):
        unary = np.stack([np.zeros(n), np.bincount(rows, w[cols], n)], axis=1)
        p, both = forest.marginals(unary, pair)
        gw = np.bincount(cols, (gold - p[:, 1])[rows], len(w)) / n - DECAY * w
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, forest.kind[child], both[child])
        gp = (seen - expected) / n - DECAY * pair
        for x, g, m, v in ((w, gw, mw, vw), (pair, gp, mp, vp)):  # steps scaled by running means of the gradient
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Model(index, w, pair)


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages(PAGES))


def text_of(tree: Tree, content: np.ndarray) -> str:
    """The pieces whose node is content, by block."""
    blocks: list[str] = []
    now: list[str] = []
    for node, piece, _ in tree.pieces:
        if node < 0:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif content[node]:
            now.append(piece)
    if now:
        blocks.append(" ".join("".join(now).split()))
    return "\n\n".join(b for b in blocks if b)


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = forest.marginals(np.concatenate([model.unary(features_of(t)) for t in trees]), model.pair)
    out, at = [], 0
    for t in trees:
        out.append(text_of(t, p[at : at + len(t.parent), 1] >= 0.5))
        at += len(t.parent)
    return out


def extract_text(pages: DataFrame, keys: list[str], html_column: str = "html") -> DataFrame:
    """keys of pages with text and n_chars (code points) of each page's main text."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def start():
        model = sent.value

        def work(texts: list[str]) -> dict[str, pa.Array]:
            got: list[str] = []
            for at in range(0, len(texts), 64):
                got += main_texts(texts[at : at + 64], model)
            return {"text": pa.array(got, pa.string()), "n_chars": pa.array([len(t) for t in got], pa.int64())}

        return work

    return map_texts(pages, keys, start, "text string, n_chars bigint", html_column)
