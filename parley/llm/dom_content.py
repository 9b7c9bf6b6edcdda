"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every text run is a node that is content or not.  A node's own potential comes from its markup and
text, and an edge potential ties it to its parent.  Sum-product messages pass up and down the tree and give each
node's chance of being content.  The weights are the most likely ones on labelled pages, starting from a prior.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>", re.S)
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")  # after a quote that never ends quotes are letters
BOGUS = re.compile(r"<[!?/][^>]*>")
HINT = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas math select head".split())  # their text is never shown as prose
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GOOD_TAG = frozenset(("article", "main"))
BAD_TAG = frozenset("nav header footer aside form button dialog menu label fieldset figcaption".split())
GOOD_HINT = frozenset("article content main post entry story body text prose".split())
BAD_HINT = frozenset("""ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies
    copyright disclaimer disqus footer form gdpr header masthead menu meta modal nav navbar navigation newsletter notice overlay pagination pager popup promo
    promotion recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget""".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXTUAL = frozenset(("p", "blockquote", "pre", "li", "td", "dd"))

UNARY = ("bias", "good tag", "bad tag", "good hint", "bad hint", "heading", "textual", "run", "length", "sentences", "in link", "links")
EDGE = ("plain", "run", "bad child", "good child")  # kinds of edges, each with a weight for equal states


@dataclass
class Weights:
    unary: np.ndarray = field(default_factory=lambda: np.array([-0.5, 4.0, -6.0, 2.0, -5.0, 0.3, 0.5, 0.0, 0.3, 0.5, -0.5, -2.0]))
    edge: np.ndarray = field(default_factory=lambda: np.array([3.0, 4.0, 0.5, 0.5]))


class Page:
    """Nodes of one page in document order; a parent stands before its children.  Text runs have ``block`` numbers."""

    __slots__ = ("parent", "depth", "x", "kind", "text", "block", "tags")

    def __init__(self, source: str):
        self.parent, self.depth, self.x, self.kind, self.text, self.block, self.tags = [-1], [0], [], [0], [None], [-1], ["#root"]
        facts = [(0, 0, 0, 0, 0, 0)]
        # open elements: node, name, place of the nearest one that is no inline element, whether inside a link
        stack = [(0, "#root", 0, False)]
        opened: dict[str, int] = {}
        block, pos, chars, linked = 0, 0, [0], [0]
        last = None  # the element that the open block belongs to

        def shut(k: int) -> None:
            for entry in stack[k:]:
                opened[entry[1]] -= 1
            del stack[k:]

        def add_run(t: str) -> None:
            nonlocal last, block
            inside, link = stack[stack[-1][2]][0], stack[-1][3]
            if last != inside:
                block, last = block + 1, inside
            if not t.strip():
                if self.block[-1] == block and self.text[-1] is not None:
                    self.text[-1] += " "
                return
            n = len(t)
            self._add(stack[-1][0], 1, t, block, "#text")
            chars.append(n)
            linked.append(n * link)
            facts.append((0, 0, 0, 0, 0, link))

        end, final = len(source), source.rfind(">")
        broken, unclosed = False, set()
        while pos < end:
            stop, m = source.find("<", pos), None
            while stop >= 0:
                follows = source[stop + 1:stop + 2]
                if follows and follows in "!?/" or follows.isascii() and follows.isalpha():
                    if source.startswith("<!--", stop):
                        m = TAG.match(source, stop)
                    elif stop < final:
                        m = None if broken and follows.isalpha() else TAG.match(source, stop)
                        if m is None:
                            broken, m = True, BROKEN.match(source, stop) or BOGUS.match(source, stop)
                    if m:
                        break
                stop = source.find("<", stop + 1)
            if stop < 0:
                stop = end
            if stop > pos:
                add_run(source[pos:stop])
            if not m:
                break
            pos = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if opened.get(name):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == name)
                    shut(k)
                    if name not in INLINE:
                        last = None
                continue
            if name == "br":
                add_run(" ")
                continue
            if name in RAW:
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, pos)
                if not close:
                    unclosed.add(name)
                if name != "head":
                    pos = close.end() if close else (end if name in ("script", "style") else pos)
                elif close:
                    pos = close.end()
                continue
            if name in VOID:
                if name not in INLINE:
                    last = None
                continue
            if name not in INLINE:
                last = None
                k = stack[-1][2]
                tag = stack[k][1]
                if k and (tag == "p" and name not in ("td", "th", "tr") or tag in CLOSES.get(name, ())):
                    shut(k)
            hints = {w for h in HINT.findall(m[3]) for w in WORD.findall("".join(h).lower())} if m[3] else ()
            good, bad = bool(GOOD_HINT.intersection(hints)), bool(BAD_HINT.intersection(hints))
            self._add(stack[-1][0], 0, None, -1, name)
            chars.append(0)
            linked.append(0)
            facts.append((name in GOOD_TAG, name in BAD_TAG, good and not bad, bad, name in HEADING, name in TEXTUAL))
            if not m[0].endswith("/>"):
                stack.append((len(self.parent) - 1, name, stack[-1][2] if name in INLINE else len(stack), stack[-1][3] or name == "a"))
                opened[name] = opened.get(name, 0) + 1
        for i in range(len(self.parent) - 1, 0, -1):  # a parent stands before its children
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        for i, (kind, fact) in enumerate(zip(self.kind, facts, strict=True)):
            share = linked[i] / chars[i] if chars[i] else 0.0
            t = self.text[i]
            if kind:
                self.x.append((1.0, 0, 0, 0, 0, 0, 0, 1.0, min(len(t), 1000) ** 0.5 / 10, min(t.count(". ") + t.count(".\n") + t.endswith("."), 5) / 2, fact[5], 0))
            else:
                self.x.append((1.0, *fact, 0, 0, 0, 0, share))

    def _add(self, parent: int, kind: int, text: str | None, block: int, tag: str) -> None:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.text.append(text)
        self.block.append(block)
        self.tags.append(tag)


class Forest:
    """Trees of several pages, their nodes sorted by depth for messages level by level."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages])
        self.first = np.r_[0, np.cumsum(size)]
        self.x = np.array([r for p in pages for r in p.x], float).reshape(-1, len(UNARY))
        self.kind = np.array([k for p in pages for k in p.kind])
        self.parent = np.array([q for p in pages for q in p.parent]) + np.repeat(self.first[:-1], size)
        depth = np.array([d for p in pages for d in p.depth])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
        self.sort_edges()

    def sort_edges(self) -> None:
        bad, good = (self.x[:, 2] > 0) | (self.x[:, 4] > 0), (self.x[:, 1] > 0) | (self.x[:, 3] > 0)
        self.edge = np.where(self.kind == 1, 1, np.where(bad, 2, np.where(good, 3, 0)))

    def marginals(self, w: Weights) -> tuple[np.ndarray, np.ndarray]:
        """Chance of content of each node, and of each node being in its parent's state."""
        own = np.zeros((len(self.x), 2))
        own[:, 1] = self.x @ w.unary
        same = w.edge[self.edge]
        # up: what each subtree says about its root's parent
        inside, up = own.copy(), np.zeros_like(own)
        for level in self.levels[:0:-1]:
            a = inside[level]
            for state in (0, 1):
                up[level, state] = np.logaddexp(a[:, state] + same[level], a[:, 1 - state])
            np.add.at(inside, self.parent[level], up[level])
        # down: what the rest of the tree says about each node
        belief = inside.copy()
        together = np.zeros(len(own))
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - up[level]
            down = np.stack([np.logaddexp(rest[:, s] + same[level], rest[:, 1 - s]) for s in (0, 1)], axis=1)
            belief[level] = inside[level] + down
            joint = [inside[level][:, s] + rest[:, s] + same[level] for s in (0, 1)]
            total = np.logaddexp(belief[level][:, 0], belief[level][:, 1])
            together[level] = np.exp(np.logaddexp(*joint) - total)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), together


def labelled(page: Page) -> np.ndarray | None:
    """States of a page whose markup names its article: inside it, outside whatever is named as something else."""
    if not any(t in GOOD_TAG for t in page.tags):
        return None
    state = np.zeros(len(page.parent))
    for i in range(1, len(state)):
        x = page.x[i]
        state[i] = 0 if x[2] or x[4] else 1 if x[1] else state[page.parent[i]]
    return state


@dataclass(frozen=True)
class Training:
    """Labelled pages used at most (those with the smallest hashed ids), steps, rate, and how firmly the prior holds."""

    most: int = 400
    steps: int = 60
    rate: float = 0.05
    prior: float = 2.0
    seed: int = 3


def fitted(pages: list[Page], how: Training) -> Weights:
    """The most likely weights.  Pages come twice, once with the names of the article and of half of the other parts hidden."""
    prior, w, rng = Weights(), Weights(), np.random.default_rng(how.seed)
    known = [(p, s) for p in pages if (s := labelled(p)) is not None]
    if not known:
        return w
    plain, masked = Forest([p for p, _ in known]), Forest([p for p, _ in known])
    masked.x[:, [1, 3]] = 0
    masked.x[:, [2, 4]] *= rng.random((len(masked.x), 1)) < 0.5
    masked.sort_edges()
    state = np.concatenate([s for _, s in known])
    moments = [np.zeros(len(UNARY)), np.zeros(len(EDGE)), np.zeros(len(UNARY)), np.zeros(len(EDGE))]
    for step in range(1, how.steps + 1):
        gu, ge = how.prior * (prior.unary - w.unary), how.prior * (prior.edge - w.edge)
        for f in (plain, masked):
            p, together = f.marginals(w)
            gu = gu + f.x.T @ (state - p)
            agree = (state == state[f.parent]).astype(float)
            agree[f.levels[0]] = together[f.levels[0]] = 0
            ge = ge + np.bincount(f.edge, agree - together, len(EDGE))
        for k, g in enumerate((gu, ge)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            change = how.rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
            if k:
                w.edge = w.edge + change
            else:
                w.unary = w.unary + change
    return w


def main_text(page: Page, content: np.ndarray) -> str:
    """Text of the blocks that are content by the mean over their letters: runs of a block together, blocks one space apart."""
    blocks: dict[int, list] = {}
    for text, block, p in zip(page.text, page.block, content, strict=True):
        if text is not None:
            held = blocks.setdefault(block, [[], 0.0])
            held[0].append(text)
            held[1] += (p - 0.5) * len(text)
    done = (" ".join(html.unescape("".join(runs)).split()) for runs, more in blocks.values() if more >= 0)
    return " ".join(b for b in done if b)


def trained(pages: DataFrame, how: Training) -> Weights:
    """Weights learnt from ``how.most`` pages: their ids are picked first, and only those pages come to the driver, one for each id."""
    there = pages.filter("html IS NOT NULL AND page_id IS NOT NULL")
    ids = [r[0] for r in there.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(how.most).collect()]
    picked = there.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    return fitted([Page(r["html"]) for r in picked.orderBy(F.xxhash64("page_id"), "page_id").collect()], how)


def extracted(pages: DataFrame, how: Training | None = None) -> DataFrame:
    """(page_id, url, text): the main text of every page, empty where there is none; null html counts as empty.

    Character references are decoded, white space in a block is one space, blocks are one space apart.  Repeated rows
    are extracted each; an empty table gives no rows.  Scripts, styles and other elements that show no prose have no nodes.
    """
    weights = pages.sparkSession.sparkContext.broadcast(trained(pages, how or Training()))  # a few numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                trees = [Page(x or "") for x in part.column("html").to_pylist()]
                forest = Forest(trees)
                p, _ = forest.marginals(weights.value)
                texts = [main_text(t, p[a:b]) for t, a, b in zip(trees, forest.first[:-1], forest.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string")
