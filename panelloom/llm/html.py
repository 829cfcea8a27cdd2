"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block the cost of
calling it content and of calling it boilerplate: these are the capacities to
the two terminals. Blocks that follow each other are joined by edges that weaken
with their distance in the page's tree, and so are the nearest blocks under one
parent and in one section. The minimum cut of that graph is the cheapest labelling; blocks on the
content side are the main text. All blocks go through the flow.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import spread

# Element names by their part in a page (fixed values of HTML).
SKIPPED = frozenset("script style noscript template iframe object svg math canvas head title select option textarea button datalist audio video map".split())
BOILER = frozenset("nav footer aside form header menu dialog fieldset".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
# Words of class, id and role that mark boilerplate, reader comments or content (fixed values).
BAD_WORDS = frozenset("ad ads advert advertisement advertising adverts sponsor sponsored sponsors promo promotion promos banner cookie cookies consent notice notices popup modal nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer header masthead share sharing social related recommend recommended recommendations newsletter subscribe subscription login signup search tags pager pagination widget widgets hidden copyright legal toolbar".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
GOOD_WORDS = frozenset("article content main post entry story text body".split())
#: A word behind one of these is told not to hold.
DENIED = frozenset("no not has with without is hide hides non".split())

#: Weights of the classifier before it is fitted: bias, log of words, share of linked characters,
#: sentence end, list item, heading, then the place: main element, boilerplate element, bad word, good word.
WEIGHTS = (-2.0, 1.1, -5.0, 1.0, -0.8, 0.3, 1.0, -4.0, -4.0, 1.0)
#: The first so many are of the text itself.
PLAIN = 6
#: How firmly the fit holds on to them.
RIDGE = 20.0
#: Log-odds beyond which a block's cost does not grow.
SUREST = 8.0
#: The weights are learned on at most this many pages of so many characters at most each.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
#: Cost of parting two blocks that follow each other, or the nearest two under one parent or in one
#: section; each step in the page's tree beyond siblings leaves a share of it, and each border of a
#: landmark (or marked element) that lies between them a smaller one.
NEXT_TO, SAME_PARENT, SAME_SECTION, STEP_SHARE, BORDER_SHARE = 2.0, 1.0, 4.0, 0.7, 0.2

#: Elements between two blocks beyond which their edge is nothing; the share of the page's text that
#: must stand elsewhere for a name to count in full.
FAR, ENOUGH = 64, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECES = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。！？](?=\s|$)")
_WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    at: int  # its element in the page's tree
    main: bool
    boiler: bool
    mark: int  # the element whose name calls it boilerplate or a comment, or 0
    good: bool
    bad: float = 0.0  # how much that name is worth, see weigh_marks


class Tree:
    """Elements of a page by number: parent, depth, and whether a landmark or a marked element begins there. 0 is the page."""

    __slots__ = ("border", "depth", "home", "parent")

    def __init__(self) -> None:
        self.parent, self.depth, self.border, self.home = [0], [0], [False], [0]

    def add(self, parent: int, border: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.border.append(border)
        self.home.append(len(self.home) if border else self.home[parent])
        return len(self.parent) - 1

    def apart(self, a: int, b: int) -> tuple[int, int]:
        """(elements, borders) passed between two elements; beyond FAR they do not count any more."""
        steps = borders = 0
        while a != b and steps < FAR:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            borders += self.border[a]
            a = self.parent[a]
            steps += 1
        return steps, borders


def marks_of(words: str) -> tuple[bool, bool, bool]:
    """(bad, comment, good) for the value of a class, id or role: the first or the last word of a name
    counts, but not one behind a word such as ``no``."""
    bad = comment = good = False
    for name in words.split():
        parts = [x.lower() for x in _PIECES.split(name) if x]
        if not parts or parts[0] in DENIED:
            continue
        for x in {parts[0], parts[-1]}:
            bad, comment, good = bad or x in BAD_WORDS, comment or x in COMMENT_WORDS, good or x in GOOD_WORDS
    return bad, comment, good


@dataclass(slots=True)
class _Open:
    """An open element, with what it has of those around it."""

    name: str
    at: int = 0
    block: tuple[str, int] = ("", 0)  # name and number of the innermost element that is not inline
    main: bool = False
    boiler: bool = False
    bad: int = 0  # the outermost element marked so
    comment: int = 0
    good: bool = False
    skipped: bool = False


def blocks_of(page: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order, and the tree they stand in; markup, scripts, styles and comments are gone.

    Time and memory follow the length of the page, however deep its elements nest."""
    out: list[Block] = []
    tree = Tree()
    stack = [_Open("")]
    opened: dict[str, int] = {}
    links, at = 0, 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _WHITE.sub(" ", "".join(text)).strip()
            if joined:
                top = stack[-1]
                out.append(Block(joined, min(linked, len(joined)), *top.block, top.main, top.boiler, top.comment or top.bad, top.good))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].skipped:
            piece = entities.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())

    def close(to: int) -> None:
        nonlocal links
        for x in stack[to:]:
            links -= x.name == "a"
            opened[x.name] -= 1
        del stack[to:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name == "br" and text:
            text.append(" ")
        if m[1]:
            if not opened.get(name):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break
            continue
        if name in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "tr": ("tr", "td", "th")}.get(name, (name,) if name == "option" else ("dt", "dd") if name[0] == "d" else ("td", "th"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in peers:
                    close(k)
                    break
                if stack[k].name not in INLINE and stack[k].name != "p":
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        above = stack[-1]
        bad = comment = good = skipped = False
        if m[3]:
            for key, value in _ATTRIBUTE.findall(m[3]):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    found = marks_of(value)
                    bad, comment, good = bad or found[0], comment or found[1], good or found[2]
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                    skipped = True
        if name in ("html", "body"):
            bad = comment = good = False
        # a main element speaks against the words on it and around it, but for those of comments
        outer = name in MAIN and not above.main
        if outer:
            bad = False
            comment = comment and name != "main"
        # a header inside an article heads that article
        lands = name in BOILER and not (name == "header" and above.main)
        border = lands or name in MAIN or bad or comment
        here = tree.add(above.at, border)
        opened[name] = opened.get(name, 0) + 1
        block = above.block if name in INLINE else (name, here)
        over = 0 if outer else above.bad
        stack.append(_Open(name, here, block, above.main or name in MAIN, above.boiler or lands, over or (here if bad else 0), above.comment or (here if comment else 0), above.good or good, above.skipped or skipped or name in SKIPPED))
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    flush()
    weigh_marks(out)
    return out, tree


def weigh_marks(blocks: list[Block]) -> None:
    """What a name is worth against a block: nothing where nearly all text of the page stands under it, as
    then it tells of the page's layout; all where a share of ENOUGH of the text stands elsewhere, or some
    of it in a main element. Links and the text of landmarks do not count."""
    inside: dict[int, int] = {}
    for b in blocks:
        if not b.boiler and 3 * b.linked < len(b.text):
            inside[b.mark] = inside.get(b.mark, 0) + b.text.count(" ") + 1
    total = sum(inside.values())
    told = not total or any([b.main and not b.mark and not b.boiler for b in blocks])
    for b in blocks:
        if b.mark:
            b.bad = 1.0 if told else min(1.0, (1 - inside.get(b.mark, 0) / total) / ENOUGH)


def features(b: Block) -> tuple[float, ...]:
    """Plain features of the text, then those of its place; a boilerplate mark takes away that of the main element."""
    words = b.text.count(" ") + 1
    apart = b.boiler or b.bad > 0.5
    plain = (1.0, math.log(words), b.linked / len(b.text), float(bool(_SENTENCE.search(b.text))), float(b.tag == "li"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()))
    return (*plain, float(b.main and not apart), float(b.boiler), b.bad, float(b.good and not apart))


def fit_weights(pages: Iterable[str | None], steps: int = 25, ridge: float = RIDGE) -> tuple[float, ...]:
    """Logistic regression on blocks that the page itself marks: those in a main
    element against those in menus, footers and the like. As the marks are the
    places, the text's own features alone are fitted and the weights of the place
    stay as they are. Without both kinds: WEIGHTS."""
    rows, marks = [], []
    for page in pages:
        for b in blocks_of(page or "")[0]:
            if b.main or b.boiler or b.bad > 0.5:
                rows.append(features(b)[:PLAIN])
                marks.append(float(b.main and not (b.boiler or b.bad > 0.5)))
    if len(set(marks)) < 2:
        return WEIGHTS
    x, y = np.array(rows), np.array(marks)
    start = np.array(WEIGHTS[:PLAIN])
    w = start.copy()
    for _ in range(steps):  # Newton's method, drawn to the start by the ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * (w - start))
    return (*w.tolist(), *WEIGHTS[PLAIN:])


def log_odds(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Of a block being content, by the classifier."""
    return max(-SUREST, min(SUREST, sum([w * x for w, x in zip(weights, features(b), strict=True)])))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of the minimum cut (the smallest such side).

    Dinic's maximum flow by breadth-first levels and depth-first blocking flows."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, forth: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(forth)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for v in range(n):
        push = min(source[v], sink[v])  # flows straight through
        if source[v] > push:
            join(s, v, source[v] - push, 0.0)
        elif sink[v] > push:
            join(v, t, sink[v] - push, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            u = todo.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= tiny and not cut:
                        cut = k + 1
                u = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while next_[u] < len(out[u]):
                e = out[u][next_[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                next_[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                next_[u] += 1


def smoothness(blocks: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Edges between blocks in a row, between the nearest under one parent and in one section, by their distance in the page's tree."""

    def edge(i: int, j: int, cost: float) -> tuple[int, int, float]:
        steps, borders = tree.apart(blocks[i].at, blocks[j].at)
        return i, j, cost * STEP_SHARE ** max(0, steps - 2) * BORDER_SHARE**borders

    edges = [edge(i, i + 1, NEXT_TO) for i in range(len(blocks) - 1)]
    last: dict[tuple[str, int], int] = {}
    for i, b in enumerate(blocks):
        # the innermost bordered element around it is the section it belongs to
        for key, cost in ((("parent", tree.parent[b.at]), SAME_PARENT), (("section", tree.home[b.at]), SAME_SECTION)):
            if key in last:
                edges.append(edge(last[key], i, cost))
            last[key] = i
    return edges


def content(blocks: list[Block], tree: Tree, weights: tuple[float, ...] = WEIGHTS) -> list[bool]:
    """Labels of the minimum cut: a block's log-odds are its capacity to one terminal or the other."""
    z = [log_odds(b, weights) for b in blocks]
    return min_cut([max(0.0, x) for x in z], [max(0.0, -x) for x in z], smoothness(blocks, tree))


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """Content blocks joined by an empty line; empty for a null or empty page."""
    blocks, tree = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, content(blocks, tree, weights), strict=True) if keep)


def sampled_pages(pages: DataFrame, limit: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Html of ``limit`` pages (lowest hash of page_id and html) of up to ``chars`` characters."""
    able = pages.where(F.length("html") <= chars).select(F.xxhash64("page_id", "html").alias("k"), "html")
    names = [r.k for r in able.select("k").distinct().orderBy("k").limit(limit).collect()]
    rows = able.where(F.col("k") <= names[-1]).dropDuplicates(["k"]).collect() if names else []
    return [r.html for r in sorted(rows)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Null and empty html give empty text; blocks whose two labels cost the same are
    boilerplate; a very long page is parsed whole, its graph has an edge or two for
    each block; rows that repeat are each returned; an empty table gives an empty
    result; extra columns are ignored."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = fit_weights(sampled_pages(pages))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages).mapInArrow(run, "page_id long, url string, text string, n_chars long")
