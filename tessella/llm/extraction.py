"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks, the runs of text between block-level tags, each with the elements it stands in. Two things say
what a block is: marks of its elements (navigation, advertisements, comments by tag, role, class and id, against articles) and
a logistic model of what the block is like (tag, length, links, punctuation, place). Their costs are the capacities of the
edges from the source (content) and to the sink (boilerplate). Blocks that follow each other, that share a parent or a
grandparent are joined by edges that cost something to cut, the less the further they are apart in the tree. The maximum flow
gives the cheapest labelling. Blocks whose own evidence outweighs all their edges are settled before (no cheapest labelling
can differ), what is left is small.

The model is fitted here, to blocks whose marks leave no doubt, of the pages (FITTED of them at most, chosen by a hash of the
id and the address) that have such marks; features are steps, so the table that is fitted is one of counts whose size is
bounded whatever the input. Its prior are weights for long texts and against links, which stand where there are no marks.

Null or empty html has an empty text, and so has a page of boilerplate alone. Repeated pages and ids get each a row, equal ones
for equal pages; ties go to boilerplate only where the evidence is exactly even. Very long pages are read one at a time, in
time that grows with their length but for the flow. An empty table gives an empty result; columns named like what is made are
not read.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pages that the model is fitted on, about.
FITTED = 20_000

# tags of the public standard (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br".split()
)
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
RAW = frozenset("script style xmp noembed noframes iframe textarea title".split())
#: Open elements that a start tag ends, up to one of the elements in the second list.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: What is never part of a text, and what is boilerplate.
UNREAD = frozenset("script style xmp noembed noframes iframe textarea title head template noscript svg math canvas object audio video select datalist button".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "alertdialog": -1, "menu": -1, "menubar": -1, "toolbar": -1, "main": 1, "article": 1}
#: Words of classes and ids. Readers' words count even around an article, the others not.
READERS = frozenset("comment comments commentlist commenter disqus respond responses reply replies discussion reactions".split())
HEADS = frozenset("header headers head masthead heading".split())
AROUND = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar footer bottom colophon sidebar aside rail widget widgets notice notices cookie cookies consent gdpr banner alert popup modal overlay "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser copyright legal "
    "disclaimer form search toolbar skip tags outbrain taboola".split()
)
#: Names of advertisements in one word, and words that say of a page that it has or lacks something.
_ADVERT = re.compile(r"ads?(box|slot|unit|container|wrap|wrapper|banner|space|block|bygoogle|label)")
STATES = frozenset("has with without no is show hide open closed".split())
INSIDE = frozenset("article articlebody post entry story content main maincontent body text prose".split())

# terminal capacities of marks and edges; the model's are at most MODEL
SURE, LIKELY, MODEL = 12.0, 4.0, 3.0
FOLLOWS, SIBLING, COUSIN = 0.8, 0.6, 0.3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_QUOTE_OR_END = re.compile(r""">|=\s*(["'])""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    mark: int = 0  # see mark_of
    holds_article: bool = False


@dataclass
class Block:
    text: str
    element: int
    tag: str
    linked: int  # characters in links
    place: float = 0.0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0)])
    blocks: list[Block] = field(default_factory=list)


def mark_of(tag: str, attributes: str) -> tuple[int, bool]:
    """The mark of an element, and whether it is hidden. Marks: -2 boilerplate whatever it holds, -1 unless it holds an article,
    -3 a header, which belongs to what is around it; 1 an article, 2 the main part, 3 the name of a main part."""
    if tag in OUTSIDE:
        return (-1 if tag == "form" else -2), False
    mark = {"article": 1, "main": 2, "header": -3, "hgroup": -3}.get(tag, 0)
    if not attributes or tag in ("html", "body"):
        return mark, False
    hidden, words, role = False, set(), ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for own in value.split():
                parts = _WORD.findall(_CAMEL.sub(" ", own).lower())
                if parts and parts[0] not in STATES:
                    words.update(parts)
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    hidden |= "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|$|=|/)", _VALUE.sub("=", attributes)) is not None
    if READERS.intersection(words):
        return -2, hidden
    if role in ROLES:
        return (ROLES[role] if ROLES[role] < 0 else 2 if role == "main" else 1), hidden
    if mark != 2 and (AROUND.intersection(words) or any(map(_ADVERT.fullmatch, words))):
        return -1, hidden
    if mark == 0 and HEADS.intersection(words):
        return -3, hidden
    if mark == 0 and INSIDE.intersection(words):
        return 3, hidden
    return mark, hidden


class Reader:
    """Reads html into blocks, each position once."""

    def __init__(self, html: str) -> None:
        self.html, self.page = html, Page()
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.unread = 0
        self.links = 0
        self.linked = 0
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where what stands from a place on; what is not there any more is not looked for again."""
        if what in self.missing:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def text(self, part: str) -> None:
        if part and not self.unread:
            if "&" in part:
                part = references.unescape(part)
            self.parts.append(part)
            if self.links:
                self.linked += len(part)

    def flush(self) -> None:
        """Ends a block."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = next(k for k in reversed(self.stack) if self.page.elements[k].tag not in INLINE)
                self.page.blocks.append(Block(text, at, self.page.elements[at].tag, self.linked, len(self.page.blocks)))
            self.parts, self.linked = [], 0

    def close(self, count: int) -> None:
        """Pops that many elements."""
        for _ in range(count):
            e = self.page.elements[self.stack.pop()]
            self.open[e.tag] -= 1
            self.links -= e.tag == "a"
            self.unread -= e.tag in UNREAD or e.mark == -9

    def start(self, tag: str, attributes: str) -> bool:
        """Whether an element is opened."""
        if self.open.get("head") and tag not in IN_HEAD:
            self.end("head")
        if tag not in INLINE:
            self.flush()
            if tag in ENDS:
                ended, within = ENDS[tag]
                k = len(self.stack) - 1
                last = None
                while k > 0 and self.page.elements[self.stack[k]].tag not in within and any(self.open.get(t) for t in ended):
                    if self.page.elements[self.stack[k]].tag in ended:
                        last = k
                    elif self.page.elements[self.stack[k]].tag not in INLINE and self.page.elements[self.stack[k]].tag != "p":
                        break
                    k -= 1
                if last is not None:
                    self.close(len(self.stack) - last)
            elif self.open.get("p"):
                self.end("p", {"button", "td", "th", "table", "article", "section", "div", "li"})
        elif tag == "br":
            self.text(" ")
        elif tag == "a" and self.open.get("a"):
            self.end("a", {"td", "th", "table", "div", "li", "p"})
        if tag in VOID or tag in UNREAD and attributes.endswith("/"):
            return False
        parent = self.page.elements[self.stack[-1]]
        mark, hidden = mark_of(tag, attributes)
        e = Element(tag, self.stack[-1], parent.depth + 1, -9 if hidden and tag not in UNREAD else mark)
        if mark in (1, 2):  # told to all around it, each of which learns it once
            k = self.stack[-1]
            while k >= 0 and not self.page.elements[k].holds_article:
                self.page.elements[k].holds_article = True
                k = self.page.elements[k].parent
        self.stack.append(len(self.page.elements))
        self.page.elements.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.unread += tag in UNREAD or e.mark == -9
        return True

    def end(self, tag: str, within: set[str] | frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of that name, if none of the elements within which names end is met before."""
        if not self.open.get(tag):
            return
        k = len(self.stack) - 1
        while self.page.elements[self.stack[k]].tag != tag:
            if self.page.elements[self.stack[k]].tag in within:
                return
            k -= 1
        if tag not in INLINE or any(self.page.elements[j].tag not in INLINE for j in self.stack[k:]):
            self.flush()
        self.close(len(self.stack) - k)

    def tag_end(self, at: int) -> int:
        """The > that ends the tag whose inner part starts there: one in quotes does not, if the quotes are closed."""
        end = self.find(">", at)
        inner = self.html[at:end]
        if end < 0 or not (inner.count('"') % 2 or inner.count("'") % 2):
            return end
        while m := _QUOTE_OR_END.search(self.html, at):
            if m[1] is None:
                return m.start()
            closing = self.find(m[1], m.end())
            if closing < 0:
                return self.find(">", m.end())
            at = closing + 1
        return -1

    def read(self) -> Page:
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            k = self.find("<", at)
            if k < 0:
                self.text(html[at:])
                break
            self.text(html[at:k])
            follows = html[k + 1 : k + 2]
            if follows == "!" or follows == "?":
                end = self.find("-->", k + 4) if html.startswith("<!--", k) else self.find(">", k)
                if end < 0:
                    break
                at = end + (3 if html.startswith("<!--", k) else 1)
                continue
            name = _NAME.match(html, k + 2 if follows == "/" else k + 1)
            if name is None:
                self.text("<")
                at = k + 1
                continue
            end = self.tag_end(name.end())
            if end < 0:  # a tag that never ends is none
                break
            tag, at = name[0].lower(), end + 1
            if follows == "/":
                if tag == "p" and not self.open.get("p"):
                    self.flush()
                elif tag == "br":
                    self.text(" ")
                self.end(tag)
                continue
            if self.start(tag, html[name.end() : end]) and tag in RAW:
                close = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                if close is None:  # it goes on to the end
                    break
                at = close.start()
        self.flush()
        for b in self.page.blocks:
            b.place /= len(self.page.blocks)
        return self.page


def evidence(page: Page) -> list[int]:
    """Of each element what its marks and those around say of its blocks: -2 surely boilerplate, -1 likely, 0 nothing, 1 likely
    content, 2 surely content."""
    out: list[int] = []
    somewhere = page.elements[0].holds_article
    wraps = set() if somewhere else _wrappers(page)
    for k, e in enumerate(page.elements):
        above = out[e.parent] if k else 0
        if above == -2 or e.mark in (-2, -9) or e.mark == -1 and not e.holds_article and k not in wraps:
            out.append(-2)
        elif e.mark == -3:
            out.append(above if above > 0 else 0 if e.holds_article else -2)
        elif e.mark == 1:
            out.append(2)
        elif e.mark == 2:
            out.append(1 if e.holds_article else 2)
        elif e.mark == 3 and not somewhere:
            out.append(max(above, 1))
        else:
            out.append(above if k else -1 if somewhere else 0)
    return out


def _wrappers(page: Page) -> set[int]:
    """Elements that hold the page's first heading and most of its text: the name of such a one says what else it holds."""
    size, titled = [0] * len(page.elements), [False] * len(page.elements)
    for b in page.blocks:
        size[b.element] += len(b.text)
        titled[b.element] |= b.tag == "h1"
    for k in range(len(page.elements) - 1, 0, -1):
        parent = page.elements[k].parent
        size[parent] += size[k]
        titled[parent] |= titled[k]
    return {k for k, n in enumerate(size) if titled[k] and n > 0.6 * size[0]}


#: Of each feature: its name and the number of its steps.
FEATURES = (("tag", 5), ("length", 6), ("linked", 4), ("ends", 2), ("commas", 3), ("place", 3))
WIDTH = sum(n for _, n in FEATURES)
_TAGS = {**dict.fromkeys(("p", "blockquote", "pre"), 0), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), **dict.fromkeys(("li", "dt", "dd"), 2), **dict.fromkeys(("td", "th"), 3)}
#: What the model says of a step before it has seen pages: text speaks for content, links against it.
PRIOR = np.array([1.0, 0.5, -0.5, -0.5, 0.0, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 0.5, 0.0, -1.0, -2.0, 0.5, -0.5, -0.3, 0.3, 0.6, 0.0, 0.0, 0.0])


def steps(b: Block) -> tuple[int, ...]:
    n, words = len(b.text), b.text.count(" ") + 1
    linked = b.linked / n
    commas = b.text.count(",") + b.text.count(".")
    return (
        _TAGS.get(b.tag, 4),
        sum(words > x for x in (2, 6, 15, 40, 100)),
        0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3,
        0 if b.text[-1] in ".!?:;\"')»”…。！？" else 1,
        min(2, commas * 10 // words),
        0 if b.place < 0.15 else 2 if b.place > 0.85 else 1,
    )


def _columns(table: np.ndarray) -> np.ndarray:
    """One column for each step of each feature."""
    out, at = np.zeros((len(table), WIDTH)), 0
    for k, (_, n) in enumerate(FEATURES):
        out[np.arange(len(table)), at + table[:, k]] = 1
        at += n
    return out


def fitted_weights(table: np.ndarray, content: np.ndarray, counts: np.ndarray, ridge: float = 400.0) -> np.ndarray:
    """Logistic regression by Newton's steps, from PRIOR and held to it by the ridge; both labels weigh the same."""
    if not len(table) or not content.any() or content.all():
        return PRIOR.copy()
    x, w = _columns(table), PRIOR.copy()
    total = counts.sum()
    weight = np.where(content, counts / counts[content].sum(), counts / counts[~content].sum()) * min(total, 1e4) / 2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (content - p)) - ridge * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(WIDTH)
        move = np.linalg.solve(curve, slope)
        w = w + move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w


def edges_of(page: Page) -> Iterator[tuple[int, int, float]]:
    """Pairs of blocks with what it costs to part them."""
    elements, blocks = page.elements, page.blocks
    latest: dict[tuple[int, int], int] = {}
    for k, b in enumerate(blocks):
        parent = elements[b.element].parent
        grand = elements[parent].parent if parent >= 0 else -1
        if k:
            yield k - 1, k, FOLLOWS / (1 + _distance(elements, blocks[k - 1].element, b.element))
        for level, (key, cost) in enumerate(((parent, SIBLING), (grand, COUSIN))):
            if key >= 0:
                if (key, level) in latest:
                    yield latest[key, level], k, cost
                latest[key, level] = k


def _distance(elements: list[Element], a: int, b: int, most: int = 8) -> int:
    """Steps between two elements in the tree, as far as most."""
    steps_ = 0
    while a != b and steps_ < most:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps_ += 1
    return steps_


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a cheapest cut. lean: capacity from the source (positive) or to the
    sink (negative); an even node goes to the sink. Equal to a cut of the whole graph: a node that leans further than all its
    edges weigh is on that side in any."""
    n = len(lean)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, cost in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + cost
            near[b][a] = near[b].get(a, 0.0) + cost
    lean, side = list(lean), [None] * n
    left = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is None and abs(lean[k]) > left[k]:
            side[k] = lean[k] > 0
            for other, cost in near[k].items():
                if side[other] is None:
                    lean[other] += cost if side[k] else -cost
                    left[other] -= cost
                    queue.append(other)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        _flow(rest, lean, near, side)
    return [bool(s) for s in side]


def _flow(nodes: list[int], lean: list[float], near: list[dict[int, float]], side: list) -> None:
    """Shortest augmenting paths by levels (Dinic) between source and sink over what is not settled."""
    number = {k: i for i, k in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in nodes:
        i = number[k]
        if lean[k] > 0:
            edge(source, i, lean[k], 0.0)
        elif lean[k] < 0:
            edge(i, sink, -lean[k], 0.0)
        for other, cost in near[k].items():
            if other > k and other in number:
                edge(i, number[other], cost, cost)
    tiny = 1e-12
    while True:
        level = [-1] * len(at)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in at[x]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        next_edge = [0] * len(at)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                x = to[path[cut] ^ 1]
                del path[cut:]
            elif next_edge[x] < len(at[x]):
                e = at[x][next_edge[x]]
                if room[e] > tiny and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    next_edge[x] += 1
            elif path:
                level[x] = -1
                x = to[path.pop() ^ 1]
            else:
                break
    for k in nodes:
        side[k] = level[number[k]] >= 0


def labels(page: Page, weights: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not page.blocks:
        return []
    told = evidence(page)
    capacity = {-2: -SURE, -1: -LIKELY, 0: 0.0, 1: LIKELY / 2, 2: LIKELY}
    model = np.clip(_columns(np.array([steps(b) for b in page.blocks])) @ weights, -MODEL, MODEL).tolist()
    lean = [capacity[told[b.element]] + m for b, m in zip(page.blocks, model, strict=True)]
    return minimum_cut(lean, list(edges_of(page)))


def main_text(html: str | None, weights: np.ndarray) -> str:
    page = Reader(html or "").read()
    return " ".join(b.text for b, content in zip(page.blocks, labels(page, weights), strict=True) if content)


def block_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(steps, content, n): how many blocks, which marks tell to be content or not, have those steps."""
    names = [f for f, _ in FEATURES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for value in batch.column(0):
                page = Reader(value.as_py() or "").read()
                told = evidence(page)
                for b in page.blocks:
                    if abs(told[b.element]) == 2:
                        key = (*steps(b), told[b.element] > 0)
                        found[key] = found.get(key, 0) + 1
            rows = list(found)
            cols = [pa.array([r[k] for r in rows], pa.int32()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[-1] for r in rows], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=[*names, "content", "n"])

    counted = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(read, ", ".join(f"{n} int" for n in names) + ", content boolean, n long")
    return counted.groupBy(*names, "content").agg(F.sum("n").alias("n"))


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fitted: int = FITTED) -> np.ndarray:
    """The model's weights, of the pages with the least hashes: the counts have 6480 rows at most."""
    n = pages.count()
    if n > fitted:
        pages = pages.where(F.pmod(F.xxhash64(id_col, url_col), F.lit(1 << 20)) < int((1 << 20) * fitted / n))
    rows = block_counts(pages, html_col).collect()
    table = np.array([r[: len(FEATURES)] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    order = np.lexsort(table.T) if len(rows) else []
    return fitted_weights(table[order], np.array([r.content for r in rows], bool)[order], np.array([r.n for r in rows], float)[order])


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(value.as_py(), weights) for value in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return base.mapInArrow(read, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
