"""HTML extraction by a minimum cut between main text and boilerplate.

A page is cut into blocks, the runs of text between block-level tags. A classifier gives each
block a cost for either label; these are the capacities of its edges to the two terminals.
Neighbouring blocks, and blocks next to each other under the same parent, are tied by smoothness
edges, stronger the closer they are in the element tree. A maximum flow then separates content
from boilerplate at the least total cost: a short paragraph in the middle of an article stays
with its neighbours, a lone sentence between two menus goes with them.

The classifier is a logistic regression over two kinds of features. *Structure*: what the enclosing
elements say (fixed table below), for or against; the evidence against a block wins over evidence
for it, whichever is further in. A class word against an element that holds the article or most of
the page is about something else and does not count, nor does a form around them; but a thread of
comments, a list of related pages or a sidebar stays one, whatever its size and the articles in it
(``FIRM_WORDS``). *Text*: length, punctuation, link share, element and place of the block. All
weights, those of the structure too, are learnt from a bounded sample of pages. The labels come
from how a page's text is spread and not from names: the element right above most of the text that
is not in links (``CLEAR_SHARE`` of it, else the page has no labels) gives the main text, what
stands before and after all of it the rest, and what else is among it has no label. The weights are drawn to
``DEFAULT_MODEL`` where the sample says little, as about a kind of evidence that it lacks.

Text rules: character references are decoded, white space inside a block (line breaks and
``<br>`` included) becomes one space, blocks are trimmed and joined by two newlines in page
order. Nothing else is dropped or capped.

Edge cases: null or empty html gives the empty text; broken markup is read leniently (a ``<`` that
opens no tag is text, unclosed elements end with their parent, an unclosed comment or script
takes the rest of the page); a page without blocks gives the empty text; pages are handled one
by one, so repeated rows get equal results, and whole, however long; an empty table gives an
empty result. Only id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import schema_with, ship, table

SAMPLE_PAGES = 300
PENALTY = 1e-2  # of squared distance from the default weights, beside a mean loss

# Elements of HTML by the way they are read.
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
SKIPPED = frozenset(("script style textarea title noscript template svg math iframe object canvas "
                     "audio video select datalist button head noframes noembed xmp").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody tfoot thead tr ul caption option").split())
# An opening tag ends an open element of these kinds; the search for it stops at the fences.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CLOSES_P = BLOCK - {"body", "html", "caption", "option", "tr", "tbody", "thead", "tfoot"}
FENCES = frozenset("table ul ol dl body article section div nav aside main footer header form "
                   "blockquote".split())

# What element names, roles and class or id words say about main text.
BAD_TAGS = frozenset("nav aside footer form menu dialog search fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset(("navigation banner contentinfo complementary search dialog alertdialog "
                       "alert menu menubar toolbar form").split())
BAD_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail widget widgets "
    "footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended recommendations "
    "pagination pager copyright legal disclaimer skip taboola outbrain").split())
# Not taken back by size or by articles inside: such elements hold cards and threads of articles.
FIRM_WORDS = frozenset((
    "sidebar sidebars rail comment comments commentlist disqus respond reply replies related "
    "recommended recommendations taboola outbrain").split())
SIDE_WORDS = frozenset("sidebar sidebars rail".split())
# Beside such a word, as in has-sidebar, they tell of the page and not of the element.
LAYOUT_WORDS = frozenset("has with without no layout template".split())
GOOD_WORDS = frozenset("article content post entry story main body maintext articlebody".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                   re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Node(NamedTuple):
    """An open element: its number, name, and what it and its ancestors say."""

    number: int
    name: str
    bad: tuple[int, ...]   # numbers of the elements around (itself included) that speak against
    good: bool
    skipped: bool
    link: bool
    depth: int


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("bad", "depth", "good", "link_chars", "name", "parent", "parts", "text")

    def __init__(self, node: Node, parent: int):
        self.name, self.bad, self.good = node.name, node.bad, node.good
        self.depth, self.parent = node.depth, parent
        self.parts: list[str] = []
        self.link_chars = 0
        self.text = ""


class Evidence(NamedTuple):
    """What an opening tag says; the words in ``firm`` are those its classes and id are firm by."""

    hidden: bool
    bad: bool         # by name or role
    bad_role: bool
    bad_class: bool   # by class or id
    firm: frozenset[str]
    good: bool


def evidence(name: str, attributes: str) -> Evidence:
    hidden = bad_role = bad_class = False
    firm: frozenset[str] = frozenset()
    bad, good = name in BAD_TAGS, name in GOOD_TAGS
    for m in _ATTR.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style":
            tight = value.replace(" ", "")
            hidden = hidden or "display:none" in tight or "visibility:hidden" in tight
        elif key == "role":
            bad_role = bad_role or value in BAD_ROLES
            good = good or value in ("main", "article")
        elif key in ("class", "id"):
            raw = (m.group(2) or "").strip("\"'")
            words = {w.lower() for w in _WORDS.findall(raw)} | set(re.split(r"[\s_\-]+", value))
            for token in raw.split():
                parts = {w.lower() for w in _WORDS.findall(token)}
                parts.update(re.split(r"[_\-]+", token.lower()))
                if parts.isdisjoint(LAYOUT_WORDS):
                    firm |= parts & FIRM_WORDS
            bad_class = bad_class or not words.isdisjoint(BAD_WORDS)
            good = good or not words.isdisjoint(GOOD_WORDS)
    return Evidence(hidden, bad or bad_role, bad_role, bad_class, firm, good)


def _tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" or "", name, attributes) for every tag; the last has no name."""
    at, n, text = 0, len(page), []
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            yield "".join(text), "", "", ""
            return
        text.append(page[at:lt])
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m.group(2):
            continue  # a comment or declaration
        name = m.group(2).lower()
        yield "".join(text), m.group(1), name, m.group(3)
        text = []
        if name in RAW and not m.group(1) and not m.group(3).endswith("/"):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else n


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    root = Node(0, "html", (), False, False, False, 0)
    stack, out, count = [root], [], 0
    weak: dict[int, tuple[int, int]] = {}  # forms and elements bad by class alone: blocks inside
    opened_at: dict[int, int] = {}
    firm: dict[int, frozenset[str]] = {}   # those of them that only a main element takes back
    holds_article: set[int] = set()
    holds_main: set[int] = set()
    current: Block | None = None

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(htmllib.unescape("".join(current.parts)).split())
            current.parts = []
            if current.text:
                out.append(current)
        current = None

    def close(to: int) -> None:
        nonlocal current
        for node in stack[to:]:
            if node.name in BLOCK:
                flush()
            if node.number in opened_at:
                weak[node.number] = (opened_at.pop(node.number), len(out))
        del stack[to:]

    for text, slash, name, attributes in _tags(page):
        top = stack[-1]
        if text and not top.skipped:
            if current is None:
                if not text.isspace():
                    holder = next((x for x in reversed(stack) if x.name in BLOCK), root)
                    above = next((x for x in reversed(stack[:-1]) if x.name in BLOCK), root)
                    current = Block(holder, above.number)
            if current is not None:
                current.parts.append(text)
                if top.link:
                    current.link_chars += len(text)
                if len(top.bad) > len(current.bad):
                    current.bad = top.bad  # an inline element that speaks against the block
        if not name:
            break
        if slash:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if place:
                close(place)
            elif name in BLOCK:
                flush()
            continue
        if name == "br" or name in ("td", "th"):
            if current is not None:
                current.parts.append(" ")
        ends = CLOSES.get(name, ()) + (("p",) if name in CLOSES_P else ())
        for wanted in dict.fromkeys(ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == wanted:
                    close(i)
                    break
                if stack[i].name in FENCES and stack[i].name not in ends:
                    break
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        top = stack[-1]
        hidden, bad, bad_role, bad_class, words, good = evidence(name, attributes) if attributes else (
            Evidence(False, name in BAD_TAGS, False, False, frozenset(), name in GOOD_TAGS))
        count += 1
        if name in GOOD_TAGS and not hidden and not top.skipped and not (words and top.bad):
            # It counts for itself and the elements around, up to one that stays bad with it.
            holds_article.add(count)
            for x in reversed(stack):
                own = x.bad and x.bad[-1] == x.number
                if own and x.number not in opened_at:
                    break
                if name == "main":
                    holds_main.add(x.number)
                holds_article.add(x.number)
                if own and x.number in firm and name != "main":
                    break
        if name == "header" and not top.good:
            bad = True
        if name in ("html", "body") or name in GOOD_TAGS and not hidden and (
                not top.bad or not words and all(k in opened_at and k not in firm for k in top.bad)):
            bad_class = bad = False
        if (bad or bad_class) and (not bad or name == "form" and not bad_role):
            opened_at[count] = len(out)
            if words:
                firm[count] = words
        stack.append(Node(
            count, name, top.bad + (count,) if bad or bad_class else top.bad, top.good or good,
            top.skipped or hidden or name in SKIPPED, top.link or name == "a", top.depth + 1))
        if attributes.endswith("/") and name not in BLOCK and name not in RAW:
            stack.pop()
    close(1)
    flush()
    # A form or a class word says nothing about an element that holds the article or most of the page.
    sizes = np.concatenate([[0], np.cumsum([len(b.text) for b in out])]) if out else np.zeros(1)
    void = {k for k, (a, b) in weak.items() if k in holds_main or k not in firm and (
        k in holds_article or sizes[b] - sizes[a] > 0.6 * sizes[-1])}
    if all(not void.issuperset(b.bad) for b in out):
        # Nothing else on the page: the sidebar is the name of a layout around the article.
        void |= {k for k in firm if k in holds_article and firm[k] <= SIDE_WORDS}
    if void:
        for b in out:
            b.bad = tuple(k for k in b.bad if k not in void)
    return out


N_TEXT = 9
N_FEATURES = N_TEXT + 2
CLEAR_SHARE = 0.6


def features(blocks: list[Block]) -> np.ndarray:
    """What the text of each block says, then what the structure says against and for it."""
    total = max(1, len(blocks))
    out = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        out[i] = (
            1.0, min(1.0, np.log1p(n) / 7), min(1.0, np.log1p(words) / 5),
            min(1.0, b.link_chars / n), min(1.0, (t.count(".") + t.count(",")) / words * 4),
            1.0 if t[-1] in ".!?…" else 0.0, 1.0 if b.name in ("p", "blockquote", "pre") else 0.0,
            1.0 if b.name == "li" else 0.0, abs(2 * (i + 0.5) / total - 1),
            1.0 if b.bad else 0.0, 1.0 if b.good and not b.bad else 0.0)
    return out


def labelled_blocks(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1 main text) of the blocks whose place on the page is clear."""
    blocks = blocks_of(page)
    plain = [max(0, len(b.text) - b.link_chars) for b in blocks]
    under: dict[int, int] = {}
    for b, n in zip(blocks, plain, strict=True):
        under[b.parent] = under.get(b.parent, 0) + n
    holder = max(under, key=lambda k: (under[k], -k), default=None)
    if holder is None or under[holder] < CLEAR_SHARE * sum(plain) or not under[holder]:
        return np.zeros((0, N_FEATURES)), np.zeros(0)
    main = np.array([b.parent == holder for b in blocks])
    inside = np.flatnonzero(main)
    place = np.arange(len(blocks))
    clear = main | (place < inside[0]) | (place > inside[-1])
    return features(blocks)[clear], main[clear].astype(float)


class BlockModel(NamedTuple):
    weights: np.ndarray

    def text_logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x[:, :N_TEXT] @ self.weights[:N_TEXT], -4.0, 4.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Positive speaks for main text; however clear a text, it says no more than 4."""
        return self.text_logit(x) + x[:, N_TEXT:] @ self.weights[N_TEXT:]


# Used where there is nothing to learn from. Long, punctuated text outside links.
DEFAULT_MODEL = BlockModel(np.array([-2.0, 1.0, 3.0, -5.0, 1.0, 1.0, 1.0, -1.0, -0.5, -8.0, 5.0]))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> BlockModel:
    """Logistic regression by Newton steps, drawn to the default weights; both labels have the
    same total weight."""
    if len(y) == 0 or y.min() == y.max():
        return DEFAULT_MODEL
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    start = DEFAULT_MODEL.weights

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + penalty / 2 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * (w - start)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, gradient)
        while (ahead := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2  # a whole step may go too far where the labels are well apart
        if now - ahead < 1e-12:
            break
        w, now = w - step, ahead
    return BlockModel(w)


class FlowNetwork:
    """Maximum flow by Dinic's level graphs, on capacities that are floats."""

    EPS = 1e-9

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(there)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.head)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.head[a]:
                b = self.to[e]
                if level[b] < 0 and self.cap[e] > self.EPS:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Pushes the maximum flow; true for the nodes still reachable from ``s``."""
        to, cap, head = self.to, self.cap, self.head
        while True:
            level = self.levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            nxt, path, a = [0] * len(head), [], s
            while True:
                if a == t:
                    flow = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if cap[e] <= self.EPS)
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges, k = head[a], nxt[a]
                while k < len(edges) and not (cap[edges[k]] > self.EPS
                                              and level[to[edges[k]]] == level[a] + 1):
                    k += 1
                nxt[a] = k
                if k < len(edges):
                    path.append(edges[k])
                    a = to[edges[k]]
                elif path:
                    a = to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break


ADJACENT, SAME_PARENT = 0.75, 0.75


def main_blocks(blocks: list[Block], model: BlockModel) -> list[bool]:
    """The labelling with the least cost of labels and of cut smoothness edges."""
    if not blocks:
        return []
    n = len(blocks)
    cost = model.logit(features(blocks))
    net = FlowNetwork(n + 2)
    s, t = n, n + 1
    for i, c in enumerate(cost.tolist()):
        if c >= 0:
            net.edge(s, i, c)
        else:
            net.edge(i, t, -c)
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            far = abs(b.depth - blocks[i - 1].depth) + (b.parent != blocks[i - 1].parent)
            w = ADJACENT / (1 + far)
            net.edge(i - 1, i, w, w)
        if b.parent in last:
            net.edge(last[b.parent], i, SAME_PARENT, SAME_PARENT)
        last[b.parent] = i
    return net.source_side(s, t)[:n]


def extract(page: str, model: BlockModel) -> str:
    blocks = blocks_of(page)
    keep = main_blocks(blocks, model)
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BlockModel:
    """Fits the classifier on the ``sample_pages`` pages with the smallest hash of id and html."""
    sample = (pages.orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(sample_pages)
              .select("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [labelled_blocks(h.as_py()) for h in batch.column("html")]
            # The normal equations would do; the rows are few numbers and the sample is bounded.
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([x.ravel() for x, _ in made], pa.list_(pa.float64())),
                "y": pa.array([y for _, y in made], pa.list_(pa.float64()))})

    rows = sample.mapInArrow(run, "x array<double>, y array<double>").collect()
    rows.sort(key=lambda r: (r.x, r.y))
    x = np.array([v for r in rows for v in r.x]).reshape(-1, N_FEATURES)
    return fit(x, np.array([v for r in rows for v in r.y]))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", model: BlockModel | None = None) -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and its ``n_chars`` in code points."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    model = model or train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), model) for h in batch.column("html")]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, schema_with(rows, "text string", "n_chars bigint",
                                            keep=("page_id", "url")))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
