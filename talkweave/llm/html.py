"""Main text of web pages: boosted trees over DOM nodes and a consistent choice down the tree.

Each element gets features of its tag, attribute tokens, depth, subtree density and siblings.  Gradient-boosted trees give
the log odds that its text belongs to the main text.  They are trained here on at most ``MAX_PAGES`` pages, whose
elements are labelled by meaning-bearing markup (inside ``article`` or ``main``, outside navigation, notices, forms,
comments and the like).  Each page trains twice, as it is and with that markup hidden, so that the trees also learn to
tell main text by its structure alone.  Decoding picks for each element *content*, *boilerplate* or *mixed* so that the summed evidence is
largest; below content all is content, below boilerplate all is boilerplate, and only a mixed element may differ
from its children, at a price.  So no ancestor and descendant contradict each other.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.rows import col, cut, text_batches

MAX_PAGES = 400
MAX_NODES = 80_000
PAGES_AT_ONCE = 32

# A quote opens a value only after "="; one that never closes is part of a name, so the tag ends at the next ">".
# Nothing is read twice: each piece keeps what it took, and a tag or comment that never ends takes the rest of the page.
_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+"""
_PLAIN_VALUE = re.sub(r"\((?!\?)", "(?:", _VALUE)
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_PLAIN_VALUE})?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(f"({_NAME})(?:{_VALUE})?+")
_TOKEN = re.compile(r"[a-z0-9]+")

# How the HTML standard treats these elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video title head select datalist textarea option button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody tfoot", "table"),
    "tfoot": ("tbody thead tr td th", "table"), "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
KEEPS_P = frozenset("td th li div article section table button".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd td th tr tbody thead tfoot caption".split())

# Words of markup that tell main text from the rest.
GOOD = frozenset("article main post entry story content body text".split())
BAD = frozenset(
    "nav navigation navbar menu breadcrumb breadcrumbs header footer masthead banner sidebar aside widget ad ads advert adverts advertisement"
    " sponsor sponsored promo promotion cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup login search form"
    " share sharing social related recommended comment comments respond reply disqus copyright legal pagination pager tags toolbar skip".split()
)
BAD_TAGS = frozenset("nav header footer aside form dialog menu search".split())
NAMED_TAGS = BAD_TAGS | frozenset("article main section".split())
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "li", "ul", "table", "td", "a", "span", "h1", "h2", "h3", "blockquote", "pre", "figure")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "parts", "depth", "text", "link", "total", "links", "tags", "stops", "index", "peers", "choice")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.link = self.total = self.links = self.stops = 0
        self.tags, self.index, self.peers, self.choice = 1, 0, (0, 0), False
        if parent:
            parent.children.append(self)
            parent.parts.append(self)


def _tokens(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
            found.update(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()))
    return frozenset(found)


class _Open:
    """The open elements from the root down, and where each tag stands among them."""

    def __init__(self, root: Node):
        self.path, self.places = [root], {}

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 (the root) if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_below(self, tags, place: int) -> int:
        """Place of the outermost open element of these tags inside ``place``, 0 if there is none."""
        found = [self.places[t][i] for t in tags if t in self.places and (i := bisect_right(self.places[t], place)) < len(self.places[t])]
        return min(found, default=0)

    def close(self, place: int) -> None:
        while len(self.path) > max(1, place):
            self.places[self.path.pop().tag].pop()

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)


def parse(page: str) -> list[Node]:
    """The elements of a page in document order, with end tags implied and stray ones ignored.

    Time is linear in the page but for a logarithm, however elements nest or stay open.
    """
    root = Node("html", frozenset(), None)
    nodes, opened, at, body = [root], _Open(root), 0, False
    while True:
        found = _MARKUP.search(page, at)
        if found is None:
            opened.path[-1].parts.append(page[at:])
            return nodes
        if found.start() > at:
            opened.path[-1].parts.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            place = opened.last((tag,))
            if place and (tag in BLOCK or place > opened.last(("table", "td"))):
                opened.close(place)
            continue
        if tag in ("html", "body"):
            if tag == "html" or body:
                continue
            body = True
            opened.close(0)
        if tag in CLOSES_P or tag in CLOSES:
            place = opened.last(("p",))
            if place > opened.last(KEEPS_P):
                opened.close(place)
        if tag in CLOSES:
            closed, scope = CLOSES[tag]
            place = opened.first_below(closed, opened.last(scope))
            if place:
                opened.close(place)
        if opened.path[-1].tag == "head" and tag not in SILENT and tag not in VOID:
            opened.close(len(opened.path) - 1)
        node = Node(tag, _tokens(found[3]) if "=" in found[3] else frozenset(), opened.path[-1])
        nodes.append(node)
        if tag in VOID or found[3].endswith("/") and tag in ("path", "rect", "circle"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        opened.push(node)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def measure(nodes: list[Node]) -> None:
    for node in nodes:
        text = "" if node.tag in SILENT else " ".join(p for p in node.parts if isinstance(p, str)).strip()
        node.text = node.total = len(text)
        node.stops = sum(map(text.count, ".,;!?")) if text else 0
        node.links = node.text if node.tag == "a" else 0
    for node in reversed(nodes):
        if node.parent and node.tag not in SILENT:
            up = node.parent
            up.total += node.total
            up.links += node.total if node.tag == "a" else node.links
            up.stops += node.stops
            up.tags += node.tags


def features(nodes: list[Node]) -> np.ndarray:
    """One row per element: tag, tokens, depth, subtree density, siblings, ancestors."""
    measure(nodes)
    table = np.zeros((len(nodes), len(TAGS) + 18), np.float32)
    base = len(TAGS)
    whole = max(1, nodes[0].total)
    above: dict[int, tuple[int, int]] = {}
    for row, node in enumerate(nodes):
        good_up, bad_up = above.get(id(node.parent), (0, 0)) if node.parent else (0, 0)
        good = int(node.tag in ("article", "main") or bool(node.tokens & GOOD))
        bad = int(node.tag in BAD_TAGS or bool(node.tokens & BAD))
        above[id(node)] = (good_up + good, bad_up + bad)
        peers = node.parent.children if node.parent else [node]
        if node.parent:
            if node is peers[0]:
                for i, peer in enumerate(peers):
                    peer.index = i
                node.parent.peers = (sum(p.total for p in peers), sum(p.links for p in peers))
            place, (text, links) = node.index, node.parent.peers
        else:
            place, text, links = 0, node.total, node.links
        if node.tag in TAGS:
            table[row, TAGS.index(node.tag)] = 1
        table[row, base:] = (
            good, bad, good_up, bad_up, node.depth, math.log1p(node.total), math.log1p(node.text), node.links / max(1, node.total),
            math.log1p(node.total / node.tags), math.log1p(node.tags), 100 * node.stops / max(1, node.total), len(node.children),
            len(peers), place / len(peers), node.total / max(1, text), links / max(1, text), node.total / whole, len(node.tokens),
        )
    return table


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 inside main text as its markup says, else 0."""
    state: dict[int, tuple[bool, bool]] = {}
    out = np.zeros(len(nodes))
    for row, node in enumerate(nodes):
        inside, outside = state.get(id(node.parent), (False, False)) if node.parent else (False, False)
        inside |= node.tag in ("article", "main") or "main" in node.tokens
        outside |= node.tag in BAD_TAGS or bool(node.tokens & BAD) and node.tag not in ("article", "main", "body")
        state[id(node)] = (inside, outside)
        out[row] = inside and not outside
    return out


class Boosted:
    """Trees of depth ``depth`` for log odds, grown by gain on feature quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = math.log(share / (1 - share))
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        odds = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            tree, leaf = self._grow(x, cuts, grad, hess)
            self.trees.append(tree)
            odds += leaf
        return self

    def _grow(self, x, cuts, grad, hess):
        feature, bound = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
        place = np.zeros(len(x), int)
        for node in range(2**self.depth - 1):
            here = np.flatnonzero(place == node)
            best = (1e-6, 0, np.inf)
            g, h = grad[here], hess[here]
            for f, edges in enumerate(cuts):
                if not len(here) or not len(edges):
                    continue
                slot = np.searchsorted(edges, x[here, f])
                gl, hl = (np.cumsum(np.bincount(slot, v, len(edges) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], f, edges[i])
            feature[node], bound[node] = best[1], best[2]
            place[here] = 2 * node + 1 + (x[here, best[1]] > best[2])
        leaves = place - (2**self.depth - 1)
        value = self.rate * np.bincount(leaves, grad, 2**self.depth) / (np.bincount(leaves, hess, 2**self.depth) + 1)
        return (feature, bound, value), value[leaves]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, value in self.trees:
            place = np.zeros(len(x), int)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, feature[place]] > bound[place])
            out += value[place - (2**self.depth - 1)]
        return out


def decode(nodes: list[Node], odds: np.ndarray, price: float = 0.5) -> None:
    """Sets ``choice`` of each element: whether its own text is content."""
    own = [math.sqrt(n.text) * float(o) / 3 for n, o in zip(nodes, odds, strict=True)]
    same, mixed = dict.fromkeys(map(id, nodes), 0.0), {}
    for node, s in zip(reversed(nodes), reversed(own), strict=True):
        same[id(node)] += s
        if node.parent:
            same[id(node.parent)] += same[id(node)]
        below = sum(max(abs(same[id(c)]), mixed[id(c)]) for c in node.children)
        mixed[id(node)] = abs(s) + below - price if node.children else -math.inf
    state: dict[int, str] = {}
    for node, s in zip(nodes, own, strict=True):
        up = state[id(node.parent)] if node.parent else "mixed"
        if up == "mixed":
            sure = same[id(node)]
            up = "mixed" if mixed[id(node)] > abs(sure) else "content" if sure > 0 else "boilerplate"
        state[id(node)] = up
        node.choice = s > 0 if up == "mixed" else up == "content"


def blocks(nodes: list[Node]) -> list[str]:
    """The chosen text, one string per block in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = _clean("".join(run))
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush()
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                if node.choice:
                    run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif part.tag not in SILENT:
                stack += [(node, i), (part, 0)]
                break
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return out


def extract(pages: list[str | None], odds_of: Callable[[np.ndarray], np.ndarray]) -> list[str]:
    """The main text of each page; the elements of all are scored at once."""
    trees = [parse(page or "") for page in pages]
    if not trees:
        return []
    odds = odds_of(np.concatenate([features(nodes) for nodes in trees]))
    out, at = [], 0
    for nodes in trees:
        decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(blocks(nodes)))
    return out


def unmarked(nodes: list[Node]) -> None:
    """Hide what markup says of a page: attribute tokens go, and elements named for their part of a page become ``div``."""
    for node in nodes:
        node.tokens = frozenset()
        if node.tag in NAMED_TAGS:
            node.tag = "div"


def _examples(batches):
    """Two rows per element: one as the page has it, one of the same page without the markup its label comes from."""
    for batch in batches:
        for place, page in zip(batch.column("place").to_pylist(), batch.column("page").to_pylist(), strict=True):
            nodes = parse(page or "")
            table, labels = features(nodes), weak_labels(nodes)
            told = np.array([n.text > 0 or n.tag in BLOCK for n in nodes])
            unmarked(nodes)
            flat = np.stack([np.hstack([x, labels[:, None]])[told] for x in (table, features(nodes))], axis=1).astype(np.float32)
            flat = flat.reshape(-1, flat.shape[2])
            offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * len(flat), pa.int64()), pa.array(range(len(flat)), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))],
                ["place", "row", "x"],
            )


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, max_nodes: int = MAX_NODES) -> Boosted:
    """Trees from at most ``max_pages`` pages and ``max_nodes`` examples, those of the smallest hashes of page ids.

    Ids are chosen before a page is read; of pages that share an id the smallest counts.
    """
    place = F.xxhash64(col(id_col)).alias("place")
    # At most max_pages numbers.
    chosen = F.broadcast(cut(pages.select(place).distinct().orderBy("place").limit(max_pages)))
    texts = text_batches(pages).select(place, col(html_col).alias("page")).join(chosen, "place").groupBy("place").agg(F.min("page").alias("page"))
    rows = texts.mapInArrow(_examples, "place bigint, row int, x array<float>").orderBy("place", "row").limit(max_nodes).select("x").collect()
    table = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, len(TAGS) + 19))
    return Boosted().fit(table[:, :-1], table[:, -1])


def main_text(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with a last column ``text``; an empty or null page has the empty text.

    A page without elements is one block of text.  Pages that repeat give equal rows.  A column of that name is replaced.
    """
    model = model or fit(pages, id_col, html_col)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        pages = column.to_pylist()
        found = (extract(pages[i : i + PAGES_AT_ONCE], model.log_odds) for i in range(0, len(pages), PAGES_AT_ONCE))
        return pa.array([t for part in found for t in part], pa.string())

    return text_batches(pages).withColumn("text", text(col(html_col)))
