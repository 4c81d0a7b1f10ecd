"""Main body of a page by a tree-structured graphical model.

The text of a page keeps what its document tree left: one block element per line, and within navigation and
footer lines the entries. ``page_tree`` rebuilds the tree: a paragraph hangs below the heading over it, a list entry
below the line that the list follows, a short line (heading, menu, link) below the short line before it, as a next
sibling, and the entries of a line with separators below that line. Each kind of edge has its own parent-child
potentials, and each node potentials from hashed features of its text and place. A state is a kind of node:
text or headline of the main body, or one of several kinds of furniture. Sum-product messages go up the tree and
down again, and give every node its exact marginal of being content.

The model is trained on all pages that are mostly sentences, labelled by structure and repetition (``Labels``), not by
wording: lines that return on several sites, but for the site's name and numbers, short lines that return on several
urls of their site, menus of entries that return everywhere, pointers below a returning heading or behind a
returning lead, the line between headline and text. What returns is counted over all pages. Node and edge potentials are fitted together, by
gradient steps on the likelihood of the labelled trees (``fit``). Trees are built once, packed (``Packed``), and serve both the
training and the marginals. ``train`` does the same on given pages.

A line is furniture when its marginal of content is below one half. Blank lines have no node. NULL, empty and blank
contents give no rows. Lines are numbered from 0, blank ones included. Lines are read as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..sources import materialize
from . import screen
from .furniture import ends_sentence, has_digit, page_lines
from .sampling import lists

#: The first two are main content: text, and headlines.
STATES = ("text", "title", "return", "menu", "lead", "byline", "head", "point")
MAIN = 2
_AT = {s: i for i, s in enumerate(STATES)}
K = len(STATES)
#: Kinds of edges to the parent: none, short line, paragraph, list entry, entry of a line.
ROOT, NEXT, BLOCK, ITEM, ENTRY = range(5)
EDGES = 5
BITS = 17
#: ``train``: passes over the pages, and the rate of its steps on a few trees each.
EPOCHS = 6
RATE = 0.3
#: ``fit``: passes over all pages, and the rate of its steps; each pass takes the pages in so many parts, by the hash of their key, a step for each.
PASSES, PARTS, STEP = 1, 8, 0.5
#: Pages whose trees a worker takes together in a step; it bounds memory.
ROW_PAGES = 1000
#: Tasks of a step, at most: each sends at most 4 MB of gradient to the driver.
TASKS = 32
#: A line returns when so many urls of its site, or so many sites, have it.
RETURN_URLS, RETURN_SITES = 3, 3
#: Pages a site, at least, of a short line that doesn't name its site; articles that many sites print have hardly more than one.
RETURN_SHARE = 1.5
#: Sites that must have a sentence that doesn't name its site.
SENTENCE_SITES = 6
#: Share of the pages on which entries of menus, leads before a colon, and lines that return on several sites are at home.
COMMON_ENTRY, COMMON_LEAD, COMMON_LINE = 0.01, 0.003, 0.001
#: Nodes that one batch of trees may take, padded.
BATCH_NODES = 60_000

#: Lines whose features one worker keeps, and how long they may be; it bounds memory and changes no result.
MEMO_LINES, MEMO_CHARS = 20_000, 160

_ENTRY = re.compile(r"\s*[|»·/•›>]\s+|\s+[–-]\s+")
_NUM = re.compile(r"\d+")
_ITEM = re.compile(r"(?:[-•*–>]|\d{1,3}[.)])\s")


#: Places of a node: number of the line up to 3, the page's own title, entry of a line.
PLACES = {"0": 0, "1": 1, "2": 2, "3": 3, "o": 4, "e": 5}
#: Features below this number are those of shape.
SHAPES = 4096


def _bucket(token: str) -> int:
    return SHAPES + crc32(token.encode("utf-8", "surrogatepass")) % ((1 << BITS) - SHAPES)


class _Buckets(dict):
    """Bucket of each token; found once."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[token] = got = _bucket(token)
        return got


_BUCKET = _Buckets()


def is_short(s: str) -> bool:
    """No sentence: a heading, a menu, a link or the like."""
    return not ends_sentence(s)


def _separators(s: str) -> int:
    count = s.count
    return count("|") + count("»") + count("·") + count("/") + count("•")


def entries(s: str, separators: int | None = None) -> list[str]:
    """Nodes below a line: its entries where it is split by separators; ``separators``: the number of the usual ones, where known."""
    n = _separators(s) if separators is None else separators
    if n < 2:
        n += s.count("›") + s.count(">") + ("–" in s and s.count(" –")) + ("-" in s and s.count(" -"))
        if n < 2:
            return []
    parts = [p for p in _ENTRY.split(s) if p and not p.isspace()]
    return parts if len(parts) > 2 else []


_HOST = re.compile(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#:]+)")


def site_name(domain: str | None, url: str | None = None) -> str:
    """What a site calls itself: the longest label of its domain, or of its url's host where the domain is missing."""
    if not domain and url and (m := _HOST.match(url)):
        domain = m.group(1)
    return max((x for x in (domain or "").lower().split(".")[:-1] if x != "www"), key=len, default="")


def node_features(s: str, place: str, site: str = "", words: list[str] | None = None) -> list[int]:
    """Hashed features of one node: its wording, its first and last words, its shape and its place.

    The name of the site stands for itself wherever it is, so that notices read alike on all sites. ``words`` are
    those of the line in lower case, where known.
    """
    return _node(s, place, site, words, s.lower(), _separators(s))[0]


def _node(s: str, place: str, site: str, words: list[str] | None, low: str, separators: int) -> tuple[list[int], str]:
    """``node_features`` of a line, ``low`` in lower case, and ``low`` without its numbers and the name of its site."""
    n = len(s)
    given = low
    if site and site in low:
        low = low.replace(site, "\1")
        words = None
    words = low.split() if words is None else words
    if has_digit(low):
        low = _NUM.sub("0", low)
    m = len(words)
    last, starts = s[-1], s[0]
    end = 0 if last in ".!?…" else 1 if last in "”»“\"')" else 2 if last == ":" else 3
    size = min(n // 20, 8) if n < 200 else 9 + min(n // 200, 4)
    first = 0 if starts.isdigit() else 1 if starts.islower() else 2 if starts.isupper() else 3 + ord(starts) % 13
    seps = min(separators, 6)
    signs = (low is not given) * 8 + ("," in low) * 4 + ("©" in s) * 2 + (":" in s)
    # Numbered features of shape, each with its own range, and hashed ones of wording.
    shape = [(PLACES[place] * 14 + size) * 4 + end, 1024 + (first * 13 + min(m, 12)) * 4 + end, 2048 + seps, 2056 + signs * 4 + end]
    head = words[0]
    get = _BUCKET.__getitem__
    # Long lines hardly return: their buckets aren't kept.
    whole = get("\0=" + low) if n <= MEMO_CHARS else _bucket("\0=" + low)
    return [*shape, get("\0a" + head), get("\0b" + head + " " + words[1] if m > 1 else "\0b"), get("\0c" + words[-1]), whole, *map(get, set(words))], low


class Tree:
    """Nodes of one page in an order in which parents come first; ``line`` holds the nodes of its lines.

    ``found`` tells of each line its features, those of its entries, these, the line as ``_node`` gives it, whether it is
    short, whether it is a list entry, and whether it is the page's own title.
    """

    __slots__ = ("parent", "edge", "features", "line", "texts", "found")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.edge: list[int] = []
        self.features: list[list[int]] = []
        self.line: list[int] = []
        self.texts: list[str] = []
        self.found: list[tuple] = []


def page_tree(lines: list[str], title: str, site: str = "", memo: dict | None = None, split: list[list[str]] | None = None, lows: list[str] | None = None) -> Tree:
    """Tree of the squeezed lines of a page; ``line`` holds the node of each non-blank line.

    ``memo`` keeps what is found of lines that may return, ``lows`` are the lines in lower case and ``split`` their words.
    """
    tree = Tree()
    short = flow = -1
    own = " ".join((title or "").split())
    memo = {} if memo is None else memo
    for no, s in enumerate(lines):
        if not s:
            continue
        me = len(tree.parent)
        place = "o" if own and s == own else "0123"[min(me, 3)]
        key = (s, place, site) if len(s) <= MEMO_CHARS else None
        got = memo.get(key)
        if got is None:
            n = _separators(s)
            parts = entries(s, n)
            features, low = _node(s, place, site, split[no] if split else None, lows[no] if lows else s.lower(), n)
            got = features, [memo.get(e) or memo.setdefault(e, node_features(e, "e")) for e in parts], parts, low, is_short(s), _ITEM.match(s) is not None, place == "o"
            if key:
                if len(memo) >= MEMO_LINES:
                    memo.clear()
                memo[key] = got
        if got[5]:
            parent, edge = (flow, ITEM) if flow >= 0 else (short, NEXT)
        else:
            parent, edge = short, NEXT if got[4] else BLOCK
        tree.parent.append(parent)
        tree.edge.append(edge if parent >= 0 else ROOT)
        tree.features.append(got[0])
        tree.line.append(me)
        tree.texts.append(s)
        tree.found.append(got)
        if got[1]:
            tree.parent += [me] * len(got[1])
            tree.edge += [ENTRY] * len(got[1])
            tree.features += got[1]
        if edge == NEXT:
            short = me
        if edge != ITEM:
            flow = me
    return tree


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest log potential of each row, and all potentials as shares of it."""
    top = x.max(1, keepdims=True)
    return top, np.exp(x - top)


class TreeModel:
    """Node weights, one row for each hashed feature, and log potentials of (edge, parent state, child state)."""

    def __init__(self) -> None:
        self.node = np.zeros((1 << BITS, K), "float32")
        self.pair = np.zeros((EDGES, K, K))
        self.g_node = np.full(1 << BITS, 1.0)
        self.g_pair = np.ones((EDGES, K, K))

    def unary(self, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log potentials of all nodes of the trees in order, with the features and their owners."""
        rows = [f for t in trees for f in t.features]
        sizes = np.fromiter(map(len, rows), "int64", len(rows))
        flat = np.fromiter(chain.from_iterable(rows), "int64", int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(self.node[flat], starts, axis=0).astype("float64"), flat, np.repeat(np.arange(len(rows)), sizes)

    def beliefs(self, trees: list[Tree], pairs: bool = False) -> tuple:
        """Marginals (nodes, K) by sum-product, up and down; with ``pairs`` those of the edges too, as (nodes, K, K)."""
        u, flat, owner = self.unary(trees)
        count = np.array([len(t.parent) for t in trees])
        parent = np.fromiter(chain.from_iterable(t.parent for t in trees), "int64", len(u))
        edge = np.fromiter(chain.from_iterable(t.edge for t in trees), "int64", len(u))
        b, both = self._sum_product(u, count, parent, edge, pairs)
        return b, both, flat, owner

    def line_beliefs(self, trees: list[Tree]) -> np.ndarray:
        """As ``beliefs``, for the lines only: entries, which have nothing below them, tell their lines first, all at once."""
        u = self.unary(trees)[0]
        count = np.array([len(t.parent) for t in trees])
        parent = np.fromiter(chain.from_iterable(t.parent for t in trees), "int64", len(u))
        edge = np.fromiter(chain.from_iterable(t.edge for t in trees), "int64", len(u))
        start = np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
        leaf = edge == ENTRY
        np.add.at(u, (parent + start)[leaf], _lse(self.pair[ENTRY][None] + u[leaf][:, None, :], 2))
        # Places of the lines among the lines of their own tree.
        place = np.cumsum(~leaf) - 1
        own = place - place[start]
        lines = np.array([len(t.line) for t in trees])
        return self._sum_product(u[~leaf], lines, np.where(parent < 0, -1, own[np.maximum(parent, 0) + start])[~leaf], edge[~leaf], False)[0]

    def _sum_product(self, u_all: np.ndarray, count: np.ndarray, parents: np.ndarray, edges: np.ndarray, pairs: bool) -> tuple:
        """Messages up and down the trees of ``count`` nodes each, whose parents are numbered within their tree."""
        n, size = len(count), int(count.max())
        live = np.arange(size)[None, :] < count[:, None]
        u = np.zeros((n, size, K))
        parent, edge = np.full((n, size), -1), np.zeros((n, size), int)
        u[live], parent[live], edge[live] = u_all, parents, edges
        message = np.zeros((n, size, K))
        everyone = np.arange(n)
        # Sums over states are products of matrices; each begins from the largest state, which keeps it in range.
        factor = np.exp(self.pair)
        to_parent, to_child = (factor.transpose(axes).reshape(K, EDGES * K) for axes in ((2, 0, 1), (1, 0, 2)))
        own = np.zeros((n, size, K)) if pairs else None
        # Upward: u becomes the potential of a node with all that hangs below it.
        for t in range(size - 1, 0, -1):
            on = everyone[(t < count) & (parent[:, t] >= 0)]
            if len(on):
                top, x = _scaled(u[on, t])
                m = top + np.log((x @ to_parent).reshape(-1, EDGES, K)[np.arange(len(on)), edge[on, t]])
                message[on, t] = m
                if pairs:
                    own[on, t] = x
                u[on, parent[on, t]] += m
        # Downward: a parent tells each child what it knows without it.
        down = np.zeros((n, size, K))
        both = np.zeros((n, size, K, K)) if pairs else None
        for t in range(size):
            on = everyone[(t < count) & (parent[:, t] >= 0)]
            if len(on):
                p = parent[on, t]
                top, x = _scaled(down[on, p] + u[on, p] - message[on, t])
                down[on, t] = top + np.log((x @ to_child).reshape(-1, EDGES, K)[np.arange(len(on)), edge[on, t]])
                if pairs:
                    both[on, t] = x[:, :, None] * factor[edge[on, t]] * own[on, t][:, None, :]
            off = everyone[(t < count) & (parent[:, t] < 0)]
            down[off, t] = self.pair[ROOT, 0]
        b = down + u
        b = np.exp(b - _lse(b, 2)[:, :, None])
        if not pairs:
            return b[live], None
        both /= np.maximum(both.sum((2, 3), keepdims=True), 1e-300)
        return b[live], both[live]

    def step(self, trees: list[Tree], states: list[list[int]]) -> None:
        """One gradient step on the log likelihood of the states of whole trees, for nodes and edges together."""
        b, both, flat, owner = self.beliefs(trees, pairs=True)
        y = np.concatenate([np.array(s) for s in states])
        edge = np.concatenate([np.array(t.edge) for t in trees])
        shift = np.repeat(np.concatenate(([0], np.cumsum([len(t.parent) for t in trees])[:-1])), [len(t.parent) for t in trees])
        parent = np.concatenate([np.array(t.parent) for t in trees]) + shift
        g = b.copy()
        g[np.arange(len(y)), y] -= 1
        rows = g[owner]
        np.add.at(self.g_node, flat, (rows * rows).sum(1))
        np.subtract.at(self.node, flat, (RATE * rows / np.sqrt(self.g_node[flat])[:, None]).astype("float32"))
        gp = np.zeros((EDGES, K, K))
        inner = edge != ROOT
        np.add.at(gp, edge[inner], both[inner])
        np.subtract.at(gp, (edge[inner], y[parent[inner]], y[inner]), 1)
        gp[ROOT, 0] = g[~inner].sum(0)
        self.g_pair += gp * gp / len(trees)
        self.pair -= RATE * gp / np.sqrt(len(trees)) / np.sqrt(self.g_pair)

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """Marginal of content of each line of each tree."""
        out: list[np.ndarray] = [np.zeros(0)] * len(trees)
        for part in batches(trees):
            b = self.line_beliefs([trees[i] for i in part])[:, :MAIN].sum(1)
            at = 0
            for i in part:
                out[i] = b[at : at + len(trees[i].line)]
                at += len(trees[i].line)
        return out


def batches(trees: list[Tree]) -> list[list[int]]:
    """Numbers of the trees that have nodes, in groups of like size and bounded memory."""
    out: list[list[int]] = []
    for i in sorted((i for i, t in enumerate(trees) if t.parent), key=lambda i: len(trees[i].parent)):
        if not out or (len(out[-1]) + 1) * len(trees[i].parent) > BATCH_NODES or len(out[-1]) >= 512:
            out.append([])
        out[-1].append(i)
    return out


def masked(s: str, site: str) -> str:
    """The line in lower case without its numbers and the name of its site."""
    low = s.lower()
    if has_digit(low):
        low = _NUM.sub("0", low)
    return low.replace(_NUM.sub("0", site) if has_digit(site) else site, "\1") if site else low


class Labels:
    """Kinds of lines by structure and repetition, from pages (domain, title, lines) and counts of returns.

    ``fit`` finds the same over a table.
    """

    def __init__(self, pages: list[tuple[str, str, list[str]]], urls: dict[tuple[str, str], int]) -> None:
        self.urls = urls
        self.n = len(pages)
        sites: dict[str, set[str]] = defaultdict(set)
        leads: dict[str, set[str]] = defaultdict(set)
        self.lead: Counter[str] = Counter()
        self.entry: Counter[str] = Counter()
        every = []
        on: Counter[str] = Counter()
        for domain, _, lines in pages:
            full = [x for x in lines if x]
            every.append((full, [self.masked(x, domain) for x in full]))
            for x in set(every[-1][1]):
                on[x] += 1
                sites[x].add(domain)
            for x in {x.split(":")[0] for x in full if ":" in x and is_short(x)}:
                self.lead[x] += 1
                leads[x].add(domain)
            self.entry.update({e.lower() for x in full for e in entries(x)})
        # A line that doesn't name its site must return within the sites too: many sites may print the same article.
        self.wide = {x for x, d in sites.items() if len(d) >= RETURN_SITES and on[x] >= COMMON_LINE * self.n and ("\1" in x or on[x] >= RETURN_SHARE * len(d) if is_short(x) or "\1" in x else len(d) >= SENTENCE_SITES and on[x] >= RETURN_URLS * len(d))}
        # The heading of a list of links: two short lines follow, most times, that do not return themselves.
        before: Counter[str] = Counter()
        seen: Counter[str] = Counter()
        for full, masked in every:
            for i, x in enumerate(masked):
                if x in self.wide:
                    seen[x] += 1
                    before[x] += len(full) > i + 2 and all(is_short(full[j]) and masked[j] not in self.wide and not entries(full[j]) for j in (i + 1, i + 2))
        self.heads = {x for x in self.wide if before[x] * 10 >= 6 * seen[x]}
        self.common_lead = {x for x, c in self.lead.items() if c >= max(3, COMMON_LEAD * self.n) and len(leads[x]) >= RETURN_SITES}
        self.common_entry = {x for x, c in self.entry.items() if c >= max(3, COMMON_ENTRY * self.n)}

    @staticmethod
    def masked(s: str, domain: str) -> str:
        return masked(s, site_name(domain))

    def states(self, domain: str, title: str, lines: list[str]) -> list[int]:
        """State of each non-blank line."""
        out: list[int] = []
        own = " ".join((title or "").split())
        pointers, last = False, ""
        for s in lines:
            if not s:
                continue
            masked = self.masked(s, domain)
            parts = entries(s)
            state = "text"
            if own and s == own:
                state = "title"
            elif masked in self.wide or is_short(s) and self.urls.get((domain, s), 0) >= RETURN_URLS:
                state = "head" if masked in self.heads and is_short(s) and not parts else "return"
            elif parts and 3 * sum(e.lower() in self.common_entry for e in parts) >= 2 * len(parts):
                state = "menu"
            elif is_short(s) and s.split(":")[0] in self.common_lead and ":" in s:
                state = "lead"
            elif is_short(s) and last == "title":
                state = "byline"
            elif is_short(s) and pointers:
                state = "point"
            elif is_short(s) and not _ITEM.match(s):
                state = "title"
            pointers = state in ("head", "point")
            out.append(_AT[state])
            last = state
        return out


def sound(lines: list[str]) -> bool:
    """Is most of the page sentences? Others teach nothing about main bodies."""
    chars = sum(map(len, lines))
    return 2 * sum(len(s) for s in lines if len(s) > 80 and not is_short(s)) >= chars > 0


def train(pages: list[tuple[str, str, list[str]]], urls: dict[tuple[str, str], int], seed: int = 3) -> TreeModel:
    """Model from (domain, title, squeezed lines) of pages; ``urls``: on how many urls of its site a line stands."""
    model = TreeModel()
    pages = [p for p in pages if sound(p[2])]
    labels = Labels(pages, urls)
    trees, states = [], []
    for domain, title, lines in pages:
        tree = page_tree(lines, title, site_name(domain))
        given = iter(labels.states(domain, title, lines))
        own = [next(given) if e != ENTRY else -1 for e in tree.edge]
        trees.append(tree)
        # An entry has the state of its line.
        states.append([own[p] if s < 0 else s for s, p in zip(own, tree.parent)])
    rng = np.random.default_rng(seed)
    groups = [g[a : a + 64] for g in batches(trees) for a in range(0, len(g), 64)]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(groups)):
            model.step([trees[i] for i in groups[k]], [states[i] for i in groups[k]])
    return model


LINES = "array<struct<line_no: int, content: float>>"


def batch_marginals(model: TreeModel) -> Callable[[], Callable[..., pa.Array]]:
    """For ``screen.page_facts``: the furniture lines of each page with their marginals of content."""

    def make() -> Callable[..., list]:
        memo: dict = {}

        def run(page: dict[str, list], pages_lines: list[list[str]], pages_split: list[list[list[str]]], pages_lows: list[list[str]]) -> pa.Array:
            sites = map(site_name, page["domain"], page.get("url", page["domain"]))
            trees = [page_tree(lines, title or "", site, memo, split, lows) for lines, split, lows, title, site in zip(pages_lines, pages_split, pages_lows, page["title"], sites)]
            counts, numbers, contents = [], [], []
            for lines, m in zip(pages_lines, model.marginals(trees)):
                at = np.flatnonzero(m < 0.5)
                own = [no for no, s in enumerate(lines) if s]
                counts.append(len(at))
                numbers += [own[i] for i in at]
                contents.append(m[at])
            values = pa.StructArray.from_arrays([pa.array(numbers, "int32"), pa.array(np.concatenate(contents), "float32")], names=["line_no", "content"])
            return lists(counts, values)

        return run

    return make


def _hashed(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(line, "[ \t \r]+", " ")))


def site_urls(pages: DataFrame, rows: list[Row]) -> dict[tuple[str, str], int]:
    """On how many urls of its site each squeezed line of the sample ``rows`` (domain, content) stands, over all pages.

    Lines count as equal when they are so but for spaces at their ends.
    The lines asked for are bounded by the sample; they are broadcast, so that only their occurrences are shuffled.
    """
    import xxhash

    asked: dict[tuple[str, int], set[str]] = defaultdict(set)
    for r in rows:
        if r["domain"]:
            for s, raw in zip(page_lines(r["content"]), r["content"].split("\n")):
                if s:
                    h = xxhash.xxh64_intdigest(raw.strip(" ").encode("utf-8", "surrogatepass"), 42)
                    asked[r["domain"], h - (1 << 64) if h >> 63 else h].add(s)
    if not asked:
        return {}
    wanted = F.broadcast(pages.sparkSession.createDataFrame(list(asked), "domain string, h long"))
    spots = pages.where("domain <> '' and content <> ''").select("domain", F.xxhash64("url").alias("u"), F.explode(F.array_distinct(F.transform(F.split("content", "\n"), lambda x: F.xxhash64(F.trim(x))))).alias("h"))
    found = spots.join(wanted, ["domain", "h"], "left_semi").distinct().groupBy("domain", "h").agg(F.count("*").alias("n")).where(F.col("n") >= RETURN_URLS)
    return {(r["domain"], s): r["n"] for r in found.collect() for s in asked[r["domain"], r["h"]]}


#: Arrays of the packed trees of several pages. For each page: hashes of its domain (0: none), url and key, whether it is mostly sentences, how many
#: lines it has. For each line: its number, its parent among the page's lines, the kind of edge, its node. For each entry: its line among all, its node.
#: For each different node: its number of features, these, hashes of its text, of the text masked, and of its lead (0: none), and its FLAGS.
PACKED = {
    **{"site": "int64", "url": "int64", "page": "int64", "sound": "bool", "count": "int32"},
    **{"no": "int32", "parent": "int32", "edge": "int8", "node": "int32", "line": "int32", "part": "int32"},
    **{"size": "int32", "features": "int32", "text": "int64", "mark": "int64", "lead": "int64", "flags": "int8"},
}
TREES = "struct<pages: array<string>, " + ", ".join(f"{c}: binary" for c in PACKED) + ">"
#: Codes of these types in Python's arrays.
_CODES = {"int64": "q", "int32": "i", "int8": "b", "bool": "b"}
SHORT, NAMED, LISTED, OWN, PARTED = 1, 2, 4, 8, 16
#: What ``_marks`` counts: lines that name their site, other short lines, sentences, leads, entries, pages.
_NAMED, _SHORT, _SENTENCE, _LEAD, _MENU, _PAGE = range(6)


def _hash(s: str) -> int:
    return xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def batch_trees() -> Callable[[], Callable[..., pa.Array]]:
    """For ``screen.page_facts``: the packed trees of a batch, in the row of its first page."""
    kind = pa.struct([("pages", pa.list_(pa.string())), *((c, pa.binary()) for c in PACKED)])

    def make() -> Callable[..., pa.Array]:
        memo: dict = {}

        def run(page: dict[str, list], pages_lines: list[list[str]], pages_split: list[list[list[str]]], pages_lows: list[list[str]]) -> pa.Array:
            n = len(pages_lines)
            urls = page.get("url", [None] * n)
            sites = list(map(site_name, page["domain"], urls))
            trees = [page_tree(lines, title or "", site, memo, split, lows) for lines, split, lows, title, site in zip(pages_lines, pages_split, pages_lows, page["title"], sites)]
            out: dict = {c: array(_CODES[t]) for c, t in PACKED.items()}
            out["site"] = [_hash(d) if d else 0 for d in page["domain"]]
            out["url"] = [_hash(u or "") for u in urls]
            out["page"] = [_hash(k or "") for k in page["k"]]
            out["sound"] = list(map(sound, pages_lines))
            out["count"] = [len(t.line) for t in trees]
            # What the memo gives is the same object; all is held by the trees. Numbers of the nodes of entries, and of lines with those of their entries.
            known: dict[int, int] = {}
            known_lines: dict[int, tuple[int, list[int]]] = {}
            node, sizes, features, text, mark, lead, flags = (out[c] for c in ("node", "size", "features", "text", "mark", "lead", "flags"))

            def add(f: list[int], *values: int) -> int:
                sizes.append(len(f))
                features.extend(f)
                for c, v in zip((text, mark, lead, flags), values):
                    c.append(v)
                return len(sizes) - 1

            for tree, lines, site in zip(trees, pages_lines, sites):
                out["no"].extend([no for no, s in enumerate(lines) if s])
                # The tree has the masked lines, unless the site's name has digits: these are masked before the name.
                has_low = _NUM.search(site) is None
                if len(tree.line) == len(tree.parent):
                    out["parent"].extend(tree.parent)
                    out["edge"].extend(tree.edge)
                else:
                    at = {node: i for i, node in enumerate(tree.line)}
                    out["parent"].extend([at[tree.parent[i]] if tree.parent[i] >= 0 else -1 for i in tree.line])
                    out["edge"].extend([tree.edge[i] for i in tree.line])
                for i, (s, got) in enumerate(zip(tree.texts, tree.found), len(node)):
                    line = known_lines.get(id(got))
                    if line is None:
                        f, below, parts, low, short, listed, own = got
                        if not has_low:
                            low = masked(s, site)
                        flag = SHORT * short | NAMED * ("\1" in low) | LISTED * listed | OWN * own | PARTED * bool(parts)
                        # Only short lines are looked up as they stand.
                        me = add(f, _hash(s) if short else 0, _hash(low), _hash(s.split(":")[0]) if short and ":" in s else 0, flag)
                        for e, f in zip(parts, below):
                            if id(f) not in known:
                                known[id(f)] = add(f, 0, _hash(e.lower()), 0, 0)
                        line = known_lines[id(got)] = me, [known[id(f)] for f in below]
                    node.append(line[0])
                    if line[1]:
                        out["line"].extend([i] * len(line[1]))
                        out["part"].extend(line[1])
            packed = {c: np.asarray(out[c], t).tobytes() for c, t in PACKED.items()}
            return pa.array([{"pages": page["k"], **packed}] + [None] * (n - 1), kind)

        return run

    return make


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of several spans, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Packed:
    """The arrays PACKED of a row, with the page of each line."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])).astype("int64")
        self.of = np.repeat(np.arange(len(self.count)), self.count)

    @staticmethod
    def rows(batches: Iterator[pa.RecordBatch], columns: dict[str, str] = PACKED) -> Iterator[Packed]:
        for b in batches:
            for i in range(b.num_rows):
                yield Packed({c: np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in columns.items()})

    def flag(self, bit: int) -> np.ndarray:
        return (self.flags[self.node] & bit) > 0

    def some(self, pages: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """What ``_gradient`` needs of some pages, ``y`` being the states of all lines."""
        lines = _spans(self.first[pages], self.count[pages])
        place = np.full(len(self.node), -1)
        place[lines] = np.arange(len(lines))
        on = place[self.line] >= 0
        used, node = np.unique(np.concatenate((self.node[lines], self.part[on])), return_inverse=True)
        starts = np.cumsum(self.size) - self.size
        return {
            **{"count": self.count[pages], "parent": self.parent[lines], "edge": self.edge[lines], "node": node[: len(lines)], "y": y[lines]},
            **{"line": place[self.line[on]], "part": node[len(lines) :], "size": self.size[used], "features": self.features[_spans(starts[used], self.size[used])]},
        }

    def groups(self) -> Iterator[np.ndarray]:
        """Pages that have lines, in groups of like size and bounded memory."""
        order = np.argsort(self.count, kind="stable")
        order = order[self.count[order] > 0]
        at = 0
        while at < len(order):
            end = min(at + 512, len(order))
            while end > at + 1 and (end - at) * self.count[order[end - 1]] > BATCH_NODES:
                end = at + (end - at) // 2
            yield order[at:end]
            at = end

    def potentials(self, model: TreeModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log potentials of the different nodes, what they tell their lines as entries, and the potentials of all lines with those below."""
        starts = np.cumsum(self.size) - self.size
        u = np.add.reduceat(model.node[self.features], starts, axis=0).astype("float64") if len(starts) else np.zeros((0, K))
        top, x = _scaled(u)
        told = top + np.log(x @ np.exp(model.pair[ENTRY]).T)
        below = told[self.part]
        lines = u[self.node] + np.stack([np.bincount(self.line, below[:, k], len(self.node)) for k in range(K)], 1)
        return u, told, lines

    def beliefs(self, model: TreeModel, lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """As ``TreeModel.beliefs``, for the lines."""
        b, both = np.zeros((len(lines), K)), np.zeros((len(lines), K, K)) if pairs else None
        for pages in self.groups():
            on = _spans(self.first[pages], self.count[pages])
            got = model._sum_product(lines[on], self.count[pages], self.parent[on], self.edge[on], pairs)
            b[on] = got[0]
            if pairs:
                both[on] = got[1]
        return b, both


def _gradient(p: Packed, model: TreeModel) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of the states ``y`` of whole trees, by features and by pairs; see ``TreeModel.step``."""
    u, told, lines = p.potentials(model)
    b, both = p.beliefs(model, lines, pairs=True)
    # Entries have nothing below them: they learn from their line what it knows without them. An entry has the state of its line.
    factor = np.exp(model.pair[ENTRY])
    above, own = _scaled(np.log(np.maximum(b, 1e-300))[p.line] - told[p.part])[1], _scaled(u[p.part])[1]
    below = (above @ factor) * own
    whole = below.sum(1, keepdims=True)
    below /= whole
    pair = np.zeros((EDGES, K, K))
    inner = p.edge != ROOT
    parent = p.parent + np.repeat(p.first, p.count)
    for kind in range(ROOT + 1, EDGES):
        pair[kind] += both[p.edge == kind].sum(0)
    np.subtract.at(pair, (p.edge[inner], p.y[parent[inner]], p.y[inner]), 1)
    pair[ENTRY] += factor * ((above / whole).T @ own)
    np.subtract.at(pair[ENTRY], (p.y[p.line], p.y[p.line]), 1)
    b[np.arange(len(b)), p.y] -= 1
    pair[ROOT, 0] = b[~inner].sum(0)
    below[np.arange(len(below)), p.y[p.line]] -= 1
    nodes, each = np.concatenate((p.node, p.part)), np.concatenate((b, below))
    owner = np.repeat(np.arange(len(p.size)), p.size)
    sums = [np.bincount(p.features, np.bincount(nodes, each[:, k], len(p.size))[owner], 1 << BITS) for k in range(K)]
    return np.stack(sums, 1), pair


def _marks(p: Packed) -> tuple[np.ndarray, ...]:
    """(kind, h, site, n): on how many of the sound pages lines, leads and entries stand, each page counted once."""
    line, part = p.sound[p.of], p.sound[p.of[p.line]]
    lead = line & (p.lead[p.node] != 0)
    kind = np.concatenate((np.select([p.flag(NAMED), p.flag(SHORT)], [_NAMED, _SHORT], _SENTENCE)[line], np.full(lead.sum(), _LEAD), np.full(part.sum(), _MENU), np.full(p.sound.sum(), _PAGE)))
    h = np.concatenate((p.mark[p.node[line]], p.lead[p.node[lead]], p.mark[p.part[part]], np.zeros(p.sound.sum(), "int64")))
    page = np.concatenate((p.of[line], p.of[lead], p.of[p.line][part], np.flatnonzero(p.sound)))
    once = _starts(kind, h, page)
    kind, h, site = kind[once], h[once], p.site[page[once]]
    site[(kind == _MENU) | (kind == _PAGE)] = 0
    first = _starts(kind, h, site, kept := np.lexsort((site, h, kind)))
    return kind[kept][first], h[kept][first], site[kept][first], np.diff(np.append(first, len(kept)))


def _starts(a: np.ndarray, b: np.ndarray, c: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the first of equal triples; with their sorted ``order`` given, numbers within that."""
    by = np.lexsort((c, b, a)) if order is None else order
    a, b, c = a[by], b[by], c[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
    return by[first] if order is None else first


def _at_site(p: Packed) -> np.ndarray:
    """Hash of each line with its domain."""
    with np.errstate(over="ignore"):
        z = p.text[p.node].astype("uint64") ^ (p.site[p.of].astype("uint64") * np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(27))).astype("int64")


class Returns:
    """Sorted hashes of what returns: the sets of ``Labels``, from counts over all pages."""

    def __init__(self, trees: DataFrame) -> None:
        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in Packed.rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_marks(p), ("int32", "int64", "int64", "int64"))], names=["kind", "h", "site", "n"])

        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in Packed.rows(batches):
                on = p.flag(SHORT) & (p.site[p.of] != 0)
                yield pa.RecordBatch.from_arrays([pa.array(_at_site(p)[on]), pa.array(p.url[p.of[on]])], names=["h", "u"])

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in Packed.rows(batches):
                wide = self.has("wide", p.mark)[p.node]
                # The heading of a list of links: two short lines follow, most times, that do not return themselves.
                plain = np.concatenate((p.flag(SHORT) & ~wide & ~p.flag(PARTED), [False, False]))
                page = np.concatenate((p.of, [-1, -1]))
                before = plain[1:-1] & plain[2:] & (page[2:] == p.of)
                on = wide & p.sound[p.of]
                h, at = np.unique(p.mark[p.node[on]], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(at, minlength=len(h))), pa.array(np.bincount(at, before[on], len(h)).astype("int64"))], names=["h", "seen", "before"])

        counted = trees.mapInArrow(marks, "kind int, h bigint, site bigint, n bigint").groupBy("kind", "h", "site").agg(F.sum("n").alias("n"))
        counted = materialize(counted.groupBy("kind", "h").agg(F.count("*").alias("sites"), F.sum("n").alias("n")).where(f"n >= 3 or kind = {_PAGE}"))
        self.n = next((r[0] for r in counted.where(f"kind = {_PAGE}").select("n").collect()), 0)
        # See Labels: a line that doesn't name its site must return within the sites too.
        within = f"kind = {_SHORT} and n >= {RETURN_SHARE} * sites or kind = {_SENTENCE} and sites >= {SENTENCE_SITES} and n >= {RETURN_URLS} * sites"
        self.wide = self._sorted(counted.where(f"sites >= {RETURN_SITES} and n >= {COMMON_LINE * self.n!r}D and (kind = {_NAMED} or {within})"))
        self.lead = self._sorted(counted.where(f"kind = {_LEAD} and sites >= {RETURN_SITES} and n >= {max(3.0, COMMON_LEAD * self.n)!r}D"))
        self.entry = self._sorted(counted.where(f"kind = {_MENU} and n >= {max(3.0, COMMON_ENTRY * self.n)!r}D"))
        urls = trees.mapInArrow(spots, "h bigint, u bigint").distinct().groupBy("h").agg(F.count("*").alias("n"))
        self.urls = self._sorted(urls.where(f"n >= {RETURN_URLS}"))
        seen = trees.mapInArrow(heads, "h bigint, seen bigint, before bigint").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("before").alias("before"))
        self.heads = self._sorted(seen.where("before * 10 >= 6 * seen"))

    @staticmethod
    def _sorted(rows: DataFrame) -> np.ndarray:
        return np.sort(rows.select("h").toArrow()["h"].to_numpy())

    def has(self, name: str, h: np.ndarray) -> np.ndarray:
        known = getattr(self, name)
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def states(self, p: Packed) -> np.ndarray:
        """State of each line; see ``Labels.states``."""
        short, parted = p.flag(SHORT), p.flag(PARTED)
        common = np.bincount(p.line, self.has("entry", p.mark)[p.part], len(p.node))
        menu = parted & (3 * common >= 2 * np.bincount(p.line, minlength=len(p.node)))
        back = self.has("wide", p.mark)[p.node] | short & (p.site[p.of] != 0) & self.has("urls", _at_site(p))
        head = self.has("heads", p.mark)[p.node] & short & ~parted
        lead = short & (p.lead[p.node] != 0) & self.has("lead", p.lead)[p.node]
        by_itself = [p.flag(OWN), back & head, back, menu, lead, ~short]
        base = np.select(by_itself, [_AT[s] for s in ("title", "head", "return", "menu", "lead", "text")], -1).tolist()
        title, byline, point, text = (_AT[s] for s in ("title", "byline", "point", "text"))
        pointed = (_AT["head"], point)
        last = page = -1
        for i, (state, of, listed) in enumerate(zip(base, p.of.tolist(), p.flag(LISTED).tolist())):
            if of != page:
                page, last = of, -1
            if state < 0:
                base[i] = state = byline if last == title else point if last in pointed else text if listed else title
            last = state
        return np.array(base, "int8")


#: Arrays of the labelled trees that training reads.
LABELLED = {**{c: PACKED[c] for c in ("count", "parent", "edge", "size", "features")}, **dict.fromkeys(("node", "line", "part"), "int32"), "y": "int8"}


def _joined(rows: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One row of the trees of several."""
    lines, nodes = (np.cumsum([0] + [len(r[c]) for r in rows]) for c in ("node", "size"))
    shift = {"node": nodes, "part": nodes, "line": lines}
    return {c: np.concatenate([r[c] + shift[c][i] if c in shift else r[c] for i, r in enumerate(rows)]) for c in LABELLED}


def fit(trees: DataFrame) -> TreeModel:
    """Model of all pages of the packed ``trees``: each step adds up the gradients of a part of all pages, and each pass takes all parts."""
    found = Returns(trees)
    model = TreeModel()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict[str, np.ndarray]]] = [[] for _ in range(PARTS)]

        def row(i: int) -> pa.RecordBatch:
            r, held[i] = _joined(held[i]), []
            return pa.RecordBatch.from_arrays([pa.array([i], "int32"), *(pa.array([r[c].astype(t).tobytes()], "binary") for c, t in LABELLED.items())], names=["at", *LABELLED])

        for p in Packed.rows(batches):
            y = found.states(p)
            for i in range(PARTS):
                on = np.flatnonzero(p.sound & (p.count > 0) & (p.page % PARTS == i))
                if len(on):
                    held[i].append(p.some(on, y))
                if sum(len(r["count"]) for r in held[i]) >= ROW_PAGES:
                    yield row(i)
        yield from (row(i) for i in range(PARTS) if held[i])

    labelled = materialize(trees.mapInArrow(label, "at int, " + ", ".join(f"{c} binary" for c in LABELLED)))
    context = trees.sparkSession.sparkContext
    labelled = labelled.coalesce(min(context.defaultParallelism, TASKS))
    g_node, g_pair = np.ones((1 << BITS, 1)), np.ones((EDGES, K, K))
    for at in list(range(PARTS)) * PASSES:
        # The model of each step is dropped after it, so that no copies of them pile up.
        sent = context.broadcast(model)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, pair = np.zeros((1 << BITS, K)), np.zeros((EDGES, K, K))
            for p in Packed.rows(batches, LABELLED):
                got = _gradient(p, sent.value)
                node += got[0]
                pair += got[1]
            on = np.flatnonzero(node.any(1)).astype("int32")
            blobs = on.tobytes(), node[on].astype("float32").tobytes(), pair.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], "binary") for x in blobs], names=["f", "node", "pair"])

        node, pair = np.zeros((1 << BITS, K)), np.zeros((EDGES, K, K))
        for r in labelled.where(F.col("at") == at).mapInArrow(gradient, "f binary, node binary, pair binary").toArrow().to_batches():
            for f, n, e in zip(*r.columns):
                node[np.frombuffer(f.as_buffer(), "int32")] += np.frombuffer(n.as_buffer(), "float32").reshape(-1, K)
                pair += np.frombuffer(e.as_buffer(), "float64").reshape(pair.shape)
        sent.destroy()
        g_node += (node * node).sum(1, keepdims=True)
        g_pair += pair * pair
        model.node -= (STEP * node / np.sqrt(g_node)).astype("float32")
        model.pair -= STEP * pair / np.sqrt(g_pair)
    return model


def trees_of(facts: DataFrame) -> DataFrame:
    """The packed trees in materialized facts of pages, made with ``batch_trees``."""
    return facts.where("extra is not null").select("extra.*")


def learn(pages: DataFrame, key: str = "page_id") -> TreeModel:
    """Model of all pages (domain, url, title, content)."""
    return fit(trees_of(materialize(screen.page_facts(pages, key, extra=batch_trees(), extra_type=TREES))))


def marked_pages(trees: DataFrame, model: TreeModel, kind: str = "bigint") -> DataFrame:
    """(page_id, extra): the furniture lines of each page as ``batch_marginals`` gives them; ``kind``: type of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, p in zip(b.column("pages"), Packed.rows(iter([b]))):
                m = p.beliefs(model, p.potentials(model)[2])[0][:, :MAIN].sum(1)
                on = np.flatnonzero(m < 0.5)
                found = pa.StructArray.from_arrays([pa.array(p.no[on]), pa.array(m[on].astype("float32"))], names=["line_no", "content"])
                yield pa.RecordBatch.from_arrays([keys.values, lists(np.bincount(p.of[on], minlength=len(p.count)), found)], names=["page_id", "extra"])

    return trees.mapInArrow(run, f"page_id string, extra {LINES}").withColumn("page_id", F.col("page_id").cast(kind))


def furniture_lines(facts: DataFrame, out: DataFrame) -> DataFrame:
    """(page_id, line_no, content) of the lines outside the main body; ``out``: pages to leave out."""
    rows = facts.where(F.size("extra") > 0).join(out, "page_id", "left_anti")
    return rows.select("page_id", F.explode("extra").alias("x")).select("page_id", "x.line_no", "x.content")


def main_bodies(pages: DataFrame, lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, main): the content without the lines given by ``lines`` (page_id, line_no)."""
    gone = lines.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return pages.select(key, "content").join(gone, key, "left").select(key, F.when(F.col("content").isNotNull(), F.array_join(kept, "\n")).alias("main"))
