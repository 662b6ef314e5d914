"""Main text of web pages by wrapper induction.

Pages of one host are made from one template.  Every page is taken apart into
its containers and labelled blocks: a tree of parts, each with a label (element,
classes, id) and the text that stands in it outside its inner parts, links
included.  The trees of a host are aligned by simple tree matching: the largest
match of two trees with equal root labels that keeps the order of siblings,
where a pair counts for more if the two texts are equal, or alike in length.  So
a box that only some pages have does not shift what comes after it.

1. All trees of a host are folded into one template; parts that are matched share
   a slot, others become slots of their own where they stand.  A few dozen trees
   make a partial template, a few dozen of these the next, until one is left, so
   no task holds a host.  Matched parts have the same labels up to the root, so
   parts whose labels stand on too few pages to prove anything are left out first.
2. Every page is aligned with its host's template, and pages and different texts
   are counted per slot, over all pages.  A slot whose text is the same wherever
   it has any is constant, any other varies.
3. Every page is aligned again and put out.  The region is the deepest container
   with nearly all of the page's varying text; it is put out without labelled
   blocks that are constant throughout, and varying parts outside of it are put
   out too, unless the region is the page's own article or main element.

What is not article by its kind (menus, headers, footers, sidebars, adverts,
forms, scripts, reader comments) is left out: by element or role in all steps;
by a class or id that is such a word as a whole in the last one, unless next to
nothing that varies would be left of the page.  A page on which nothing varies, or whose host has
no constant part, falls back on its own article, main or body element.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import per_batch

MIN_PAGES = 3            # text on fewer pages proves nothing about the template
REGION_SHARE = 0.9       # of the varying text of a page
LEFT_SHARE = 0.1         # of a page's text, that class names must leave
PARTIAL_ROWS = 100_000   # counts a task holds before it passes them on
FOLD_TREES = 64          # about as many trees, or partial templates, a task folds into one
SLOT_TEXTS = 8           # frequent texts that a slot of a partial template carries
LISTED_PAIRS = 2_000     # pairs of parts that are weighed one by one,
MOST_LISTED = 300_000    # or so many where a part is in few of them
KEPT_PAIRS = 8_000_000   # pairs of parts whose weights a match keeps

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
NOISE = set("head nav header footer aside form script style noscript template svg canvas "
            "iframe object button select textarea title menu dialog audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
             "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mfrac mi mn mo "
             "mover mrow ms mspace msqrt msub msubsup msup mtable mtd mtext mtr munder semantics".split())
CONTAINER = set("html body main article section div td tr tbody table center".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption "
               "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
               "summary table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
               "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
               "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
# classes and ids that say as a whole, with or without a hyphen, what a box is
NOISE_NAME = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion "
    "banner nav navbar navigation main-nav main-menu mainmenu menu submenu breadcrumb breadcrumbs "
    "header site-header page-header masthead footer site-footer page-footer sidebar side-bar toolbar "
    "comment comments comment-list commentlist comments-area comment-form replies disqus disqus_thread "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices newsletter "
    "newsletter-signup subscribe subscription popup modal overlay related related-posts related-articles "
    "share share-buttons sharing social social-links social-media pagination pager skip-link widget widgets".split())
NOISE_ROLE = set("navigation banner contentinfo complementary search form dialog alert menu".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>]+)))?")
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("label", "named", "noise", "inline", "soft", "children")

    def __init__(self, label: str, named: bool = False, noise: bool = False, inline: bool = False, soft: bool = False):
        self.label, self.named, self.noise, self.inline, self.soft = label, named, noise, inline, soft
        self.children: list = []          # Nodes and str, in page order


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(label, has a class or id, is left out by its kind, is left out by its
    name) of an opening tag."""
    names, noise, soft, met = [], tag in NOISE, False, set()
    for key, a, b, c in ATTR.findall(attrs):
        key = key.lower()
        if key in met:                    # the first of equal attributes counts
            continue
        met.add(key)
        if key in ("class", "id"):
            tokens = html.unescape(a or b or c).split()
            names += tokens
            soft = soft or any(t.lower() in NOISE_NAME for t in tokens)
        elif key == "role":
            noise = noise or (a or b or c).strip().lower() in NOISE_ROLE
        elif key == "hidden":
            noise = True
        elif key == "aria-hidden":
            noise = noise or (a or b or c).strip().lower() == "true"
    label = DIGITS.sub("0", ".".join([tag, *sorted(names)]))
    return label, bool(names), noise, soft and tag not in ("html", "body", "article", "main")


def leave_out_named(root: Node) -> None:
    """On a page without a wrapper: mark the elements whose name says that they
    are no article as left out, unless less than ``LEFT_SHARE`` of the page's
    text would be left."""
    named: list[Node] = []
    left = within = 0
    stack: list = [(root, False)]
    while stack:
        node, inside = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                size = len(c) - c.count(" ") - c.count("\n")
                left, within = (left, within + size) if inside else (left + size, within)
            elif not c.noise:
                if c.soft:
                    named.append(c)
                stack.append((c, inside or c.soft))
    if left >= LEFT_SHARE * (left + within):
        for node in named:
            node.noise = True


def parse(page: str) -> Node:
    """DOM tree of a page, whatever is left unclosed in it."""
    root = Node("#")
    stack: list[tuple[str, Node]] = [("#", root)]
    opened: Counter = Counter()       # open elements by tag; spares vain walks up deep pages
    at, n = 0, len(page)

    def close(i: int):
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1][1].children.append(page[at:])
            break
        if lt > at:
            stack[-1][1].children.append(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:
            stack[-1][1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                # an end tag of inline markup never closes a block
                if tag in INLINE and not stack[i][1].inline:
                    break
            continue
        if tag in CLOSES_P or tag in CLOSES_SELF:
            closes = CLOSES_SELF.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            scope = SCOPE.get(tag, ("table",)) if tag in CLOSES_SELF else ("button", "td", "th", "li", "div",
                                                                          "article", "section", "body")
            for i in range(len(stack) - 1 if any(opened[c] for c in closes) else 0, 0, -1):
                if stack[i][0] in closes:
                    close(i)
                    if tag not in ("tr", "td", "th", "tbody"):
                        break
                elif stack[i][0] in scope:
                    break
        label, has_name, noise, soft = _element(tag, m.group(3))
        node = Node(label, has_name, noise, tag in INLINE, soft)
        stack[-1][1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                node.children.append(page[at:end.start() if end else n])
            after = page.find(">", end.start()) if end else -1
            at = after + 1 if after >= 0 else n
        elif tag not in VOID and not (m.group(3).endswith("/") and tag in ("svg", "path")):
            stack.append((tag, node))
            opened[tag] += 1
    return root


def blocks(node: Node, shown: dict[int, bool] | None = None) -> list[str]:
    """Texts of the blocks under a node in page order, without what is left
    out: character references decoded, white space turned into single blanks.
    ``shown`` says of parts, and of inline elements left out by their name, by
    id of their node, whether their own text is put out; other nodes go with
    the part they stand in."""
    out: list[str] = []
    run: list[str] = []
    shown = shown or {}

    def flush():
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    stack = [(iter(node.children), shown.get(id(node), True), True)]
    while stack:
        children, show, inline = stack[-1]
        for child in children:
            if isinstance(child, str):
                if show:
                    run.append(child)
            elif child.noise:
                if not child.inline:
                    flush()
            elif child.inline:
                if child.label == "br" or child.label.startswith("br."):
                    run.append(" ")
                stack.append((iter(child.children), shown.get(id(child), True) and show, True))
                break
            else:
                flush()
                stack.append((iter(child.children), shown.get(id(child), show), False))
                break
        else:
            stack.pop()
            if not inline:
                flush()
    flush()
    return out


# --------------------------------------------------------------------------
# induction

class Part:
    """Container or labelled block of a page: where it stands, and the text in
    it outside its inner parts."""
    __slots__ = ("node", "up", "texts", "own", "soft")

    def __init__(self, node: Node, up: int):
        self.node, self.up = node, up      # up: index of the part around it
        self.texts: list[str] = []
        self.own = ""
        self.soft: list[Node] = []         # inline elements in it left out by their name


def parts(root: Node) -> list[Part]:
    """All parts of a page, the root first and each before its inner ones."""
    out = [Part(root, -1)]
    stack = [(iter(root.children), 0)]
    while stack:
        children, at = stack[-1]
        for c in children:
            if isinstance(c, str):
                out[at].texts.append(c)
            elif c.noise:
                if not c.inline:
                    out[at].texts.append(" ")
            elif c.inline and c.soft:
                out[at].soft.append(c)
            elif c.inline:
                stack.append((iter(c.children), at))
                break
            else:
                out[at].texts.append(" ")
                if c.named or c.label in CONTAINER:
                    out.append(Part(c, at))
                    at = len(out) - 1
                stack.append((iter(c.children), at))
                break
        else:
            stack.pop()
    for part in out:
        part.own = SPACE.sub(" ", "".join(part.texts)).strip()
        part.texts = []
    return out


def _hash(text: str) -> int:
    """64 bits of a label or text; never 0, which stands for no text."""
    data = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(data, "little", signed=True) or 1


_label = functools.lru_cache(maxsize=20_000)(_hash)
ROW = np.dtype([("up", np.int32), ("label", np.int64), ("text", np.int64), ("size", np.int32)])
# a slot of a partial template: its texts with their pages, and the sizes summed
SLOT = np.dtype([*ROW.descr, ("texts", np.int64, SLOT_TEXTS), ("pages", np.int64, SLOT_TEXTS),
                 ("sizes", np.int64), ("sized", np.int64)])


@functools.lru_cache(maxsize=20_000)
def _path(up: int, label: int) -> int:
    """64 bits of the labels from the root to a part."""
    data = hashlib.blake2b(np.array([up, label], np.int64).tobytes(), digest_size=8).digest()
    return int.from_bytes(data, "little", signed=True)


class Tree:
    """Labels, own texts (hashes) and their lengths of a page's parts, or of a
    template's slots, each before its inner ones and siblings in order."""

    def __init__(self, up: list[int], label: list[int], text: list[int], size: list[int]):
        self.up, self.label, self.text, self.size = up, label, text, size
        self.children: list[list[int]] = [[] for _ in up]
        for n, u in enumerate(up):
            if u >= 0:
                self.children[u].append(n)

    @classmethod
    def of_page(cls, found: list[Part]) -> "Tree":
        return cls([p.up for p in found], [_label(p.node.label) for p in found],
                   [_hash(p.own) if p.own else 0 for p in found], [len(p.own) for p in found])

    @classmethod
    def unpack(cls, data: bytes) -> "Tree":
        rows = np.frombuffer(data, ROW)
        return cls(*(rows[name].tolist() for name in ROW.names))

    def pack(self) -> bytes:
        rows = np.zeros(len(self.up), ROW)
        for name in ROW.names:
            rows[name] = getattr(self, name)
        return rows.tobytes()

    def paths(self) -> list[int]:
        """A number for each part's labels from the root."""
        out: list[int] = []
        for up, label in zip(self.up, self.label):
            out.append(_path(out[up] if up >= 0 else 0, label))
        return out

    def limited(self, known: frozenset) -> "Tree":
        """The tree without the parts whose path is not ``known``, nor what is in them."""
        new, kept = {-1: -1}, []
        for n, path in enumerate(self.paths()):
            if path in known and self.up[n] in new:
                new[n] = len(kept)
                kept.append(n)
        return Tree([new[self.up[n]] for n in kept],
                    *([values[n] for n in kept] for values in (self.label, self.text, self.size)))

    def layout(self) -> int:
        """A number for the tree's form and labels, whatever its texts."""
        form = np.array([self.up, self.label], np.int64).tobytes()
        return int.from_bytes(hashlib.blake2b(form, digest_size=8).digest(), "little", signed=True)


def likeness(x: Tree, i: int, y: Tree, j: int) -> float:
    """What the own texts of two parts add to their match."""
    a, b = x.text[i], y.text[j]
    if a == b:
        return 2.0 if a else 0.5
    if not a or not b:
        return 0.0
    low, high = sorted((x.size[i], y.size[j]))
    return low / high if high else 0.0


def _only(x: Tree, xs: list[int], y: Tree, ys: list[int]) -> list[tuple[int, int]] | None:
    """The pairs of siblings with one label if no other choice is possible: none
    of these labels is there twice, and the pairs do not cross."""
    place = {x.label[c]: c for c in xs}
    shared = [y.label[d] for d in ys if y.label[d] in place]
    if len(set(shared)) < len(shared):
        return None
    shared = set(shared)
    if [x.label[c] for c in xs if x.label[c] in shared] != [y.label[d] for d in ys if y.label[d] in shared]:
        return None
    return [(place[y.label[d]], d) for d in ys if y.label[d] in shared]


def tree_match(x: Tree, y: Tree) -> list[int]:
    """Simple tree matching: for every part of ``y`` the part of ``x`` that it
    is matched with in the heaviest match that keeps labels, ancestors and the
    order of siblings; -1 for none.

    The weight of two siblings' match is 1, their likeness and the heaviest
    match of their children.  Every pair of parts with the same labels up to the
    root is weighed, however many there are: few pairs one by one, many as rows of
    ``Columns``, kept up to ``KEPT_PAIRS`` of them and else made again for the pairs
    of one level.  All ways give the same match.
    """
    partner = [-1] * len(y.up)
    if x.label[0] != y.label[0]:
        return partner
    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, j = todo.pop()
        partner[j] = i
        only = _only(x, x.children[i], y, y.children[j])
        if only is not None:
            todo += only
            continue
        pairs, rows = _pairs(x, i, y, j)
        if pairs <= LISTED_PAIRS or pairs <= min(10 * rows, MOST_LISTED):
            matched = _match_listed(x, i, y, j)
        elif pairs <= KEPT_PAIRS:
            matched = _match_kept(x, i, y, j)
        else:
            columns = Columns(y, j)
            todo += _heaviest_rows(columns.weigh(x, i), columns, y.children[j])
            continue
        for c, d in matched:
            partner[d] = c
    return partner


def _pairs(x: Tree, i: int, y: Tree, j: int) -> tuple[int, int]:
    """Number of pairs of parts below ``i`` and ``j`` with the same labels from
    there on, and of parts of ``x`` in them."""
    number: dict[tuple[int, int], int] = {}
    found = [0]
    stack = [(j, 0)]
    while stack:
        d, path = stack.pop()
        for k in y.children[d]:
            q = number.setdefault((path, y.label[k]), len(found))
            if q == len(found):
                found.append(0)
            found[q] += 1
            if y.children[k]:
                stack.append((k, q))
    pairs = rows = 0
    stack = [(i, 0)]
    while stack:
        c, path = stack.pop()
        for k in x.children[c]:
            q = number.get((path, x.label[k]))
            if q is not None:
                pairs, rows = pairs + found[q], rows + 1
                if x.children[k]:
                    stack.append((k, q))
    return pairs, rows


def _match_listed(x: Tree, i: int, y: Tree, j: int) -> list[tuple[int, int]]:
    """The pairs matched below parts ``i`` and ``j``, weighed one by one."""
    known: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    stack = [(i, j)]
    while stack:
        c, d = stack[-1]
        xs, ys = x.children[c], y.children[d]
        pairs = chosen.pop((c, d), None)
        if pairs is None:
            pairs = [(e, f) for e in xs for f in ys if x.label[e] == y.label[f]]
            if pairs:
                chosen[c, d] = pairs
                stack += pairs             # each is below this pair only
                continue
        stack.pop()
        taken = pairs
        if len(pairs) > 1:
            taken = _heaviest(xs, ys, {p: known[p][0] for p in pairs})
        known[c, d] = 1 + likeness(x, c, y, d) + sum(known[p][0] for p in taken), taken
    out, at = list(known[i, j][1]), 0
    while at < len(out):
        out += known[out[at]][1]
        at += 1
    return out


def _heaviest(xs: list[int], ys: list[int], weight: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The heaviest pairs of two lists that do not cross."""
    best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, c in enumerate(xs, 1):
        row, above = best[i], best[i - 1]
        for j, d in enumerate(ys, 1):
            w = weight.get((c, d))
            top = above[j] if above[j] >= row[j - 1] else row[j - 1]
            row[j] = max(top, above[j - 1] + w) if w is not None else top
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
    return out[::-1]


class Columns:
    """The parts of ``y`` from part ``j`` on by their labels from there (a path),
    to weigh parts of another tree with all of one path at a time.

    The children of all parts of a path lie in one vector: a zero, the best matches up
    to the first child, up to the second, and so on for each part, filled up to a power
    of two, parts of one width side by side.  While the children of a part of ``x`` are
    gone through there is one such vector for it and each part around it, so weighing
    takes memory in proportion to the trees, not to their pairs.
    """

    def __init__(self, y: Tree, j: int):
        self.number: dict[tuple[int, int], int] = {}      # path around, label -> path
        self.members, self.place = [[j]], {j: 0}          # of a path; of a part in its path
        self.columns: list[np.ndarray] = [np.zeros(0, np.int64)]  # of a path's parts, in the vector of the path around
        self.ends, self.size, self.widths = [], [], []
        path = 0
        while path < len(self.members):
            kids = [y.children[d] for d in self.members[path]]
            width = np.array([1 << len(k).bit_length() for k in kids], np.int64)
            order = np.argsort(width, kind="stable")
            start = np.empty(len(kids), np.int64)
            start[order] = np.cumsum(width[order]) - width[order]
            self.ends.append(start + width - 1)
            self.size.append(int(width.sum()))
            wide, first = np.unique(width[order], return_index=True)
            edge = [*start[order][first].tolist(), self.size[path]]
            self.widths.append([(a, e, w) for a, e, w in zip(edge, edge[1:], wide.tolist()) if w > 1])
            found: dict[int, list[int]] = {}
            for at, some in zip(start.tolist(), kids):
                for n, d in enumerate(some, at + 1):
                    label = y.label[d]
                    q = self.number.get((path, label))
                    if q is None:
                        q = self.number[path, label] = len(self.members)
                        self.members.append([])
                    self.place[d] = len(self.members[q])
                    self.members[q].append(d)
                    found.setdefault(q, []).append(n)
            self.columns += [np.array(c, np.int64) for c in found.values()]
            path += 1
        self.text = [np.array([y.text[d] for d in m], np.int64) for m in self.members]
        self.length = [np.array([y.size[d] for d in m], np.float64) for m in self.members]

    def own(self, x: Tree, c: int, path: int) -> np.ndarray:
        """1 and the likeness of part ``c`` of ``x`` with each part of a path."""
        text = self.text[path]
        if not x.text[c]:
            return np.where(text == 0, 1.5, 1.0)
        low, high = np.minimum(self.length[path], x.size[c]), np.maximum(self.length[path], x.size[c])
        out = 1 + np.divide(low, high, out=np.zeros(len(low)), where=(text != 0) & (high > 0))
        out[text == x.text[c]] = 3.0
        return out

    def add(self, best: np.ndarray, path: int, kid: int, row: np.ndarray) -> None:
        """Match one more child, of path ``kid`` and these weights, with the children of a path's parts."""
        at = self.columns[kid]
        best[at] = np.maximum(best[at], best[at - 1] + row)
        for a, e, width in self.widths[path]:
            some = best[a:e].reshape(-1, width)
            np.maximum.accumulate(some, axis=1, out=some)

    def weigh(self, x: Tree, i: int, kept: dict[int, np.ndarray] | None = None
              ) -> Iterator[tuple[int, int, np.ndarray]]:
        """The children of part ``i`` of ``x`` in order: (child, path, weights of
        its matches with the path's parts).  ``kept`` gets those of all parts below."""
        stack = [(i, 0, iter(x.children[i]), None)]
        while stack:
            c, path, kids, best = stack[-1]
            row = None
            for k in kids:
                q = self.number.get((path, x.label[k]))
                if q is None:
                    continue
                if x.children[k] and self.widths[q]:
                    stack.append((k, q, iter(x.children[k]), np.zeros(self.size[q])))
                    break
                row = self.own(x, k, q)
                if kept is not None:
                    kept[k] = row
                if best is None:
                    yield k, q, row
                else:
                    self.add(best, path, q, row)
            else:
                stack.pop()
                if not stack:
                    return
                row = self.own(x, c, path) + best[self.ends[path]]
                if kept is not None:
                    kept[c] = row
                if stack[-1][3] is None:
                    yield c, path, row
                else:
                    self.add(stack[-1][3], stack[-1][1], path, row)


def _match_kept(x: Tree, i: int, y: Tree, j: int) -> list[tuple[int, int]]:
    """The pairs matched below parts ``i`` and ``j``, all weights kept as rows."""
    columns, kept = Columns(y, j), {}
    for _ in columns.weigh(x, i, kept):
        pass
    out, todo = [], [(i, j)]
    while todo:
        c, d = todo.pop()
        xs, ys = x.children[c], y.children[d]
        taken = _only(x, xs, y, ys)
        if taken is None and len(xs) * len(ys) <= LISTED_PAIRS:
            taken = _heaviest(xs, ys, {(e, f): float(kept[e][columns.place[f]])
                                       for e in xs for f in ys if x.label[e] == y.label[f]})
        elif taken is None:
            level = Columns(Tree([-1] + [0] * len(ys), *([v[n] for n in (d, *ys)] for v in (y.label, y.text, y.size))), 0)
            places = [np.array([columns.place[ys[n - 1]] for n in m]) for m in level.members[1:]]
            paths = [(e, level.number.get((0, x.label[e]))) for e in xs]
            taken = _heaviest_rows(((e, q, kept[e][places[q - 1]]) for e, q in paths if q), level, ys)
        out += taken
        todo += taken
    return out


def _heaviest_rows(rows: Iterator[tuple[int, int, np.ndarray]], columns: Columns, ys: list[int]) -> list[tuple[int, int]]:
    """``_heaviest`` of the children ``ys`` of the columns' first part and those of
    ``rows``.  Where a best match is that of the row above, or of one child less, is
    noted as bits, on disk above 64 MB."""
    best, kids, n = np.zeros(columns.size[0]), [], len(ys) + 1
    width = (n + 7) // 8
    with tempfile.SpooledTemporaryFile(max_size=64 << 20) as notes:
        for c, path, row in rows:
            above = best[:n].copy()
            columns.add(best, 0, path, row)
            notes.write(np.packbits(best[:n] == above).tobytes())
            notes.write(np.packbits(best[1:n] == best[:n - 1]).tobytes().ljust(width, b"\0"))
            kids.append(c)
        out, j = [], len(ys)
        for r in range(len(kids) - 1, -1, -1):
            notes.seek(2 * width * r)
            up, left = notes.read(width), notes.read(width)
            while j and not up[j >> 3] >> (7 - j & 7) & 1:
                j -= 1                     # bit j of ``left`` is that of child j + 1
                if not left[j >> 3] >> (7 - j & 7) & 1:
                    out.append((kids[r], ys[j]))
                    break
    return out[::-1]


class Partial:
    """A template of some pages: its tree, and per slot the frequent texts with
    their pages and the sum and number of the sizes.

    Texts are counted as in mergeable heavy-hitter summaries: once there are more
    than ``SLOT_TEXTS``, all lose what the next one has.  So a text on more than one
    in ``SLOT_TEXTS`` + 1 of the slot's pages is never lost, however pages are split.
    """

    def __init__(self, tree: Tree, texts: list[Counter], sizes: list[list[int]]):
        self.tree, self.texts, self.sizes = tree, texts, sizes

    @classmethod
    def of_page(cls, tree: Tree, pages: int = 1) -> "Partial":
        """Of a tree that so many pages have."""
        return cls(tree, [Counter({t: pages}) if t else Counter() for t in tree.text],
                   [[s * pages, pages] if t else [0, 0] for t, s in zip(tree.text, tree.size)])

    @classmethod
    def unpack(cls, data: bytes) -> "Partial":
        rows = np.frombuffer(data, SLOT)
        texts = [Counter({t: n for t, n in zip(ts, ns) if n})
                 for ts, ns in zip(rows["texts"].tolist(), rows["pages"].tolist())]
        return cls(Tree(*(rows[name].tolist() for name in ROW.names)), texts,
                   np.stack([rows["sizes"], rows["sized"]], 1).tolist())

    def pack(self) -> bytes:
        rows = np.zeros(len(self.texts), SLOT)
        for name in ROW.names:
            rows[name] = getattr(self.tree, name)
        for row, texts, (size, sized) in zip(rows, self.texts, self.sizes):
            row["texts"][:len(texts)], row["pages"][:len(texts)] = list(texts), list(texts.values())
            row["sizes"], row["sized"] = size, sized
        return rows.tobytes()

    def add(self, page: "Partial") -> None:
        """Match ``page`` with what is there: a matched part joins its slot, any
        other becomes a slot in its place."""
        template, other = self.tree, page.tree
        slot = tree_match(template, other)
        for j, i in enumerate(slot):       # parents come before their children
            if i < 0:
                up = slot[other.up[j]] if j else -1
                if up < 0:                 # another root: not of this template
                    continue
                i = slot[j] = len(template.up)
                template.up.append(up), template.label.append(other.label[j])
                template.text.append(other.text[j]), template.size.append(other.size[j])
                template.children.append([])
                self.texts.append(Counter()), self.sizes.append([0, 0])
                # between the slots of the nearest siblings that have one; there by the
                # label, so that slots no page has together stand in one order everywhere
                kids, siblings = template.children[up], other.children[other.up[j]]
                place = bisect.bisect_left(siblings, j)
                left = next((slot[k] for k in siblings[:place][::-1] if slot[k] >= 0), None)
                right = next((slot[k] for k in siblings[place + 1:] if slot[k] >= 0), None)
                low = 0 if left is None else kids.index(left) + 1
                high = len(kids) if right is None else kids.index(right)
                at = next((n for n in range(low, high) if template.label[kids[n]] > other.label[j]), high)
                kids.insert(at, i)
            if page.sizes[j][1]:
                seen = self.texts[i]
                seen.update(page.texts[j])
                self.sizes[i][0] += page.sizes[j][0]
                self.sizes[i][1] += page.sizes[j][1]
                template.text[i] = min(seen, key=lambda t: (-seen[t], t), default=template.text[i])
                template.size[i] = self.sizes[i][0] // self.sizes[i][1]

    def numbered(self) -> "Partial":
        """The same, each slot before its inner ones and siblings in order."""
        tree, order, new, stack = self.tree, [], {}, [0]
        while stack:
            i = stack.pop()
            new[i] = len(order)
            order.append(i)
            stack += reversed(tree.children[i])
        pick = lambda values: [values[i] for i in order]
        return Partial(Tree([new[u] if u >= 0 else -1 for u in pick(tree.up)], pick(tree.label),
                            pick(tree.text), pick(tree.size)), pick(self.texts), pick(self.sizes))

    def thinned(self) -> "Partial":
        """The same with at most ``SLOT_TEXTS`` texts a slot."""
        for i, seen in enumerate(self.texts):
            if len(seen) > SLOT_TEXTS:
                least = sorted(seen.values(), reverse=True)[SLOT_TEXTS]
                self.texts[i] = Counter({t: n - least for t, n in seen.items() if n > least})
        return self


def merged(partials: list[Partial]) -> Partial:
    """One template of several, in their order; the first one is used up."""
    out = partials[0]
    for partial in partials[1:]:
        out.add(partial)
    return out.numbered()


def fold(pages: list[Tree]) -> Tree:
    """The template of some pages: each in turn is matched with what is there;
    a matched part joins its slot, any other becomes a slot in its place.  A
    slot's text is its most frequent one, of equally frequent ones the least
    number, its size their mean."""
    first = pages[0]
    copy = Tree(list(first.up), list(first.label), list(first.text), list(first.size))
    return merged([Partial.of_page(t) for t in (copy, *pages[1:])]).tree


def _shown(found: list[Part], constant: list[bool]) -> dict[int, bool] | None:
    """By id of their nodes, which parts of a page are put out, given which are
    constant on the host; None if nothing varies."""
    tags = [p.node.label.split(".")[0] for p in found]
    named = [False] * len(found)                                          # within a telling name
    for n, p in enumerate(found):
        named[n] = p.node.soft or (n > 0 and named[p.up])
    varying = [0 if c else len(p.own) for p, c in zip(found, constant)]
    left = sum(v for v, out in zip(varying, named) if not out)
    if left < LEFT_SHARE * sum(varying):                                  # the names mean nothing here
        named = [False] * len(found)
    inside = [0 if out else v for v, out in zip(varying, named)]
    fixed = [c or not p.own or out for p, c, out in zip(found, constant, named)]   # nothing to put out
    for n in range(len(found) - 1, 0, -1):
        inside[found[n].up] += inside[n]
        fixed[found[n].up] &= fixed[n]
    if not inside[0]:
        return None
    region = 0
    for n in range(1, len(found)):
        if (found[n].up == region and tags[region] not in ("article", "main") and tags[n] in CONTAINER
                and inside[n] >= REGION_SHARE * inside[0]):
            region = n
    alone = tags[region] in ("article", "main")
    within, removed = [False] * len(found), [False] * len(found)
    shown = {}
    for n, p in enumerate(found):
        within[n] = n == region or (n > 0 and within[p.up])
        removed[n] = within[n] and ((n > 0 and removed[p.up]) or (n != region and p.node.named and fixed[n]))
        shown[id(p.node)] = not named[n] and (
            not removed[n] if within[n] else not alone and bool(p.own) and not constant[n])
        for inline in p.soft:
            shown[id(inline)] = False
    return shown


def _fallback(root: Node) -> Node:
    """The page's article, else main, else body, else all of it."""
    found: dict[str, Node] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.inline:
            found.setdefault(node.label.split(".")[0], node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.noise]
    return found.get("article") or found.get("main") or found.get("body") or root


class Wrapper:
    """A host's template and which of its slots are constant."""

    def __init__(self, template: Tree, constant: frozenset):
        self.template, self.constant = template, constant

    def constant_parts(self, found: list[Part]) -> list[bool]:
        return [i in self.constant for i in tree_match(self.template, Tree.of_page(found))]


def extract(page: str, wrapper: Wrapper | None = None) -> str:
    """Main text of a page; without a wrapper its own article, main or body."""
    root = parse(page)
    shown = None
    if wrapper is not None and wrapper.constant:
        found = parts(root)
        shown = _shown(found, wrapper.constant_parts(found))
    if shown:
        return "\n".join(blocks(root, shown))
    leave_out_named(root)
    return "\n".join(blocks(_fallback(root)))


# --------------------------------------------------------------------------
# jobs

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))


@per_batch
def _trees(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(host, html) -> (host, paths, tree); ``paths`` are the different ones of the tree."""
    trees = [Tree.of_page(parts(parse(page))) for page in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([sorted(set(t.paths())) for t in trees], pa.list_(pa.int64())),
         pa.array([t.pack() for t in trees], pa.binary())],
        names=["host", "paths", "tree"])


@functools.lru_cache(maxsize=256)
def _known(data: bytes) -> frozenset:
    return frozenset(np.frombuffer(data, np.int64).tolist())


@per_batch
def _limit(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(host, tree, known paths) -> (host, tree) with these paths only."""
    ends, paths = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
    trees = [Tree.unpack(t).limited(_known(paths[a:b].tobytes())).pack()
             for t, a, b in zip(batch.column(1).to_pylist(), ends, ends[1:])]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.binary())], names=["host", "tree"])


def _fold_some(rows: pa.Table) -> pa.Table:
    """Trees (``pages`` have them) or partial templates (``pages`` is null) of
    one host -> one partial template."""
    some = [Partial.unpack(data) if pages is None else Partial.of_page(Tree.unpack(data), pages)
            for data, pages in zip(rows["data"].to_pylist(), rows["pages"].to_pylist())]
    # one of every layout by falling number of pages, then a second one, and so on
    weight = [n or max(s for _, s in p.sizes) for n, p in zip(rows["pages"].to_pylist(), some)]
    layout = [p.tree.layout() for p in some]
    total, met, turns = Counter(), Counter(), []
    for form, n in zip(layout, weight):
        total[form] += n
    for k in sorted(range(len(some)), key=lambda k: (rows["mix"][k].as_py(), rows["data"][k].as_py())):
        met[layout[k]] += 1
        turns.append((met[layout[k]], -total[layout[k]], layout[k], k))
    out = merged([some[k] for *_, k in sorted(turns)]).thinned().pack()
    return pa.table({"host": rows["host"].slice(0, 1).cast(pa.string()), "data": pa.array([out], pa.binary()),
                     "pages": pa.array([None], pa.int64())})


@per_batch
def _templates(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(host, partial template) -> (host, template)."""
    trees = [Partial.unpack(data).tree.pack() for data in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.binary())], names=["host", "template"])


def templates(trees: DataFrame, fold_trees: int = FOLD_TREES) -> DataFrame:
    """(host, template) from (host, paths, tree), of all trees of every host.

    A slot holds parts of one path, and a path on fewer than ``MIN_PAGES`` pages
    gives no constant slot: such parts are left out, and equal trees become one
    with its number of pages.  Then about ``fold_trees`` trees of a host at a time
    are folded into a partial template, and these again, until there is one.
    Trees are dealt by their content, so the templates are the same in every run.
    """
    known = cut_lineage(trees.select("host", F.explode("paths").alias("path"))
                        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
                        .where(F.col("pages") >= MIN_PAGES)
                        .groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("known")))
    state = cut_lineage(trees.select("host", "tree").join(known, "host").select("host", "tree", "known")
                        .mapInArrow(_limit, "host string, tree binary")
                        .groupBy("host", F.col("tree").alias("data")).agg(F.count(F.lit(1)).alias("pages")))
    while True:
        many = cut_lineage(state.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        most = many.agg(F.max("n").alias("n")).first()["n"] or 0
        groups = F.ceil(F.col("n") / F.lit(fold_trees))
        mix = F.xxhash64("data")
        state = cut_lineage(state.join(many, "host").select(
            "host", "data", "pages", mix.alias("mix"), F.pmod(mix, groups).alias("part"))
            .groupBy("host", "part").applyInArrow(_fold_some, "host string, data binary, pages bigint"))
        if most <= fold_trees:
            return state.select("host", "data").mapInArrow(_templates, "host string, template binary")


@functools.lru_cache(maxsize=256)
def _template(data: bytes) -> Tree:
    return Tree.unpack(data)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tree, template) -> per host and slot: pages on which it has own
    text, least and largest hash of that; partial counts."""
    counts: dict[tuple[str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        hosts, slots = zip(*counts)
        cols = [pa.array(c, pa.int64()) for c in (slots, *zip(*counts.values()))]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *cols],
                                          names=["host", "slot", "pages", "low", "high"])
    for batch in batches:
        for host, data, template in zip(*(c.to_pylist() for c in batch.columns)):
            page = Tree.unpack(data)
            for slot, text in zip(tree_match(_template(template), page), page.text):
                if slot < 0 or not text:    # says nothing about the template
                    continue
                row = counts.setdefault((host, slot), [0, text, text])
                row[0] += 1
                row[1], row[2] = min(row[1], text), max(row[2], text)
            if len(counts) >= PARTIAL_ROWS:
                yield flush()
    if counts:
        yield flush()


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, template, constant array<int>) from all pages of each host
    (repeated rows count each).

    The trees are written once.  Templates grow with the different parts of a
    host, not with its pages; tasks pass on partial templates and partial counts
    per host and slot, so a host of any size is never gathered.
    Hosts without a constant slot have no row.
    """
    trees = cut_lineage(_with_host(pages).select("host", "html").mapInArrow(
        _trees, "host string, paths array<bigint>, tree binary"))
    # Written, so that the planner knows its size: small tables of templates are
    # broadcast under the session's threshold, others joined by shuffle.
    known = cut_lineage(templates(trees))
    counts = (trees.select("host", "tree").join(known, "host")
              .mapInArrow(_count_slots, "host string, slot bigint, pages bigint, low bigint, high bigint")
              .groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"),
                                           F.max("high").alias("high")))
    constant = (counts.where((F.col("pages") >= MIN_PAGES) & (F.col("low") == F.col("high")))
                .groupBy("host").agg(F.sort_array(F.collect_list(F.col("slot").cast("int"))).alias("constant")))
    return known.join(constant, "host")


@functools.lru_cache(maxsize=256)
def _wrapper(template: bytes, constant: bytes) -> Wrapper:
    return Wrapper(Tree.unpack(template), frozenset(np.frombuffer(constant, np.int32).tolist()))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text,
    n_chars (code points).

    A null html is an empty page with an empty text.  Pages without a host in
    their url share one wrapper; a null url is kept.  Repeated rows and ids
    are extracted each; an empty table gives an empty result.
    """
    wrappers = cut_lineage(induce_wrappers(pages))
    rows = _with_host(pages).join(wrappers, "host", "left").select("page_id", "url", "html", "template", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, slots = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().astype(np.int32)
            texts = [extract(h, None if t is None else _wrapper(t, slots[a:b].tobytes()))
                     for h, t, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
