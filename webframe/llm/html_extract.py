"""Main text of web pages by wrapper induction.

Pages of one host come from one template. The page of median length of a host is
its reference; the tree of every other page is aligned with it by simple tree
matching (the largest order-preserving mapping of equal elements, found child list
by child list). Aligned nodes with the same text on nearly all distinct pages of
the host are template. So is, whether the reference has it or not, a text that stands
at one path of tags on nearly all distinct pages that have a block there. Only
these votes are gathered, by host and node or path. Elements that say themselves that they
are no article (menus, forms, adverts by tag, role or class) are left out first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import Scratch

#: A node is template if it has the same text on this share of the distinct aligned pages, of which so many more are
#: taken to differ before any is seen. On few pages that share is never reached, and only what elements say counts.
SAME_SHARE, PRIOR = 0.9, 0.5
#: Pairs of nodes with children on two pages beyond which weights are worked out by kinds of subtrees; they are the same.
WIDE = 1 << 18
#: A text is rare if its places on two pages pair up to at most so many pairs a place.
RARE = 8
# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main "
    "blockquote pre hr figure figcaption address details summary center fieldset nav header footer aside form menu dialog".split()
)
NO_CONTENT = frozenset(
    "head title script style noscript template textarea iframe xmp nav footer aside form button select input label "
    "fieldset svg canvas object dialog menu".split()
)
#: Words of class and id attributes, and roles, of elements that are no article.
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation "
    "menu menus breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup login comment comments respond disqus reply replies share sharing social related recommended popup modal overlay "
    "hidden pagination pager toolbar widget masthead complementary contentinfo search skip".split()
)
#: Words that stand beside one of those in a compound and change nothing: "comment-list", "site-footer".
NEUTRAL_WORDS = frozenset(
    "list lists area areas container wrap wrapper box block body section inner outer item items form slot unit holder site page "
    "global main top bottom left right primary secondary module panel bar post posts entry thread group row column col header "
    "text content-info title small large mobile desktop".split()
)
#: Of those, words of elements that are never spared, whatever they hold.
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments respond disqus reply replies related "
    "recommended cookie cookies consent gdpr newsletter subscribe subscription".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_TOKENS = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_MARKS = re.compile(r"(?<![-\w])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    """An element; ``blocks`` are the text blocks that lie directly in it."""

    __slots__ = ("tag", "children", "blocks", "number", "drop", "article", "certain", "mark", "path", "sign", "full", "inner")

    def __init__(self, tag: str, drop: bool, article: bool, certain: bool = False, mark: Mark | None = None):
        self.tag, self.drop, self.article, self.certain, self.mark = tag, drop, article, certain, mark
        self.children: list[Node] = []
        self.blocks: list[str] = []
        self.number = -1
        self.path = 0


class Mark:
    """What is known of an element that may have to be spared, or that may be the main article; closed when the element is."""

    __slots__ = ("at", "why", "kind", "around", "begin", "size")

    def __init__(self, at: int, why: int, kind: str, around: list[Mark], begin: int):
        self.at, self.why, self.kind, self.around, self.begin, self.size = at, why, kind, around, begin, 0


#: What tells that an element is no article: its tag or that it is hidden, a name that somebody gave it, or such a name
#: that tells of comments, adverts and the like.
CERTAIN, BY_NAME, NEVER = 1, 2, 3


@lru_cache(4096)
def _no_content(tag: str, attributes: str, in_article: bool) -> int:
    if tag in NO_CONTENT or tag == "header" and not in_article:
        return CERTAIN
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if tag != "article" and (name == "hidden" or name == "aria-hidden" and value.lower() == "true"):
            return CERTAIN
        for token in value.split():
            found = max(found, _named(token, in_article))
    # An article is one, unless it is a comment or a teaser by its name.
    return found if tag != "article" or found == NEVER else 0


@lru_cache(4096)
def _named(token: str, in_article: bool) -> int:
    """A compound counts if one of its parts does and the others change nothing: "comment-body", "siteFooter", but not
    "no-sidebar" or "content-sidebar-wrap"."""
    parts = [p.lower() for p in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", token) if p]
    telling = {p for p in parts if p in NO_CONTENT_WORDS}
    if not all(p in telling or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
        return 0
    if telling & NEVER_WORDS:
        return NEVER
    return BY_NAME if telling or "header" in parts and not in_article else 0


def parse_page(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page and its text blocks in order, each with the element it lies in.

    The main article of a page is its largest article element outside elements that their names call no article, else the
    largest inside such; without one, its main elements stand for them. Elements around it are kept against their names. On a
    page without any, an element is that holds more than half of the text. Comments, adverts and their like never are.
    """
    root, out, marks, seen = _parse(source, frozenset())
    spared = _spared(marks, seen)
    return _parse(source, spared)[:2] if spared else (root, out)


def _spared(marks: list[Mark], seen: int) -> frozenset[int]:
    """The places of the named elements that are kept."""
    for kind in ("article", "main"):
        found = [m for m in marks if m.kind == kind and not m.why and all(a.why != NEVER for a in m.around)]
        if found:
            free = [m for m in found if not m.around]
            return frozenset(a.at for a in max(free or found, key=lambda m: m.size).around)
    return frozenset(m.at for m in marks if m.why == BY_NAME and 2 * m.size > seen)


def _parse(source: str, spared: frozenset[int]) -> tuple[Node, list[tuple[Node, str]], list[Mark], int]:
    """Tree, blocks, marks of named elements and articles, and the length of all text; elements at ``spared`` are kept."""
    root = Node("", False, False)
    stack, out, held, marks = [root], [], [], []
    seen = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                node = stack[-1]
                k = len(stack) - 1
                while k and (node.tag not in BLOCK or node.drop):
                    k -= 1
                    node = stack[k]
                node.blocks.append(text)
                out.append((node, text))

    def close(k: int) -> None:
        if any(n.tag in BLOCK for n in stack[k:]):
            flush()
        for n in stack[k:]:
            if n.mark:
                n.mark.size = seen - n.mark.begin
        del stack[k:]

    at, size = 0, len(source)
    while at < size:
        m = _TOKENS.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not stack[-1].certain:
                    seen += len(piece.strip())
                if not stack[-1].drop:
                    held.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ("p", "table", "button")), 0)
            if k and stack[k].tag == "p":
                close(k)
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES.get(tag, ()):
                    break
                if stack[k].tag in CLOSED_BY[tag]:
                    close(k)
                    break
        parent = stack[-1]
        in_article = parent.article or tag in ("article", "main")
        why = _no_content(tag, m[3], in_article)
        certain = parent.certain or why == CERTAIN
        mark = None
        if not certain and (why or tag in ("article", "main")):
            kind = tag if tag in ("article", "main") else ""
            mark = Mark(m.start(), why, kind, [n.mark for n in stack if n.mark and n.mark.why], seen)
            marks.append(mark)
        drop = parent.drop or certain or why != 0 and m.start() not in spared
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        node = Node(tag, drop, in_article, certain, mark)
        node.path = crc32(f"/{tag}".encode(), parent.path) if tag in BLOCK else parent.path
        if tag in BLOCK or drop != parent.drop:
            # Inline elements are no nodes of the tree; their text belongs to the block around them.
            owner = next(n for n in reversed(stack) if n.tag in BLOCK or n.drop or n is root)
            if not parent.drop:
                owner.children.append(node)
        stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
            if not drop:
                held.append(source[at : end.start() if end else size])
            at = end.start() if end else size
    flush()
    close(1)
    return root, out, marks, seen


def content_blocks(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree, and the blocks that may be content: those in articles if the page has any, else all that are left."""
    root, blocks = parse_page(source)
    inside = [(n, t) for n, t in blocks if n.article and not n.drop]
    return root, inside or [(n, t) for n, t in blocks if not n.drop]


def _sign(root: Node) -> None:
    """For every node: a hash of its subtree with the texts, the weight of mapping it to an equal one, and how many nodes with children it has."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        node.sign = hash((node.tag, tuple(node.blocks), tuple(c.sign for c in node.children)))
        node.full = 1 + bool(node.blocks) + sum(c.full for c in node.children)
        node.inner = bool(node.children) + sum(c.inner for c in node.children)


def _own(a: Node, b: Node) -> int:
    return 2 if a.blocks and a.blocks == b.blocks else 1


class _Weights:
    """Weights of mapping nodes of a page to nodes of a reference, as far as they have been worked out.

    Small pages have a weight for each pair of nodes with children. In larger ones most pairs share no rare text (``RARE``). Their
    weight is that of their kinds: the subtrees without all texts but those that are frequent on both pages, equal ones
    of which are one node. So what repeats is worked out once, and pairs that share a rare text one by one; both give the same weight.
    """

    def __init__(self, page: Node, reference: Node):
        self.pairs: dict[tuple[int, int], tuple[int, list]] = {}
        self.kinds: dict[int, np.ndarray] = {}
        self.kind: dict[int, Node] | None = None
        if page.inner * reference.inner > WIDE:
            self._classify(page, reference)

    def _classify(self, page: Node, reference: Node) -> None:
        orders, places, around = [], [], {}
        for root in (page, reference):
            order, found, todo = [], {}, [(root, None, 0)]
            while todo:
                node, parent, way = todo.pop()
                around[id(node)], way = parent, hash((way, node.tag))
                order.append((node, way))
                if node.blocks:
                    found.setdefault((way, tuple(node.blocks)), []).append(node)
                todo += [(c, node, way) for c in node.children]
            orders.append(order)
            places.append(found)
        #: Pairs that share a rare text, and for a node and a list of the reference the nodes in it that it has such pairs with.
        self.near: set[tuple[int, int]] = set()
        self.beside: dict[tuple[int, int], list[Node]] = {}
        frequent = set()
        for key, xs in places[0].items():
            ys = places[1].get(key, ())
            if len(xs) * len(ys) > RARE * (len(xs) + len(ys)):
                frequent.add(key)
                continue
            for x, y in ((x, y) for x in xs for y in ys):
                while x is not None and (id(x), id(y)) not in self.near:
                    self.near.add((id(x), id(y)))
                    up = around[id(y)]
                    self.beside.setdefault((id(x), id(up)), []).append(y)
                    x, y = around[id(x)], up
        self.kind, made = {}, {}
        #: Kinds with children are numbered for each tag.
        self.number: dict[int, int] = {}
        self.count: dict[str, int] = {}
        for order in orders:
            for node, way in reversed(order):
                text = tuple(node.blocks) if (way, tuple(node.blocks)) in frequent else ()
                below = [self.kind[id(c)] for c in node.children]
                key = (node.tag, text, tuple(map(id, below)))
                if key not in made:
                    kind = made[key] = Node(node.tag, False, False)
                    kind.blocks, kind.children = list(text), below
                    kind.sign = hash((kind.tag, text, tuple(c.sign for c in below)))
                    kind.full = 1 + bool(text) + sum(c.full for c in below)
                    if below:
                        self.number[id(kind)] = self.count.get(kind.tag, 0)
                        self.count[kind.tag] = self.number[id(kind)] + 1
                self.kind[id(node)] = made[key]

    def alone(self, x: Node, y: Node) -> bool:
        """Whether the weight of a pair is its own, not that of two kinds."""
        return self.kind is None or (id(x), id(y)) in self.near

    def as_kind(self, x: Node) -> Node:
        return self.kind.get(id(x), x)

    def has(self, x: Node, y: Node) -> bool:
        if self.alone(x, y):
            return (id(x), id(y)) in self.pairs
        x, y = self.as_kind(x), self.as_kind(y)
        return id(x) in self.kinds and self.kinds[id(x)][self.number[id(y)]] >= 0

    def row(self, x: Node) -> np.ndarray:
        """The weights of a kind with those of the same tag by their numbers, -1 where not known."""
        if id(x) not in self.kinds:
            self.kinds[id(x)] = np.full(self.count[x.tag], -1, np.int32)
        return self.kinds[id(x)]

    def of(self, x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        if x.sign == y.sign:
            return x.full
        if not x.children or not y.children:
            return _own(x, y)
        if self.alone(x, y):
            return self.pairs[(id(x), id(y))][0]
        x, y = self.as_kind(x), self.as_kind(y)
        return x.full if x.sign == y.sign else int(self.kinds[id(x)][self.number[id(y)]])

    def below(self, at: Node, xs: list[Node], ys: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The pairs of two lists, of which the second lies in ``at``, whose weights have to be known first."""
        by_tag: dict[str, dict[int, Node]] = {}
        for y in ys:
            if y.children:
                y = y if self.kind is None else self.as_kind(y)
                by_tag.setdefault(y.tag, {})[id(y)] = y
        told = set()
        for x in xs:
            if not x.children:
                continue
            if self.kind is not None:
                yield from ((x, y) for y in self.beside.get((id(x), id(at)), ()) if y.children and x.sign != y.sign)
                x = self.as_kind(x)
                if id(x) in told:
                    continue
                told.add(id(x))
            yield from ((x, y) for y in by_tag.get(x.tag, {}).values() if x.sign != y.sign)

    def learn(self, x: Node, y: Node) -> None:
        """Works out the weight of a pair, bottom up and without recursion, for pairs of equal tags at equal depth."""

        def opened(x: Node, y: Node) -> tuple:
            ends, xs, ys = _stripped(x.children, y.children)
            return x, y, ends, xs, ys, self.below(y, xs, ys)

        todo = [opened(x, y)]
        while todo:
            x, y, ends, xs, ys, rest = todo[-1]
            missing = next(((c, d) for c, d in rest if not self.has(c, d)), None)
            if missing is not None:
                todo.append(opened(*missing))
                continue
            todo.pop()
            gain = _own(x, y) + sum(c.full for c, _ in ends)
            if self.alone(x, y):
                pairs = _matched(xs, ys, y, self)
                self.pairs[(id(x), id(y))] = (gain + sum(self.of(c, d) for c, d in pairs), ends + pairs)
            else:
                self.row(x)[self.number[id(y)]] = gain + _heaviest(xs, ys, y, self)

    def mapped(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        """The children of a mapped pair that map."""
        if x.sign == y.sign:
            return list(zip(x.children, y.children))
        if not x.children or not y.children:
            return []
        if (id(x), id(y)) not in self.pairs:
            if self.alone(x, y):
                self.learn(x, y)
            else:
                # Known by its kinds; the mapping of the nodes themselves needs the weights of what is below them.
                ends, xs, ys = _stripped(x.children, y.children)
                for c, d in self.below(y, xs, ys):
                    if not self.has(c, d):
                        self.learn(c, d)
                return ends + _matched(xs, ys, y, self)
        return self.pairs[(id(x), id(y))][1]


def align(page: Node, reference: Node) -> dict[int, Node]:
    """Simple tree matching: nodes of the page (by id()) mapped to nodes of the reference.

    The weight of a mapping is the number of mapped nodes, and one more for each with the same text. Only equal tags
    map, children only where their parents do, in the same order. Equal subtrees at the ends of two child lists map as they
    are, which loses no weight. The mapping is the heaviest at every size. Memory is linear in the length of child lists,
    but for four bytes for each two different kinds of subtrees that meet.
    """
    for root in (page, reference):
        if not hasattr(root, "sign"):
            _sign(root)
    weights = _Weights(page, reference)
    out, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        out[id(a)] = b
        todo += weights.mapped(a, b)
    return out


def _stripped(xs: list[Node], ys: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Equal subtrees at both ends of two lists, and the rest of both."""
    a, most = 0, min(len(xs), len(ys))
    while a < most and xs[a].sign == ys[a].sign:
        a += 1
    z = 0
    while z < most - a and xs[-1 - z].sign == ys[-1 - z].sign:
        z += 1
    ends = [*zip(xs[:a], ys[:a]), *zip(xs[len(xs) - z :], ys[len(ys) - z :])]
    return ends, xs[a : len(xs) - z], ys[a : len(ys) - z]


class _Rows:
    """Weights of one node against a list of nodes below ``at``, as arrays."""

    def __init__(self, ys: list[Node], at: Node, weights: _Weights):
        self.ys, self.at, self.weights = ys, at, weights
        self.tags = np.array([hash(y.tag) for y in ys])
        self.blocks = np.array([hash(tuple(y.blocks)) if y.blocks else 0 for y in ys])
        self.signs = np.array([y.sign for y in ys])
        self.inner = [j for j, y in enumerate(ys) if y.children]
        if weights.kind is not None:
            self.places = {id(ys[j]): j for j in self.inner}
            by_tag: dict[str, list[int]] = {}
            for j in self.inner:
                by_tag.setdefault(ys[j].tag, []).append(j)
            kinds = {t: [weights.as_kind(ys[j]) for j in at] for t, at in by_tag.items()}
            self.kinds = {
                t: (np.array(at), np.array([weights.number[id(k)] for k in kinds[t]]), np.array([k.sign for k in kinds[t]]))
                for t, at in by_tag.items()
            }

    def of(self, x: Node) -> np.ndarray:
        same = self.tags == hash(x.tag)
        out = same.astype(np.int64)
        if x.blocks:
            out += same & (self.blocks == hash(tuple(x.blocks)))
        if x.children and self.weights.kind is None:
            for j in self.inner:
                if same[j] and self.signs[j] != x.sign:
                    out[j] = self.weights.pairs[(id(x), id(self.ys[j]))][0]
        elif x.children and x.tag in self.kinds:
            at, numbers, signs = self.kinds[x.tag]
            kind = self.weights.as_kind(x)
            out[at] = np.where(signs == kind.sign, kind.full, self.weights.row(kind)[numbers])
            for y in self.weights.beside.get((id(x), id(self.at)), ()):
                if id(y) in self.places and y.sign != x.sign:
                    out[self.places[id(y)]] = self.weights.pairs[(id(x), id(y))][0]
        out[self.signs == x.sign] = x.full
        return out


def _heaviest(xs: list[Node], ys: list[Node], at: Node, weights: _Weights) -> int:
    """The weight of the heaviest order-preserving mapping of two child lists."""
    if not xs or not ys:
        return 0
    if len(xs) * len(ys) <= 64:
        best = [0] * (len(ys) + 1)
        for x in xs:
            before, best = best, [0]
            for j, y in enumerate(ys):
                best.append(max(best[j], before[j + 1], before[j] + weights.of(x, y)))
        return best[-1]
    rows, best = _Rows(ys, at, weights), np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        w = rows.of(x)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0)))
    return int(best[-1])


def _matched(xs: list[Node], ys: list[Node], at: Node, weights: _Weights) -> list[tuple[Node, Node]]:
    """The heaviest order-preserving mapping of two child lists, by halving the first one, so that only rows are held."""
    out: list[tuple[Node, Node]] = []
    if not xs or not ys:
        return out
    rows = _Rows(ys, at, weights)

    def last_row(part: list[Node], low: int, high: int, back: bool) -> np.ndarray:
        best = np.zeros(high - low + 1, np.int64)
        for x in reversed(part) if back else part:
            w = rows.of(x)[low:high]
            w = w[::-1] if back else w
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0)))
        return best

    todo = [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, low, high = todo.pop()
        if a >= b or low >= high:
            continue
        if b - a == 1:
            w = rows.of(xs[a])[low:high]
            j = int(w.argmax())
            if w[j]:
                out.append((xs[a], ys[low + j]))
            continue
        middle = (a + b) // 2
        before = last_row(xs[a:middle], low, high, False)
        behind = last_row(xs[middle:b], low, high, True)[::-1]
        cut = low + int((before + behind).argmax())
        todo += [(a, middle, low, cut), (middle, b, cut, high)]
    return out


def _number(root: Node) -> None:
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        node.number, n = n, n + 1
        todo += reversed(node.children)


def _aligned(source: str, reference: Node | None) -> list[tuple[int, bool, int, str]]:
    """(number of the reference's node or -1, whether that has the same text, hash of the path, text) of the blocks of a page."""
    root, blocks = content_blocks(source)
    mapped = align(root, reference) if reference is not None and blocks else {}
    out = []
    for node, text in blocks:
        other = mapped.get(id(node))
        number, same = (-1, False) if other is None else (other.number, other.blocks == node.blocks)
        out.append((number, same, node.path, text))
    return out


@lru_cache(256)
def _reference(source: str) -> Node:
    root, _ = content_blocks(source)
    _number(root)
    return root


def host_of(url: Column) -> Column:
    """Host of an absolute URL, lower case; "" if there is none or the URL is null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _said(block: Column) -> Column:
    """A number for the path and the text of a block."""
    return F.xxhash64(block["path"], block["text"])


_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("same", pa.bool_()), ("path", pa.int64()), ("text", pa.string())]))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` as a last column: the blocks of the main text, one in a line.

    White space inside a block is one space, character references are decoded, nothing is cut. A null or empty page,
    and one without main text, gives "". Pages without a host form one group. Repeated pages count once in the votes,
    so copies of one article do not make it a template. No pages give no rows. A column ``text`` is replaced.
    """
    scratch = Scratch(pages.sparkSession, "html-extract")
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    host = host_of(F.col(url_col))
    fed = pages.select(host.alias("h"), F.col(html_col).alias("x"), F.struct(*kept).alias("page"))
    usable = fed.where(F.length("x") > 0)
    lengths = usable.select("h", F.length("x").alias("n")).groupBy("h").agg(F.percentile_approx("n", 0.5).alias("n"))
    median = usable.withColumn("n", F.length("x")).join(scratch.save(lengths, "lengths"), ["h", "n"])
    references = scratch.save(median.groupBy("h").agg(F.min("x").alias("x")), "references")
    joined = fed.join(references.withColumnRenamed("x", "ref"), "h", "left").select("h", "x", "ref", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 64):
                part = batch.slice(row, 64)
                found = []
                for source, reference in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    blocks = _aligned(source, _reference(reference) if reference else None) if source else []
                    found.append([{"node": n, "same": s, "path": p, "text": t} for n, s, p, t in blocks])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(found, _BLOCKS)], ["h", "page", "blocks"])

    kind = fed.schema["page"].dataType.simpleString()
    blocks = joined.mapInArrow(run, f"h string, page {kind}, blocks array<struct<node:int,same:boolean,path:bigint,text:string>>")
    blocks = scratch.save(blocks, "blocks")
    # A page votes once for each node and for each text at a path; equal pages vote once.
    votes = blocks.select("h", F.xxhash64("blocks.text").alias("digest"), F.inline("blocks")).where("node >= 0")
    votes = votes.groupBy("h", "node", "digest").agg(F.max("same").alias("same"))
    votes = votes.groupBy("h", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("equal"))
    often = lambda equal, n: F.col(equal) >= SAME_SHARE * (F.col(n) + PRIOR)
    fixed = votes.where(often("equal", "n"))
    fixed = scratch.save(fixed.groupBy("h").agg(F.collect_list("node").alias("fixed")), "template")
    said = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), _said(b).alias("said")))
    pages_of = blocks.select("h", F.xxhash64("blocks.text").alias("digest"), F.array_distinct(said).alias("s"))
    pages_of = scratch.save(pages_of.groupBy("h", "digest").agg(F.any_value("s").alias("s")), "said")
    paths = pages_of.select("h", F.explode(F.array_distinct("s.path")).alias("path")).groupBy("h", "path").agg(F.count(F.lit(1)).alias("n"))
    texts = pages_of.select("h", F.inline("s")).groupBy("h", "path", "said").agg(F.count(F.lit(1)).alias("equal"))
    # No text on fewer pages than that reaches the share, whatever number of pages has the path.
    texts = texts.where(F.col("equal") >= SAME_SHARE * PRIOR / (1 - SAME_SHARE)).join(paths, ["h", "path"]).where(often("equal", "n"))
    fixed_texts = scratch.save(texts.groupBy("h").agg(F.collect_list("said").alias("fixed_texts")), "template-texts")
    in_list = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    content = F.filter("blocks", lambda b: ~(b["same"] & in_list("fixed", b["node"]) | in_list("fixed_texts", _said(b))))
    fixed = fixed.join(fixed_texts, "h", "full")
    out = blocks.join(fixed, "h", "left").select("page", F.array_join(F.transform(content, lambda b: b["text"]), "\n").alias("text"))
    return out.select("page.*", "text")
