"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree in which runs of like leaf siblings are one node. For each host one reference tree is
chosen (the most frequent one, of median size among equals), the trees of all its pages are aligned with it by
simple tree matching, and texts are pooled by the reference's nodes. Nodes whose text is the same on most pages are
template; the content is the subtree that holds most of the text that varies and is no link. ``article`` and ``main``
only break ties and keep the descent from going below them. Inside the content, template texts and parts with a
boilerplate role (menus, headers, footers, sidebars, notices, adverts, forms, comments) are left out.

Pages of a host whose longest text is the same are copies and count once, so that copies do not turn their article
into template. What is learned of a host is a sum over all its distinct pages, so it does not depend on how rows are
partitioned, and a host with very many pages is never gathered in one task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Cells of a table of two lists of children; longer lists are halved first.
TABLE_CELLS = 1 << 20
#: Texts held by a task before it writes their sums.
HELD_TEXTS = 200_000
#: Up to so many characters, the wrappers of all hosts are broadcast; else pages are shuffled by host.
MOST_BROADCAST = 32_000_000
#: Share of the varying text that a child must hold to be entered; against a marked sibling it must hold more.
ENTERS, ENTERS_AGAINST_MARK = 0.7, 0.9
#: With fewer distinct pages nothing can be told to be template.
LEAST_PAGES = 3

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select noembed noframes xmp".split())
#: Elements whose content is text to the very end of the page if they are not closed.
TEXT_ONLY = frozenset("script style textarea title xmp".split())
#: Follows the label of an element that is marked as content by role or item property.
MARK = "!"
LEFT_OUT = frozenset("head nav header footer aside form button dialog menu fieldset audio video canvas map datalist".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tooltip status".split())
#: Whole class or id tokens that leave an element out, unless it holds most of the content's text.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation "
    "breadcrumb breadcrumbs footer foot header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social widget widgets respond pagination pager tags toc disclaimer".split()
)
#: First parts of hyphenated tokens that leave out as well.
LEFT_OUT_STEMS = frozenset("advert adverts advertisement advertising adsense sponsored cookie cookies gdpr newsletter breadcrumb breadcrumbs disqus pagination".split())
#: Whole tokens of readers' comments and teasers: left out of the induction too, as their text varies from page to page.
FIRM = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
#: Leaves of running text; beside the content they belong to it if they vary.
PROSE = frozenset("p h1 h2 h3 h4 blockquote pre ul ol dl".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends, up to the containers named second.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr"), ("table",)), "body": (("head",), ()),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[-_]")


#: How an element is left out by its class or id.
NO, NAMED, ALWAYS = range(3)


def _named(value: str) -> int:
    """By a class or id: ALWAYS by a firm name, NAMED by another."""
    tokens = set(value.split())
    if not FIRM.isdisjoint(tokens):
        return ALWAYS
    if not LEFT_OUT_NAMES.isdisjoint(tokens):
        return NAMED
    return NAMED if any(_PART.split(t, maxsplit=1)[0] in LEFT_OUT_STEMS for t in tokens) else NO


def _flags(attrs: str) -> tuple[str, bool, int, bool]:
    """(label, is left out, how it is left out by name, is main) of a tag's attributes."""
    label, out, named, main = "", False, NO, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            out = True
        elif name == "style":
            out |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        elif name == "role":
            out |= value in LEFT_OUT_ROLES
            main |= value == "main"
        elif name == "itemprop":
            main |= value == "articlebody"
        else:
            if name == "class":
                label = " ".join(sorted(set(_WORD.findall(value))))
            named = max(named, _named(value))
    return label, out, named, main


@lru_cache(maxsize=256)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.I)


class _Skipper:
    """Finds the ends of elements that are passed over whole."""

    def __init__(self, source: str):
        self.source, self.unbalanced, self.last = source, set(), {}

    def after(self, name: str, pos: int) -> int | None:
        """Where the element ends whose opening tag ends at pos; None if it is never closed."""
        if name in TEXT_ONLY or name in self.unbalanced:
            return self._next_close(name, pos)
        open_tags = 1
        for m in _ends(name).finditer(self.source, pos):
            open_tags += -1 if m[1] else 1
            if not open_tags:
                return self._tag_end(m.start())
        self.unbalanced.add(name)  # from here on the next closing tag ends it, so that no tag is searched in vain again
        return self._next_close(name, pos)

    def _next_close(self, name: str, pos: int) -> int | None:
        if self.last.get(name, -1) > pos:
            return None
        for m in _ends(name).finditer(self.source, pos):
            if m[1]:
                return self._tag_end(m.start())
        self.last[name] = len(self.source) + 1
        return None

    def _tag_end(self, at: int) -> int:
        end = self.source.find(">", at)
        return end + 1 if end >= 0 else len(self.source)


class Page:
    """The DOM of a page: structural nodes, and text blocks (node, text, characters not in links) in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.out, self.named = [-1], ["#root"], ["#root"], [False], [NO]
        self.kids: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, buffer, at = [0], [], 0
        tags, pos, n = self.tag, 0, len(source)
        opened: Counter = Counter()  # names on the stack, so that it is not searched in vain
        skipper, in_link, linked = _Skipper(source), False, 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text, max(0, len(text) - linked)))
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            buffer.append(text)
            if in_link:
                linked += len(text)

        def pop_from(i: int) -> None:
            opened.subtract(tags[node] for node in stack[i:])
            del stack[i:]

        def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
            if not any(opened[name] for name in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                t = tags[stack[i]]
                if t in stop:
                    return
                if t in names:
                    pop_from(i)
                    return

        while pos < n:
            at = source.find("<", pos)
            if at < 0:
                say(source[pos:])
                break
            if at > pos:
                say(source[pos:at])
            m = _TAG.match(source, at)
            if m is None:
                say("&lt;")
                pos = at + 1
                continue
            pos = m.end()
            if m["name"] is None:
                if m["cdata"]:
                    say(m["cdata"])
                continue
            name = m["name"].lower()
            if m["end"]:
                if name == "br":
                    flush()
                elif name == "a":
                    in_link = False
                elif name not in INLINE and name not in VOID:
                    flush()
                    in_link = False
                    for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                        if tags[stack[i]] == name:
                            pop_from(i)
                            break
                continue
            if name in RAW:
                if not m["attrs"].endswith("/"):
                    end = skipper.after(name, pos)
                    pos = end if end is not None else n if name in TEXT_ONLY else pos
                continue
            if name == "a":
                in_link = True
            if name in INLINE and not m["attrs"]:
                continue
            label, out, named, main = _flags(m["attrs"]) if m["attrs"] else ("", False, NO, False)
            if name in INLINE:
                if (out or named) and name not in VOID:
                    pos = skipper.after(name, pos) or pos
                    in_link = in_link and name != "a"
                continue
            flush()
            if name in VOID:
                continue
            if name in CLOSES_P:
                close(("p",), ("td", "th", "li", "button", "article", "section", "div", "main", "body"))
            if name in IMPLIED:
                close(*IMPLIED[name])
            up = stack[-1]
            if name in ("html", "body"):
                out, named = False, NO
            node = len(tags)
            tags.append(name)
            self.parent.append(up)
            self.label.append(f"{name}.{label}" * bool(label) or name)
            if main and name not in ("article", "main"):
                self.label[-1] += MARK
            self.out.append(self.out[up] or out or named == ALWAYS or name in LEFT_OUT)
            self.named.append(named)
            self.kids.append([])
            self.kids[up].append(node)
            stack.append(node)
            opened[name] += 1
        flush()

    def skeleton(self) -> tuple[tuple, list[int]]:
        """(tree, node of the tree for each node of the page): like leaf siblings in a row are one node. A tree is
        (labels, parents) in page order."""
        labels, parents, of = ["#root"], [-1], [0] * len(self.tag)
        last: dict[int, tuple[str, int] | None] = {}
        for node in range(1, len(self.tag)):
            up, leaf = of[self.parent[node]], not self.kids[node]
            before = last.get(up)
            if leaf and before is not None and before[0] == self.label[node]:
                of[node] = before[1]
                continue
            of[node] = len(labels)
            labels.append(self.label[node])
            parents.append(up)
            last[up] = (self.label[node], of[node]) if leaf else None
        return (tuple(labels), tuple(parents)), of

    def pooled(self, of: list[int]) -> list[tuple[int, int, int]]:
        """(skeleton node, digest of its texts, their characters not in links) of the nodes with kept text."""
        parts: dict[int, list[str]] = {}
        plain: Counter = Counter()
        for node, text, size in self.blocks:
            if not self.out[node]:
                parts.setdefault(of[node], []).append(text)
                plain[of[node]] += size
        return [(k, _digest("\n".join(x)), plain[k]) for k, x in parts.items()]

    def text_in(self, inside: set[int], template: set[int] = frozenset()) -> str:
        """The kept blocks under the page's nodes ``inside`` joined by newlines, without those of the nodes
        ``template`` and without named parts that hold no more than half of the text."""
        n = len(self.tag)
        under, size = [False] * n, [0] * n
        for node in range(n):
            under[node] = node in inside or (node > 0 and under[self.parent[node]])
        kept = [(node, text) for node, text, _ in self.blocks if under[node] and not self.out[node] and node not in template]
        if any(how and under[node] and node not in inside for node, how in enumerate(self.named)):
            for node, text in kept:
                size[node] += len(text)
            whole = sum(size)
            for node in range(n - 1, 0, -1):
                size[self.parent[node]] += size[node]
            out = [False] * n
            for node in range(1, n):
                up = self.parent[node]
                out[node] = under[up] and (out[up] or (self.named[node] and node not in inside and 2 * size[node] <= whole))
            kept = [(node, text) for node, text in kept if not out[node]]
        return "\n".join(text for _, text in kept)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _children(tree: tuple) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in tree[0]]
    for node, up in enumerate(tree[1]):
        if up >= 0:
            kids[up].append(node)
    return kids


def _kinds(trees: list[tuple]) -> tuple[list[list[int]], list[list[int]], list[str], list[int]]:
    """(kind of each node of each tree, kinds of each kind's children, its label, its size): equal subtrees are of
    one kind."""
    number: dict[tuple, int] = {}
    below: list[list[int]] = []
    labels: list[str] = []
    sizes: list[int] = []
    out = []
    for tree in trees:
        kids, kinds = _children(tree), [0] * len(tree[0])
        for node in range(len(kinds) - 1, -1, -1):  # parents stand before their children
            under = [kinds[k] for k in kids[node]]
            key = (tree[0][node], *under)
            if key not in number:
                number[key] = len(below)
                below.append(under)
                labels.append(tree[0][node])
                sizes.append(1 + sum(sizes[k] for k in under))
            kinds[node] = number[key]
        out.append(kinds)
    return out, below, labels, sizes


def tree_match(a: tuple, b: tuple) -> dict[int, int]:
    """Simple tree matching of two (labels, parents) trees: node of b -> node of a in a largest order-preserving
    match of like-labelled nodes. Empty if the roots differ. Scores are kept for pairs of unlike subtrees only, and
    a table of two lists of children only while it is read."""
    (of_a, of_b), below, labels, sizes = _kinds([a, b])
    scores: dict[tuple[int, int], int] = {}

    def score(i: int, j: int) -> int:
        return sizes[i] if i == j else scores[i, j] if labels[i] == labels[j] else 0

    def last_row(left: list[int], right: list[int], table: list | None = None) -> np.ndarray:
        """Best scores of all of left with each head of right; rows go to table."""
        codes, at = np.unique(np.array(right, np.int64), return_inverse=True)
        weights = {x: np.array([score(x, y) for y in codes.tolist()], np.int64)[at] for x in set(left)}
        row = np.zeros(len(right) + 1, np.int64)
        for x in left:
            if table is not None:
                table.append(row)
            new = np.zeros_like(row)
            new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x]))
            row = new
        if table is not None:
            table.append(row)
        return row

    def ends(left: list[int], right: list[int]) -> tuple[int, int]:
        """Lengths of the like heads and like tails, which some largest match pairs off."""
        n, head, tail = min(len(left), len(right)), 0, 0
        while head < n and left[head] == right[head]:
            head += 1
        while tail < n - head and left[-1 - tail] == right[-1 - tail]:
            tail += 1
        return head, tail

    def best(left: list[int], right: list[int]) -> int:
        head, tail = ends(left, right)
        equal = sum(sizes[x] for x in left[:head] + left[len(left) - tail :])
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if len(left) * len(right) > 64:
            return equal + int(last_row(left, right)[-1])
        row = [0] * (len(right) + 1)
        for x in left:
            new = [0]
            for y, k in enumerate(right):
                new.append(max(row[y + 1], new[y], row[y] + score(x, k)))
            row = new
        return equal + row[-1]

    def pairs(left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """Positions that a largest match of two lists pairs off."""
        out, parts = [], [(0, len(left), 0, len(right))]
        while parts:
            x0, x1, y0, y1 = parts.pop()
            head, tail = ends(left[x0:x1], right[y0:y1])
            out += [(x0 + k, y0 + k) for k in range(head)] + [(x1 - 1 - k, y1 - 1 - k) for k in range(tail)]
            x0, x1, y0, y1 = x0 + head, x1 - tail, y0 + head, y1 - tail
            if x0 == x1 or y0 == y1:
                continue
            some, others = left[x0:x1], right[y0:y1]
            if len(some) > 1 and len(some) * len(others) > TABLE_CELLS:
                half = len(some) // 2
                cut = int(np.argmax(last_row(some[:half], others) + last_row(some[:half - 1 : -1], others[::-1])[::-1]))
                parts += [(x0, x0 + half, y0, y0 + cut), (x0 + half, x1, y0 + cut, y1)]
                continue
            table: list[np.ndarray] = []
            last_row(some, others, table)
            x, y = len(some), len(others)
            while x and y:
                w = score(some[x - 1], others[y - 1])
                if w and table[x][y] == table[x - 1][y - 1] + w:
                    out.append((x0 + x - 1, y0 + y - 1))
                    x, y = x - 1, y - 1
                elif table[x][y] == table[x - 1][y]:
                    x -= 1
                else:
                    y -= 1
        return out

    if labels[of_a[0]] != labels[of_b[0]]:
        return {}
    waiting = [(of_a[0], of_b[0])]
    while waiting:
        i, j = waiting[-1]
        if i == j or (i, j) in scores:
            waiting.pop()
            continue
        need = [(x, y) for x in set(below[i]) for y in set(below[j]) if x != y and labels[x] == labels[y] and (x, y) not in scores]
        if need:
            waiting += need
        else:
            scores[i, j] = 1 + best(below[i], below[j])
            waiting.pop()
    kids_a, kids_b = _children(a), _children(b)
    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[j] = i
        todo += [(kids_a[i][x], kids_b[j][y]) for x, y in pairs(below[of_a[i]], below[of_b[j]])]
    return out


def pack_tree(tree: tuple) -> str:
    """A tree as text: a line (parent, label) for each node."""
    return "\n".join(f"{up} {label}" for label, up in zip(*tree, strict=True))


@lru_cache(maxsize=1024)
def unpack_tree(packed: str) -> tuple:
    rows = [line.split(" ", 1) for line in packed.split("\n")]
    return tuple(r[1] for r in rows), tuple(int(r[0]) for r in rows)


@lru_cache(maxsize=4096)
def _aligned(reference: str, tree: str) -> dict[int, int]:
    """Node of tree -> node of reference; equal trees are aligned by identity."""
    if reference == tree:
        return {k: k for k in range(reference.count("\n") + 1)}
    return tree_match(unpack_tree(reference), unpack_tree(tree))


def summary(source: str | None) -> tuple[int, int, str, list[tuple[int, int, int]]] | None:
    """(key, order, packed tree, pooled texts) of a page; None if it has no kept text. Pages with one key are copies,
    of which the least in order stands for all."""
    page = Page(source or "")
    tree, of = page.skeleton()
    texts = page.pooled(of)
    if not texts:
        return None
    packed = pack_tree(tree)
    longest = min(texts, key=lambda t: (-t[2], t[1]))
    return longest[1], _digest(packed + repr(texts)), packed, texts


def median_of_most_frequent(sizes: Iterable[tuple[int, int, int]]) -> int:
    """The median size of the most frequent trees; sizes: (size, highest frequency there, trees that have it)."""
    sizes = sorted(sizes)
    most = max(n for _, n, _ in sizes)
    often = [(size, trees) for size, n, trees in sizes if n == most]
    place = sum(trees for _, trees in often) // 2
    for size, trees in often:
        if place < trees:
            return size
        place -= trees
    raise AssertionError("the median lies within the sizes")


def _is_marked(label: str) -> bool:
    return label.endswith(MARK) or _tag_of(label) in ("article", "main")


def _tag_of(label: str) -> str:
    return label.partition(".")[0].rstrip(MARK)


def induce(reference: str, nodes: Iterable[tuple[int, int, int, int]], pages: int) -> tuple[list[int], dict[int, int]]:
    """The wrapper of a host: (nodes of the reference tree that hold the content, digest of the template text of each
    template node).

    nodes: (node, characters not in links, digest of its most frequent text, pages with that text), summed over
    ``pages`` distinct pages. From the root down the child is entered that holds ENTERS of the varying text (of all
    text, if hardly any varies); a child beside one with a mark needs more. Among children of which none holds as much,
    the one with all marks, or else all first-level headings, is entered. The descent ends at an article, at another
    mark that does not hold just one article, and above leaves that do not hold everything.
    """
    tree = unpack_tree(reference)
    labels, parents = tree
    n = len(labels)
    nodes = list(nodes)
    template = {node: digest for node, _, digest, same in nodes if pages >= LEAST_PAGES and 2 * same > pages}
    whole, varying = [0.0] * n, [0.0] * n
    for node, chars, _, _ in nodes:
        whole[node] = float(chars)
        if node not in template:
            varying[node] = float(chars)
    own = varying if sum(varying) > 0.2 * sum(whole) else whole
    if own is whole:
        template = {}
    mass = own[:]
    marks, articles, heads = ([0] * n for _ in range(3))
    kept = [False] * n
    for node, *_ in nodes:
        kept[node] = True
    for node in range(n - 1, -1, -1):
        if kept[node]:  # only what holds kept text counts
            marks[node] += _is_marked(labels[node])
            articles[node] += _tag_of(labels[node]) == "article"
            heads[node] += _tag_of(labels[node]) == "h1"
        if node:
            up = parents[node]
            mass[up] += mass[node]
            kept[up] |= kept[node]
            marks[up] += marks[node]
            articles[up] += articles[node]
            heads[up] += heads[node]
    kids, at, path = _children(tree), 0, []
    while mass[at]:
        if _tag_of(labels[at]) == "article" or (_is_marked(labels[at]) and articles[at] != 1):
            path = []  # the mark holds all of the content
            break
        best = max(kids[at], key=lambda k: mass[k], default=None)
        if best is None:
            break
        with_marks = [k for k in kids[at] if marks[k] and mass[k]]
        need = ENTERS_AGAINST_MARK if with_marks and best not in with_marks else ENTERS
        if mass[best] < need * mass[at]:
            with_heads = [k for k in kids[at] if heads[k] and mass[k]]
            if len(with_marks) == 1:
                best = with_marks[0]
            elif not with_marks and len(with_heads) == 1 and kids[with_heads[0]]:
                best = with_heads[0]
            else:
                break
        if not kids[best] and own[best] < mass[at] and not _is_marked(labels[best]):
            break
        path.append(at)
        at = best
    told = PROSE if pages >= LEAST_PAGES else ("h1", "h2")
    beside = [k for up in path for k in kids[up] if not kids[k] and own[k] and _tag_of(labels[k]) in told]
    return [at, *beside], template


def content(source: str | None, wrapper: tuple[str, list[int], dict[int, int]] | None) -> str:
    """The main text of a page by the wrapper (reference, content nodes, template) of its host. A page that has none of
    the content nodes, or whose host's content is all of its body, is its own reference for the texts that are no
    template."""
    page = Page(source or "")
    tree, of = page.skeleton()
    texts = page.pooled(of)
    if not texts:
        return ""
    packed = pack_tree(tree)
    reference, slots, template = wrapper or (packed, [0], {})
    to = _aligned(reference, packed)
    constant = {k for k, digest, _ in texts if template.get(to.get(k)) == digest}
    wanted = set(slots)
    inside = {node for node, k in enumerate(of) if to.get(k) in wanted}
    if not inside or _tag_of(unpack_tree(reference)[0][slots[0]]) in ("#root", "html", "body"):
        wanted = set(induce(packed, [(k, chars, digest, 1) for k, digest, chars in texts if k not in constant], 1)[0])
        inside = {node for node, k in enumerate(of) if k in wanted}
    return page.text_in(inside, {node for node, k in enumerate(of) if k in constant})


def extract_run(sources: list[str | None]) -> list[str]:
    """Main texts of all pages of one host; what extract gives for them."""
    pages: dict[int, tuple] = {}
    for found in map(summary, sources):
        if found is not None and (found[0] not in pages or found[1:] < pages[found[0]]):
            pages[found[0]] = found[1:]
    if not pages:
        return [""] * len(sources)
    trees = Counter(packed for _, packed, _ in pages.values())
    most: dict[int, tuple[int, int]] = {}
    for packed, n in trees.items():
        size = packed.count("\n") + 1
        before = most.get(size, (0, 0))
        most[size] = (n, 1) if n > before[0] else (n, before[1] + 1) if n == before[0] else before
    size = median_of_most_frequent((size, n, same) for size, (n, same) in most.items())
    reference = min(p for p, n in trees.items() if p.count("\n") + 1 == size and n == most[size][0])
    pooled: Counter = Counter()
    for _, packed, texts in pages.values():
        to = _aligned(reference, packed)
        pooled.update((to[k], digest, chars) for k, digest, chars in texts if k in to)
    digests: dict[int, Counter] = {}
    plain: Counter = Counter()
    for (node, digest, chars), n in pooled.items():
        digests.setdefault(node, Counter())[digest] += n
        plain[node] += chars * n
    nodes = []
    for node, seen in digests.items():
        same, digest = max((n, d) for d, n in seen.items())
        nodes.append((node, plain[node], digest, same))
    wrapper = (reference, *induce(reference, nodes, len(pages)))
    return [content(s, wrapper) for s in sources]


_TEXTS = pa.list_(pa.struct([("node", pa.int32()), ("digest", pa.int64()), ("chars", pa.int64())]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) -> (host, key, ord, tree, texts), copies in a task once."""
    held: dict[tuple, tuple] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        keys, parts = list(zip(*held, strict=True)), list(zip(*held.values(), strict=True))
        texts = [[{"node": k, "digest": d, "chars": c} for k, d, c in x] for x in parts[2]]
        columns = [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.string()), pa.array(texts, _TEXTS)]
        return pa.record_batch(columns, names=["host", "key", "ord", "tree", "texts"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = summary(source.as_py())
            if found is None:
                continue
            key = (host, found[0])
            if key not in held or found[1:] < held[key]:
                size += len(found[3]) if key not in held else 0
                held[key] = found[1:]
            if size >= HELD_TEXTS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, reference, tree, texts) -> (host, node, digest, chars, n) by nodes of the reference."""
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        columns = [*zip(*held, strict=True), list(held.values())]
        return pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["host", "node", "digest", "chars", "n"])

    for batch in batches:
        for host, reference, tree, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            to = _aligned(reference, tree)
            held.update((host, to[t["node"]], t["digest"], t["chars"]) for t in texts if t["node"] in to)
            if len(held) >= HELD_TEXTS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def _each(fn: Callable, names: list[str], kinds: list[pa.DataType]) -> Callable:
    """An Arrow map that applies fn to the values of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)]
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, reference, slots, template), a row for each host of pages (host, html) that has a page with text.

    A host's rows meet by partial sums only: its distinct pages are aligned with its reference wherever they lie, and
    lists are collected by distinct sizes of trees and by nodes of the reference.
    """
    made = pages.select("host", "html").mapInArrow(_summaries, "host string, key long, ord long, tree string, texts array<struct<node:int,digest:long,chars:long>>")
    distinct = cut(made.groupBy("host", "key").agg(F.min(F.struct("ord", "tree", "texts")).alias("page")).select("host", "page.tree", "page.texts"))
    size = F.size(F.split("tree", "\n")).alias("size")
    trees = distinct.groupBy("host", size, "tree").agg(F.count("*").alias("n"))
    best = trees.groupBy("host", "size").agg(F.min(F.struct(-F.col("n"), "tree")).alias("best"), F.max("n").alias("n"))
    ties = trees.groupBy("host", "size", "n").agg(F.count("*").alias("trees"))  # how many trees of a size are as frequent
    sizes = cut(best.join(ties, ["host", "size", "n"]).select("host", "size", "n", "trees", F.col("best.tree").alias("reference")))
    chosen = sizes.groupBy("host").agg(F.collect_list(F.struct("size", "n", "trees")).alias("sizes"))
    median = _each(lambda host, rows: (host, median_of_most_frequent((r["size"], r["n"], r["trees"]) for r in rows)), ["host", "size"], [pa.string(), pa.int32()])
    references = cut(sizes.join(chosen.mapInArrow(median, "host string, size int"), ["host", "size"]).select("host", "reference"))
    counts = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    pooled = distinct.join(references, "host").select("host", "reference", "tree", "texts").mapInArrow(_pooled, "host string, node long, digest long, chars long, n long")
    by_text = pooled.groupBy("host", "node", "digest").agg(F.sum("n").alias("n"), F.sum(F.col("chars") * F.col("n")).alias("chars"))
    by_node = by_text.groupBy("host", "node").agg(F.sum("chars").alias("chars"), F.max(F.struct("n", "digest")).alias("top"))
    nodes = by_node.groupBy("host").agg(F.collect_list(F.struct("node", "chars", F.col("top.digest").alias("digest"), F.col("top.n").alias("same"))).alias("nodes"))

    def wrapper(host: str, reference: str, pages: int, rows: list[dict]) -> tuple:
        slots, template = induce(reference, sorted((r["node"], r["chars"], r["digest"], r["same"]) for r in rows or ()), pages)
        return host, reference, slots, list(template.items())

    found = references.join(counts, "host").join(nodes, "host", "left").select("host", "reference", "pages", "nodes")
    return found.mapInArrow(
        _each(wrapper, ["host", "reference", "slots", "template"], [pa.string(), pa.string(), pa.list_(pa.int64()), pa.map_(pa.int64(), pa.int64())]),
        "host string, reference string, slots array<long>, template map<long,long>",
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages.

    Null and empty pages, and pages without content, have an empty text. Pages without a host in their url count as
    pages of one host. Repeated rows stay repeated; null ids stay. Ties between reference trees go to the least, those
    between children to the first. An empty table gives no rows. Pages are read twice and, unless the wrappers of all
    hosts are too large to broadcast, not shuffled.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    learned = cut(wrappers(rows))
    held = learned.agg(F.sum(F.length("reference") + 8 * F.size("slots") + 16 * F.size("template"))).first()[0] or 0
    learned = learned.withColumnRenamed("host", "__host")
    dealt = rows.join(F.broadcast(learned) if held <= MOST_BROADCAST else learned, F.col("host") == F.col("__host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, reference, slots, template in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                wrapper = (reference.as_py(), slots.as_py(), dict(template.as_py())) if reference.is_valid else None
                texts.append(content(source.as_py(), wrapper))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return dealt.select("page_id", "url", "html", "reference", "slots", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
