"""Pages as trees of block elements with their text blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import xxhash

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot
th thead title tr ul""".split())
#: Their content is no markup; it goes with them.
RAW = frozenset("script style noscript template iframe textarea svg select title object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id or role, that mark what is not main text.
MARKED_TAGS = frozenset("nav aside form footer menu dialog button head".split())
MARKED = frozenset("""ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer comment comments disqus replies cookie cookies consent notice notices popup modal
newsletter subscribe subscription promo promotion sponsor sponsored share sharing social related recommended login
signup search widget toolbar pagination pager contentinfo complementary alert dialog""".split())
#: Words that only say that an element holds something.  Inside an article a
#: name marks an element only if it is made of these and marked words alone.
_HOLDER = frozenset("""area bar block box button buttons container content form frame inline inner link links list outer
section slot thread top bottom unit wrap wrapper""".split())
_HEADER = frozenset(["header", "masthead"])
_ARTICLE = frozenset(["article", "main"])
_NOT_ARTICLE = frozenset("comment comments ad ads sidebar related".split())
#: A start tag of the group closes open ones of the same group.
_SIBLINGS = [frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["td", "th"]), frozenset(["tr"]),
             frozenset(["thead", "tbody", "tfoot"])]


@dataclass
class Node:
    """A block element; neighbours with one label share a node."""

    label: str
    parent: "Node | None" = None
    children: list["Node"] = field(default_factory=list)
    texts: bool = False


@dataclass
class Block:
    node: Node
    text: str
    marked: bool
    article: bool
    linked: bool


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """Blocks of a page in order, and the tree they hang in."""

    def __init__(self, html: str):
        self.root = Node("page")
        self.blocks: list[Block] = []
        # open elements: tag, node, marked, article, is a link
        self._open = [("", self.root, False, False, False)]
        self._text: list[str] = []
        self._link = 0
        self._read(html)
        self._flush()
        self.numbered: dict[int, int] = {}
        self.skeleton = self._name()

    def _name(self) -> str:
        """Labels in order with brackets around children; numbers the nodes."""
        out: list[str] = []
        todo: list[Node | str] = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            self.numbered[id(node)] = len(self.numbered)
            out.append(node.label + ("#" if node.texts else ""))
            if node.children:
                todo.append(")")
                for c in reversed(node.children):
                    todo += [c, ","]
                todo[-1] = "("
        return "".join(out)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, node, marked, article, _ = self._open[-1]
                node.texts = True
                self.blocks.append(Block(node, text, marked, article, self._link >= len(text) > 0))
            self._text, self._link = [], 0

    def _add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if any(x[4] for x in self._open):
            self._link += len(" ".join(text.split()))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._add(html[at:])
                return
            if lt > at:
                self._add(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            if not re.match(r"</?[a-zA-Z]", html[lt:lt + 3]):
                self._add("<")
                at = lt + 1
                continue
            m = _TAG.match(html, lt)
            if m:
                closing, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
            else:  # a stray quote, or the page ends within the tag
                end = html.find(">", lt)
                if end < 0:
                    return
                m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", html[lt:end + 1])
                closing, tag, attrs, at = m[1], m[2].lower(), html[lt + m.end():end], end + 1
            if closing:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\b", re.I).search(html, at)
                at = n if end is None else (html.find(">", end.end()) + 1 or n)
                self._text.append(" ")
            elif tag == "br":
                self._text.append(" ")
            elif tag not in VOID or tag in BLOCK:
                self._start(tag, attrs)

    def _close(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i][0]
            if name == tag:
                if tag in BLOCK or self._open[i][1] is not self._open[i - 1][1]:
                    self._flush()
                del self._open[i:]
                return
            if name in BLOCK and tag not in BLOCK:
                return

    def _start(self, tag: str, attrs: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            # a paragraph, and inline elements above it, end where a block starts
            while len(self._open) > 1 and (self._open[-1][0] not in BLOCK or self._open[-1][0] == "p"):
                self._open.pop()
            for group in _SIBLINGS:
                if tag in group and self._open[-1][0] in group:
                    self._open.pop()
        _, parent, marked, article, _ = self._open[-1]
        words: set[str] = set()
        names: list[list[str]] = []
        hidden = False
        if attrs and attrs.strip():
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if name in ("class", "id", "role"):
                    words.update(_TOKEN.findall(value))
                    names += [_TOKEN.findall(x) for x in value.split()]
                elif name == "style":
                    hidden |= bool(_HIDDEN.search(value))
                else:
                    hidden |= name == "hidden" or value == "true"
        if tag in _ARTICLE:
            marked = marked or hidden or bool(words & _NOT_ARTICLE)
            article = not marked
        elif tag not in ("html", "body"):
            head = not article and (tag in _HEADER or bool(words & _HEADER))
            if article:
                said = any(set(x) <= MARKED | _HOLDER and MARKED.intersection(x) for x in names)
            else:
                said = bool(words & MARKED)
            marked = marked or hidden or head or tag in MARKED_TAGS or said
        node = parent
        if tag == "hr":
            return
        if block or (marked and not self._open[-1][2]):
            if not block:
                self._flush()
            label = tag + ("." + ".".join(sorted(words)) if words else "")
            if parent.children and parent.children[-1].label == label:
                node = parent.children[-1]
            else:
                node = Node(label, parent)
                parent.children.append(node)
        self._open.append((tag, node, marked, article, tag == "a"))


def parse_skeleton(text: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Labels, children and hashes of the paths of a skeleton's nodes, in its
    numbering."""
    labels, children, paths, stack = [], [], [], []
    for token in re.findall(r"[(),]|[^(),]+", text):
        if token == "(":
            stack.append(len(labels) - 1)
        elif token == ")":
            stack.pop()
        elif token != ",":
            i = len(labels)
            label = token.rstrip("#")
            labels.append(label)
            children.append([])
            paths.append(hash64(f"{paths[stack[-1]] if stack else ''}/{label}"))
            if stack:
                children[stack[-1]].append(i)
    return labels, children, paths


class _Kinds:
    """Equal subtrees of two trees have one number: label, children and size."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def of(self, labels: list[str], children: list[list[int]]) -> list[int]:
        out = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):  # children come after their parent
            key = (labels[i], tuple(out[c] for c in children[i]))
            if key not in self.number:
                self.number[key] = len(self.label)
                self.label.append(labels[i])
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[k] for k in key[1]))
            out[i] = self.number[key]
        return out

    def ends(self, x, y) -> tuple[int, int]:
        """Equal children at the beginning and at the end: an optimal matching
        pairs them, as no other partner is worth more."""
        n = min(len(x), len(y))
        i = 0
        while i < n and x[i] == y[i]:
            i += 1
        j = 0
        while j < n - i and x[-1 - j] == y[-1 - j]:
            j += 1
        return i, j


def _rows(worth: dict, x: tuple, y: tuple, keep: bool):
    """The table of simple tree matching by rows: the last one's end, and where
    a cell equals the one above or to the left, if kept."""
    kinds, at = np.unique(np.array(y), return_inverse=True)
    gains: dict[int, np.ndarray] = {}
    row = np.zeros(len(y) + 1, np.int32)
    steps = []
    for u in x:
        if u not in gains:
            gains[u] = np.array([worth.get((u, int(v)), 0) for v in kinds], np.int32)
        new = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains[u][at]), out=new[1:])
        if keep:
            steps.append((np.packbits(new[1:] == row[1:]), np.packbits(new[1:] == new[:-1])))
        row = new
    return int(row[-1]), steps


def align(page: str, reference: str) -> list[int]:
    """For every node of ``page`` the node of ``reference`` that simple tree
    matching pairs it with, or a negative number that stands for its path.

    Works on kinds of equal subtrees, without recursion: equal ends of two
    lists of children are paired at once, the table is filled for the rest."""
    labels, kids, paths = parse_skeleton(page)
    other, other_kids, _ = parse_skeleton(reference)
    k = _Kinds()
    mine, theirs = k.of(labels, kids), k.of(other, other_kids)
    worth: dict[tuple[int, int], int] = {}

    def middle(a: int, b: int) -> tuple[tuple, tuple, int, int]:
        i, j = k.ends(k.kids[a], k.kids[b])
        return k.kids[a][i:len(k.kids[a]) - j], k.kids[b][i:len(k.kids[b]) - j], i, j

    def solve(a: int, b: int) -> None:
        """Fill ``worth`` for a pair of kinds and all pairs below that it needs."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            x, y, i, j = middle(a, b)
            by_label: dict[str, list[int]] = {}
            for v in dict.fromkeys(y):
                by_label.setdefault(k.label[v], []).append(v)
            need = []
            for u in dict.fromkeys(x):
                for v in by_label.get(k.label[u], ()):
                    if u == v:
                        worth[u, v] = k.size[u]
                    elif (u, v) not in worth:
                        need.append((u, v))
            if need:
                todo += need
                continue
            todo.pop()
            if (a, b) not in worth:
                equal = sum(k.size[c] for c in k.kids[a][:i]) + sum(k.size[c] for c in k.kids[a][len(k.kids[a]) - j:])
                worth[a, b] = 1 + equal + (_rows(worth, x, y, False)[0] if x and y else 0)

    slots = [p % (1 << 62) - (1 << 62) - 1 for p in paths]
    todo = [(0, 0)] if labels and other and labels[0] == other[0] else []
    while todo:
        a, b = todo.pop()
        if mine[a] == theirs[b]:
            slots[a:a + k.size[mine[a]]] = range(b, b + k.size[mine[a]])  # the same subtree
            continue
        slots[a] = b
        solve(mine[a], theirs[b])
        x, y, i, j = middle(mine[a], theirs[b])
        pairs = list(zip(kids[a][:i], other_kids[b][:i])) + (list(zip(kids[a][-j:], other_kids[b][-j:])) if j else [])
        if x and y:
            _, steps = _rows(worth, x, y, True)
            p, q = len(x), len(y)
            while p and q:
                above, left = steps[p - 1]
                bit = 7 - (q - 1) % 8
                if above[(q - 1) // 8] >> bit & 1:
                    p -= 1
                elif left[(q - 1) // 8] >> bit & 1:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    pairs.append((kids[a][i + p], other_kids[b][i + q]))
        todo += pairs
    return slots
