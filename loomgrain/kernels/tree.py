"""A forgiving HTML tree on the standard library's tokenizer. It never raises."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the values, up to a boundary.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "body": {"head"},
}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BOUNDS = frozenset("ul ol dl table select td th div article section body html".split())
_IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: A deeper element becomes its parent's sibling, so that no page exhausts the stack.
DEEPEST = 2000


class Node:
    """An element: its tag, attributes, children, the text before its first child and that behind it."""

    __slots__ = ("tag", "attrs", "parent", "children", "text", "tail", "order", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.text = self.tail = ""
        self.order = 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.children.append(self)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def iter(self) -> Iterator[Node]:
        """This element and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def words(self) -> str:
        """All text inside."""
        parts: list[str] = []
        stack: list[tuple[Node, bool]] = [(self, True)]
        while stack:
            node, enter = stack.pop()
            if not enter:
                parts.append(node.tail)
                continue
            parts.append(node.text)
            for child in reversed(node.children):
                stack.append((child, False))
                stack.append((child, True))
        return "".join(parts)

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def xpath(self) -> str:
        """The path down from the root with every step numbered."""
        steps, node = [], self
        while node is not None:
            nth = 1
            if node.parent is not None:
                for other in node.parent.children:
                    if other is node:
                        break
                    nth += other.tag == node.tag
            steps.append(f"{node.tag}[{nth}]")
            node = node.parent
        return "/" + "/".join(reversed(steps))


#: Tags as most are written, which need none of the tokenizer's care; those whose content is raw text are left to it.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&]*")*)>')
_PAIR = re.compile(r' ([a-z-]+)="([^"&]*)"')
_END = re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.open = [self.root]
        self.seen: dict[str, Node] = {"html": self.root}
        self.last: Node | None = None  # the element that text follows

    def _text(self, data: str) -> None:
        if not data:
            return
        if len(self.open) == 1 and data.strip():
            self._body()
        here = self.open[-1]
        if here.children:
            here.children[-1].tail += data
        else:
            here.text += data

    def _body(self) -> None:
        if "body" not in self.seen:
            self._push("body", {})

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.seen.setdefault(tag, node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
        return node

    def _close(self, tags: set[str] | frozenset[str], bounds: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in bounds:
                return

    def parse_starttag(self, i: int) -> int:
        m = _START.match(self.rawdata, i)
        if m is None or m[1] in _RAW:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], _PAIR.findall(m[2]))
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "body", "head") and tag in self.seen:
            for k, v in own.items():
                self.seen[tag].attrs.setdefault(k, v)
            return
        if tag in ("html",):
            self.root.attrs.update(own)
            return
        if tag in _CLOSES:
            bounds = _BOUNDS - _CLOSES[tag] - ({"td", "th"} if tag in ("tr", "tbody", "tfoot", "thead") else set())
            while True:
                before = len(self.open)
                self._close(_CLOSES[tag], bounds)
                if len(self.open) == before:
                    break
        elif tag in _BLOCKS:
            self._close({"p"}, _BOUNDS | {"button"})
        if len(self.open) == 1 and tag not in ("head", "body"):
            if tag in _IN_HEAD and "body" not in self.seen:
                if "head" not in self.seen:
                    self._push("head", {})
            else:
                self._body()
        elif self.open[-1].tag == "head" and tag not in _IN_HEAD and tag != "body":
            self.open.pop()
            self._body()
        self._push(tag, own)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self._text(data)

    def unknown_decl(self, data: str) -> None:
        pass


#: Raw text, in which nothing is a reference, or the sign of a reference that no semicolon ends.
_OPEN = re.compile(r"(<(script|style)\b.*?</\2)|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)", re.I | re.S)


def load(html: str | None, closed: bool = False) -> Node:
    """The tree of a page; an empty one is an ``html`` without children.

    As browsers do, it reads ``&amp`` without its semicolon too; with ``closed`` only references that a semicolon ends are any.
    """
    text = (html or "").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    if closed and "&" in text:
        text = _OPEN.sub(lambda m: m[0] if m[1] else "&amp;", text)
    builder = _Builder()
    try:
        builder.feed(text)
        builder.close()
    except (AssertionError, ValueError):
        pass  # what was read until then is the page
    for k, node in enumerate(builder.root.iter()):
        node.order = k
    return builder.root


def join(base: str | None, address: str) -> str:
    """``address`` seen from ``base``; as it is where the two don't join."""
    address = address.strip(" \t\n\r\f").replace("\t", "").replace("\n", "").replace("\r", "")
    try:
        return urljoin(base or "", address)
    except ValueError:
        return address


def base_of(tree: Node, url: str | None) -> str | None:
    """Where the page's addresses start: its first ``base``, seen from its own address."""
    for node in tree.iter():
        if node.tag == "base" and node.get("href"):
            return join(url, node.get("href") or "")
    return url


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())
