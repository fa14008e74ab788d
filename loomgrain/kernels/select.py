"""Selectors over a tree: a subset of CSS and of XPath. What is not read is an error, never an empty answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from loomgrain.kernels.tree import Node, squeezed


class BadSelector(ValueError):
    """The selector can't be read."""


Test = Callable[[Node], bool]

_TOKEN = re.compile(
    r"\s*(?P<comb>[>+~,])\s*|(?P<space>\s+)|(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"
    r"|::(?P<read>text|attr\([\w:-]+\))|:(?P<pseudo>[a-z-]+)(?:\((?P<arg>[^()]*)\))?"
)


def _attribute(name: str, op: str | None, want: str) -> Test:
    def test(n: Node) -> bool:
        v = n.get(name)
        if v is None or op is None:
            return v is not None
        return {
            "=": v == want, "~=": want in v.split(), "|=": v == want or v.startswith(want + "-"),
            "^=": bool(want) and v.startswith(want), "$=": bool(want) and v.endswith(want), "*=": bool(want) and want in v,
        }[op]

    return test


def _nth(arg: str) -> Callable[[int], bool]:
    arg = arg.strip().lower().replace(" ", "")
    if arg in ("odd", "even"):
        return lambda k: k % 2 == (arg == "odd")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise BadSelector(f"nth of {arg!r}")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    b = int(m[2] or 0)
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _pseudo(name: str, arg: str | None) -> Test:
    def place(n: Node, alike: bool, back: bool) -> int:
        own = [c for c in (n.parent.children if n.parent else [n]) if not alike or c.tag == n.tag]
        return (own[::-1] if back else own).index(n) + 1

    if name == "not" and arg:
        groups = _css(arg)[0]
        return lambda n: not any(_matches(n, g) for g in groups)
    simple = {"first-child": ("1", False, False), "last-child": ("1", False, True), "first-of-type": ("1", True, False), "last-of-type": ("1", True, True)}
    if name in simple:
        arg, alike, back = simple[name]
    elif name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type") and arg:
        alike, back = name.endswith("type"), "last" in name
    elif name == "empty":
        return lambda n: not n.children and not n.text
    elif name == "contains" and arg:
        want = arg.strip("\"'")
        return lambda n: want in n.words()
    else:
        raise BadSelector(f":{name}")
    fits = _nth(arg or "")
    return lambda n: fits(place(n, alike, back))


#: A compound is its tests; a selector is compounds from the last to the first, each with the sign before it.
Compound = tuple[str, tuple[Test, ...]]


def _css(text: str) -> tuple[list[list[Compound]], str | None]:
    groups: list[list[Compound]] = []
    read: set[str | None] = set()
    parts: list[Compound] = []
    tests: list[Test] = []
    sign, at, own_read = "", 0, None
    text = text.strip()

    def end() -> None:
        nonlocal tests
        if not tests:
            raise BadSelector(text)
        parts.append((sign, tuple(tests)))
        tests = []

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise BadSelector(text)
        at = m.end()
        if own_read is not None and m["comb"] != ",":
            raise BadSelector(text)
        if m["comb"] == ",":
            end()
            groups.append(parts[::-1])
            read.add(own_read)
            parts, sign, own_read = [], "", None
        elif m["comb"]:
            end()
            sign = m["comb"]
        elif m["space"]:
            end()
            sign = " "
        elif m["tag"]:
            tag = m["tag"].lower()
            tests.append((lambda n: True) if tag == "*" else (lambda n, tag=tag: n.tag == tag))
        elif m["id"]:
            tests.append(_attribute("id", "=", m["id"]))
        elif m["cls"]:
            tests.append(_attribute("class", "~=", m["cls"]))
        elif m["attr"]:
            tests.append(_attribute(m["attr"].lower(), m["op"], next((x for x in (m["dq"], m["sq"], m["bare"]) if x is not None), "")))
        elif m["read"]:
            own_read = m["read"]
            if not tests:
                tests.append(lambda n: True)
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
    end()
    groups.append(parts[::-1])
    read.add(own_read)
    if len(read) > 1:
        raise BadSelector(f"its parts read different things: {text}")
    return groups, read.pop()


def _matches(node: Node, compounds: list[Compound]) -> bool:
    sign, tests = compounds[0]
    if not all(t(node) for t in tests):
        return False
    if len(compounds) == 1:
        return True
    rest = compounds[1:]
    if sign == ">":
        return node.parent is not None and _matches(node.parent, rest)
    if sign == " ":
        return any(_matches(a, rest) for a in node.above())
    before = node.parent.children if node.parent is not None else [node]
    before = before[: before.index(node)]
    return any(_matches(b, rest) for b in (before[-1:] if sign == "+" else before))


_STEP = re.compile(r"(?P<axis>//|/)(?:(?P<tag>\*|[A-Za-z][\w-]*)|@(?P<attr>[\w:-]+|\*)|(?P<text>text\(\)))(?P<preds>(?:\[[^\[\]]*\])*)")
_PRED = re.compile(
    r"\[\s*(?:(?P<nth>\d+)|(?P<last>last\(\))|@(?P<has>[\w:-]+)|@(?P<attr>[\w:-]+)\s*=\s*(?P<q>['\"])(?P<want>.*?)(?P=q)"
    r"|contains\(\s*(?:@(?P<cattr>[\w:-]+)|(?P<ctext>text\(\)|\.))\s*,\s*(?P<q2>['\"])(?P<cwant>.*?)(?P=q2)\s*\)|(?:text\(\)|\.)\s*=\s*(?P<q3>['\"])(?P<twant>.*?)(?P=q3))\s*\]"
)


def _xpath(text: str) -> list[tuple[str, str | None, str | None, list[re.Match]]]:
    at, steps = 0, []
    source = text.strip()
    source = source[1:] if source.startswith("./") else source
    while at < len(source):
        m = _STEP.match(source, at)
        if not m:
            raise BadSelector(text)
        at, preds, k = m.end(), [], 0
        while k < len(m["preds"]):
            p = _PRED.match(m["preds"], k)
            if not p:
                raise BadSelector(text)
            preds.append(p)
            k = p.end()
        steps.append((m["axis"], m["tag"], "text()" if m["text"] else m["attr"], preds))
    if not steps or any(s[2] for s in steps[:-1]):
        raise BadSelector(text)
    return steps


def _kept(nodes: list[Node], preds: list[re.Match]) -> list[Node]:
    for p in preds:
        if p["nth"]:
            nodes = nodes[int(p["nth"]) - 1 : int(p["nth"])]
        elif p["last"]:
            nodes = nodes[-1:]
        elif p["has"]:
            nodes = [n for n in nodes if n.get(p["has"]) is not None]
        elif p["attr"]:
            nodes = [n for n in nodes if n.get(p["attr"]) == p["want"]]
        elif p["cattr"]:
            nodes = [n for n in nodes if p["cwant"] in (n.get(p["cattr"]) or "")]
        elif p["ctext"]:
            nodes = [n for n in nodes if p["cwant"] in (n.text if p["ctext"] == "text()" else n.words())]
        else:
            nodes = [n for n in nodes if squeezed(n.words()) == squeezed(p["twant"])]
    return nodes


@lru_cache(maxsize=256)
def compiled(text: str) -> Callable[[Node], list[tuple[str, str]]]:
    """A function that gives (value, where) of all that a selector finds, in document order, as found() reads it."""
    read = found(text)
    return lambda tree: [(v, n.xpath()) for v, n in read(tree)]


@lru_cache(maxsize=256)
def found(text: str) -> Callable[[Node], list[tuple[str, Node]]]:
    """A function that gives (value, element) of all that a selector finds, in document order.

    ``css:`` and ``xpath:`` say which; else what begins with a slash or ``./`` is XPath.
    """
    body = text.strip()
    kind, _, rest = body.partition(":")
    if kind in ("css", "xpath"):
        body = rest.strip()
    else:
        kind = "xpath" if body.startswith(("/", "./", "(")) else "css"
    if not body:
        raise BadSelector("it is empty")
    if kind == "css":
        groups, read = _css(body)

        def css(tree: Node) -> list[tuple[str, Node]]:
            out = []
            for n in tree.iter():
                if any(_matches(n, g) for g in groups):
                    if read is None:
                        out.append((squeezed(n.words()), n))
                    elif read == "text":
                        out += [(t, n) for t in (n.text, *(c.tail for c in n.children)) if t.strip()]
                    elif (v := n.get(read[5:-1].lower())) is not None:
                        out.append((v, n))
            return out

        return css
    steps = _xpath(body)

    def xpath(tree: Node) -> list[tuple[str, Node]]:
        top = Node("#document", {}, None)
        top.children = [tree]
        here, out = [top], []
        for axis, tag, last, preds in steps:
            if last is not None:
                inside = here if axis == "/" else list({id(n): n for h in here for n in h.iter()}.values())
                for n in inside:
                    if n is top:
                        continue
                    if last == "text()":
                        out += [(t, n) for t in (n.text, *(c.tail for c in n.children)) if t.strip()]
                    else:
                        out += [(v, n) for k, v in n.attrs.items() if last in ("*", k)]
                return out
            parents = here if axis == "/" else list({id(n): n for h in here for n in h.iter()}.values())
            held: dict[int, Node] = {}
            for parent in parents:
                for n in _kept([c for c in parent.children if tag in ("*", c.tag)], preds):
                    held[id(n)] = n
            here = sorted(held.values(), key=lambda n: n.order)
        return [(squeezed(n.words()), n) for n in here]

    return xpath
