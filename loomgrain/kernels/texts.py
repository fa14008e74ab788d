"""What a page says and where: its texts and addresses by place, each with the text before it."""

from __future__ import annotations

import re
from collections import Counter

from loomgrain.kernels.induced import facts, label
from loomgrain.kernels.tree import Node, base_of, join, load, squeezed

_SILENT = frozenset("script style template noscript head".split())
#: A label that its text opens: up to a colon, with something behind it.
_OPENS = re.compile(r"^([^:：]{1,60}[:：])\s*(\S.*)$", re.S)


def _shown(tree: Node) -> list[tuple[Node, str]]:
    """Elements that a reader sees, with their paths, in document order."""
    found, stack = [], [(tree, "")]
    while stack:
        node, above = stack.pop()
        if node.tag in _SILENT:
            continue
        own = label(node)
        path = (f"{above}>" if above else "") + (f"{node.tag}.{own}" if own else node.tag)
        found.append((node, path))
        stack.extend((c, path) for c in reversed(node.children))
    return found


def _before(tree: Node) -> dict[int, str]:
    """Of each element, the last text that stands before all that is inside it."""
    found: dict[int, str] = {}
    last, stack = "", [(tree, True)]
    while stack:
        node, enter = stack.pop()
        if not enter:
            last = squeezed(node.tail) or last
            continue
        found[id(node)] = last
        if node.tag not in _SILENT:
            last = squeezed(node.text) or last
            for c in reversed(node.children):
                stack += [(c, False), (c, True)]
    return found


def texts(html: str | None, url: str | None) -> list[dict]:
    """ord, path, form, n_same, depth, value, label and n_label of everything that a page says.

    form: ``text`` of an element, ``rest`` of a text behind the label that opens it, ``address``. n_same counts the places of a path and
    form on the page, n_label those of a label and form.
    """
    tree = load(html)
    base, before, rows = base_of(tree, url), _before(tree), []
    for node, path in _shown(tree):
        for suffix, value in facts(node):
            if suffix:
                rows.append((path + suffix, "address", node.depth, join(base, value), None))
                continue
            rows.append((path, "text", node.depth, value, before[id(node)] or None))
            if opened := _OPENS.match(value):
                rows.append((path, "rest", node.depth, opened[2], opened[1]))
    places = Counter(r[:2] for r in rows)
    labels = Counter((r[1], r[4]) for r in rows)
    return [{"ord": k, "path": p, "form": f, "n_same": places[p, f], "depth": d, "value": v, "label": w, "n_label": labels[f, w] if w else 0} for k, (p, f, d, v, w) in enumerate(rows)]
