"""The content of a page as Markdown: headings, paragraphs, lists, links, images, code, quotes and tables, without the page's furniture."""

from __future__ import annotations

import re

from loomgrain.kernels.induced import chrome
from loomgrain.kernels.tree import Node, join, squeezed

_SKIP = frozenset("script style template noscript form button svg iframe".split())
_BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tr figure figcaption header dl dt dd hr details summary address".split())


def main_of(tree: Node) -> Node:
    """The element that holds the content: ``main`` or the article with most words, else the body."""
    found = [n for n in tree.iter() if n.tag in ("main", "article")]
    return max(found, key=lambda n: (len(n.words()), -n.order)) if found else next((n for n in tree.iter() if n.tag == "body"), tree)


def _inline(node: Node, base: str | None) -> str:
    parts = [node.text]
    for c in node.children:
        if c.tag in _SKIP or chrome(c):
            inner = ""
        elif c.tag == "br":
            inner = "\n"
        elif c.tag == "img":
            inner = f"![{squeezed(c.get('alt'))}]({join(base, c.get('src') or '')})" if c.get("src") else ""
        else:
            inner = _inline(c, base)
            text = inner.strip()
            if text and c.tag in ("b", "strong"):
                inner = f"**{text}**"
            elif text and c.tag in ("i", "em"):
                inner = f"*{text}*"
            elif text and c.tag == "code":
                inner = f"`{text}`"
            elif text and c.tag == "a" and c.get("href"):
                inner = f"[{text}]({join(base, c.get('href') or '')})"
        parts += [inner, c.tail]
    return re.sub(r"[ \t\r\f]*\n[ \t\r\f]*", "\n", re.sub(r"[ \t\r\f]+", " ", "".join(parts).replace("\n", " ") if node.tag != "pre" else "".join(parts)))


def _blocks(node: Node, base: str | None, out: list[str], depth: int) -> None:
    run: list[Node | str] = [node.text]

    def flush() -> None:
        holder = Node("span", {}, None)
        for x in run:
            if isinstance(x, str):
                if holder.children:
                    holder.children[-1].tail += x
                else:
                    holder.text += x
            else:
                copy = Node(x.tag, x.attrs, holder)
                copy.text, copy.children, copy.tail = x.text, x.children, ""
        text = _inline(holder, base).strip()
        if text:
            out.append(text)
        run.clear()

    for c in node.children:
        if c.tag in _SKIP or chrome(c):
            run.append(c.tail)
            continue
        if c.tag not in _BLOCK:
            run += [c, c.tail]
            continue
        flush()
        if re.fullmatch("h[1-6]", c.tag):
            if text := squeezed(_inline(c, base)):
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate(x for x in c.children if x.tag == "li"):
                inner: list[str] = []
                _blocks(li, base, inner, depth + 1)
                mark = f"{k + 1}." if c.tag == "ol" else "-"
                if inner:
                    items.append(f"{mark} " + "\n".join(inner).replace("\n", "\n" + " " * (len(mark) + 1)))
            if items:
                out.append("\n".join(items))
        elif c.tag == "pre":
            out.append("```\n" + c.words().strip("\n") + "\n```")
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "blockquote":
            inner = []
            _blocks(c, base, inner, depth + 1)
            out.append("\n".join("> " + line for line in "\n\n".join(inner).split("\n")))
        elif c.tag == "table":
            rows = [[squeezed(x.words()).replace("|", r"\|") for x in tr.children if x.tag in ("td", "th")] for tr in c.iter() if tr.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif depth < 200:
            _blocks(c, base, out, depth + 1)
        run.append(c.tail)
    flush()


def markdown(tree: Node, base: str | None) -> str:
    out: list[str] = []
    _blocks(main_of(tree), base, out, 0)
    return "\n\n".join(out)
