"""What a page shows its readers, where it declares nothing: title, author and dates, each with the rule that found it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from loomgrain.kernels.induced import chrome
from loomgrain.kernels.tree import Node, squeezed

Guess = tuple[str, str, str, str]  # question, value, rule, place

_BYLINE = re.compile(r"(?i)(?:^|[\s_-])(?:byline|author|post-author|entry-author|article-author)(?:$|[\s_-])")
_BY = re.compile(r"^(?:by|von|par|por|di|door|av|af)\s+(.+)$", re.I)
_PARTICLES = frozenset("de da do dos di del della der den van von la le el al bin ibn y e of du".split())
_ROLES = frozenset("editor staff reporter correspondent writer contributor team desk admin news".split())
_DATE_CLASS = re.compile(r"(?i)(?:^|[\s_-])(?:date|published|pubdate|posted|timestamp|entry-date|post-date)(?:$|[\s_-])")
_MODIFIED = re.compile(r"(?i)\b(?:updated|modified|last\s+edited)\b")
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?")
_WRITTEN = re.compile(r"(?:[A-Z][a-zé]{2,8}\.?\s+\d{1,2},\s+\d{4}|\d{1,2}\.?\s+(?:de\s+)?[A-Za-zéäû]{3,10}\.?\s+(?:de\s+)?\d{4})")
_URL_DATE = re.compile(r"/((?:19|20)\d{2})/(0[1-9]|1[0-2])(?:/(0[1-9]|[12]\d|3[01]))(?:/|$)")


def person(text: str) -> str | None:
    """A byline as a person's name: two to five words, each begun with a capital unless a particle, no role."""
    text = squeezed(text)
    if found := _BY.match(text):
        text = found[1]
    text = re.split(r"\s*(?:[,|•·–—]|\s-\s)\s*", text)[0].strip(" .:")
    words = text.split()
    if not 2 <= len(words) <= 5 or any(c.isdigit() or c in "@/" for c in text):
        return None
    if any(w.lower().strip(".") in _ROLES for w in words):
        return None
    return text if all(w[0].isupper() or w.lower() in _PARTICLES for w in words) else None


def _shown(tree: Node) -> Iterator[Node]:
    stack = [tree]
    while stack:
        n = stack.pop()
        if n.tag in ("script", "style", "template") or chrome(n) and n.tag != "head":
            continue
        if n.tag == "head":
            continue
        yield n
        stack.extend(reversed(n.children))


def _date(text: str) -> str | None:
    found = _ISO.search(text) or _WRITTEN.search(text)
    return squeezed(found[0]) if found else None


def guesses(tree: Node, url: str | None) -> list[Guess]:
    """The first guess of each question in order of rules."""
    nodes = list(_shown(tree))
    out: dict[str, Guess] = {}

    def say(question: str, value: str | None, rule: str, where: str) -> None:
        if value and question not in out:
            out[question] = (question, value, rule, where)

    heads = [n for n in nodes if n.tag == "h1" and squeezed(n.words())]
    if len(heads) == 1:
        say("title", squeezed(heads[0].words()), "sole-h1", heads[0].xpath())
    for n in nodes:
        if n.tag in ("a", "link") and "author" in (n.get("rel") or "").lower().split():
            say("author", person(n.words()), "rel-author", n.xpath())
    for n in nodes:
        if _BYLINE.search(n.get("class") or "") or (n.get("itemprop") or "") == "author":
            say("author", person(n.words()), "byline", n.xpath())
    for n in nodes:
        own = squeezed(n.text)
        if own[:3].lower() in ("by ", "von", "par", "por") and len(own) < 80 and _BY.match(own):
            say("author", person(own), "by-line", n.xpath())
    for n in nodes:
        if n.tag == "time":
            around = squeezed(n.parent.text) if n.parent is not None else ""
            question = "modified" if _MODIFIED.search(around) or _MODIFIED.search(n.get("class") or "") else "published"
            say(question, _date(n.get("datetime") or "") or _date(n.words()), "time", n.xpath())
    for n in nodes:
        if _DATE_CLASS.search(n.get("class") or ""):
            text = squeezed(n.words())
            if len(text) < 120:
                say("modified" if _MODIFIED.search(text) else "published", _date(text), "date-class", n.xpath())
    if heads:
        near = [n for n in nodes if heads[0].order < n.order <= heads[0].order + 12]
        for n in near:
            text = squeezed(n.text)
            if len(text) < 80:
                say("modified" if _MODIFIED.search(text) else "published", _date(text), "near-heading", n.xpath())
    if found := _URL_DATE.search(url or ""):
        say("published", "-".join(found.groups()), "address", "")
    return list(out.values())
