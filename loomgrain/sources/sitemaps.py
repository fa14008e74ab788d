"""Sitemaps and feeds: bytes or texts to rows of addresses and items."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a packed file may grow to; a larger one is read as broken.
MOST_BYTES = 256 << 20
#: Rows that leave at once.
_STEP = 5000


def _text(body: bytes | str | None) -> str | None:
    """A body as text, gzip undone by its first bytes; None where it is broken, too large or declares entities."""
    if body is None:
        return None
    if isinstance(body, bytes):
        if body[:2] == b"\x1f\x8b":
            inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
            try:
                body = inflate.decompress(body, MOST_BYTES + 1)
            except zlib.error:
                return None
            if len(body) > MOST_BYTES or not inflate.eof:
                return None
        body = body.decode("utf-16" if body[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace")
    return body.lstrip("﻿ \t\r\n")


def _unsafe(text: str) -> bool:
    """Whether a document type is declared, by which a small file could grow without end."""
    return re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I) is not None


def _local(tag: Any) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _entries_of(text: str, names: tuple[str, ...]) -> Iterator[Any]:
    """Elements of these names as they end; of a broken file those before the break. Entries leave the tree once they were told, so that it doesn't grow with the file."""
    parser = ElementTree.XMLPullParser(["start", "end"])
    begin = re.match(r"<\?xml[^>]*\?>", text)
    above: list[Any] = []
    inside = 0
    for k in range(begin.end() if begin else 0, len(text), 1 << 16):
        try:
            parser.feed(text[k : k + (1 << 16)])
            for what, element in parser.read_events():
                own = _local(element.tag) in names
                if what == "start":
                    above.append(element)
                    inside += own
                    continue
                above.pop()
                if own:
                    yield element
                    element.clear()
                    inside -= 1
                    if above and not inside:
                        above[-1].remove(element)
        except ElementTree.ParseError:
            return


def sitemap(body: bytes | str | None, most: int | None = None) -> list[dict]:
    """kind (``url`` or ``sitemap``), address and modified of a sitemap, an index of them, or a plain list; ``most``: the first entries, None for all."""
    return list(islice(_entries(body), most))


def _entries(body: bytes | str | None) -> Iterator[dict]:
    """sitemap()'s entries one by one."""
    text = _text(body)
    if text is None or text.startswith("<") and _unsafe(text):
        return
    if not text.startswith("<"):
        for x in text.splitlines():
            if re.match(r"\s*https?://\S+\s*$", x):
                yield {"kind": "url", "address": x.strip(), "modified": None}
        return
    for e in _entries_of(text, ("url", "sitemap")):
        said = {_local(c.tag): (c.text or "").strip() for c in e}
        if said.get("loc"):
            yield {"kind": _local(e.tag), "address": said["loc"], "modified": said.get("lastmod") or None}


def _rss(item: Any, base: str | None) -> dict:
    said: dict[str, str] = {}
    link = None
    for c in item:
        name, text = _local(c.tag), (c.text or "").strip()
        if name == "guid" and text and (c.get("isPermaLink") or "true").lower() != "false":
            said.setdefault("permalink", text)
        if name == "enclosure" and c.get("url"):
            said.setdefault("enclosure", urljoin(base or "", c.get("url")))
        if text:
            said.setdefault("link" if name == "link" else name, text)
    link = said.get("link") or said.get("permalink")
    return {"title": said.get("title"), "link": urljoin(base or "", link) if link else None, "id": said.get("guid"), "published": said.get("pubdate") or said.get("date"), "author": said.get("author") or said.get("creator"), "enclosure": said.get("enclosure")}


def _atom(entry: Any, base: str | None) -> dict:
    said: dict[str, str] = {}
    base = urljoin(base or "", entry.get("{http://www.w3.org/XML/1998/namespace}base") or "")
    for c in entry:
        name, text = _local(c.tag), "".join(c.itertext()).strip()
        if name == "link" and c.get("href"):
            rel = c.get("rel") or "alternate"
            said.setdefault({"alternate": "link", "enclosure": "enclosure"}.get(rel, rel), urljoin(base, c.get("href")))
        elif name == "author":
            text = next((("".join(x.itertext())).strip() for x in c if _local(x.tag) == "name"), text)
            said.setdefault("author", text)
        elif text:
            said.setdefault(name, text)
    return {"title": said.get("title"), "link": said.get("link"), "id": said.get("id"), "published": said.get("published") or said.get("updated"), "author": said.get("author"), "enclosure": said.get("enclosure")}


_SPACE = re.compile(r"[ \t\n\r]*")


def _members(text: str, at: int) -> Iterator[tuple[str, int]]:
    """Each name of the object that begins at a place, with where its value begins; the reader sends where it ends. Raises ValueError for what is no JSON."""
    step = lambda k: _SPACE.match(text, k).end()
    at = step(at + 1)
    if text[at : at + 1] == "}":
        yield "", -at - 1
        return
    while True:
        if text[at : at + 1] != '"':
            raise ValueError("no name")
        name, at = _DECODER.raw_decode(text, at)
        at = step(at)
        if text[at : at + 1] != ":":
            raise ValueError("no colon")
        at = step((yield name, step(at + 1)))
        if text[at : at + 1] == "}":
            yield "", -at - 1
            return
        if text[at : at + 1] != ",":
            raise ValueError("no comma")
        at = step(at + 1)


def _elements(text: str, at: int) -> Iterator[tuple[Any, int]]:
    """Each value of the array that begins at a place with where it ends; the last pair has None and where the array ends."""
    step = lambda k: _SPACE.match(text, k).end()
    at = step(at + 1)
    if text[at : at + 1] == "]":
        yield None, -at - 1
        return
    while True:
        value, at = _DECODER.raw_decode(text, at)
        yield value, at
        at = step(at)
        if text[at : at + 1] == "]":
            yield None, -at - 1
            return
        if text[at : at + 1] != ",":
            raise ValueError("no comma")
        at = step(at + 1)


_DECODER = json.JSONDecoder()


def _told(text: str) -> tuple[dict, int | None]:
    """A JSON object's values but for its list of items, and where that begins: a list of millions is read twice, and never held. Raises ValueError for what is no JSON."""
    told: dict[str, Any] = {}
    items = None
    members = _members(text, 0)
    name, at = next(members)
    while at >= 0:
        if name == "items" and text[at : at + 1] == "[":
            told[name], items = True, at
            for _, end in _elements(text, at):
                pass
            end = -end
        else:
            told[name], end = _DECODER.raw_decode(text, at)
            if name == "items":
                items = None
        name, at = members.send(end)
    if _SPACE.match(text, -at).end() != len(text):
        raise ValueError("more behind it")
    return told, items


def _json_items(items: Iterator[Any], base: str | None) -> Iterator[dict]:
    for x in items:
        if not isinstance(x, dict):
            continue
        people = x.get("authors") or ([x["author"]] if isinstance(x.get("author"), dict) else [])
        names = [p["name"] for p in people if isinstance(p, dict) and isinstance(p.get("name"), str)]
        files = [a["url"] for a in x.get("attachments") or [] if isinstance(a, dict) and isinstance(a.get("url"), str)]
        link = x.get("url") or x.get("external_url")
        yield {"title": x.get("title"), "link": urljoin(base or "", link) if isinstance(link, str) else None, "id": str(x["id"]) if x.get("id") is not None else None, "published": x.get("date_published") or x.get("date_modified"), "author": ", ".join(names) or None, "enclosure": files[0] if files else None}


def feed(body: bytes | str | None, url: str | None, most: int | None = None) -> tuple[str | None, list[dict]]:
    """(kind, items) of RSS 2.0, RSS 1.0, Atom or JSON Feed; no kind where it is none of them. ``most``: the first items, None for all."""
    kind, items = _items(body, url)
    return kind, list(islice(items, most))


def _items(body: bytes | str | None, url: str | None) -> tuple[str | None, Iterator[dict]]:
    """feed()'s items one by one."""
    text = _text(body)
    if not text:
        return None, iter(())
    if text.startswith("{"):
        try:
            told, at = _told(text)
        except (ValueError, RecursionError):
            return None, iter(())
        ok = re.match(r"https?://(?:www\.)?jsonfeed\.org/version/1(?:\.\d)?/?$", str(told.get("version", "")))
        if not ok:
            return None, iter(())
        held = (x for x, end in _elements(text, at) if end >= 0) if at is not None else iter(told.get("items") or [])
        return "json", _json_items(held, url)
    if not text.startswith("<") or _unsafe(text):
        return None, iter(())
    root = re.match(r"(?s)(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[\w-]+:)?(rss|rdf|feed)\b", text, re.I)
    if not root:
        return None, iter(())
    kind = {"rss": "rss", "rdf": "rdf", "feed": "atom"}[root[1].lower()]
    one = _atom if kind == "atom" else _rss
    return kind, (one(e, url) for e in _entries_of(text, ("entry" if kind == "atom" else "item",)))


_SITEMAP = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("address", pa.string()), ("modified", pa.string())])
_FEED = pa.schema([("file", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), *((c, pa.string()) for c in ("title", "link", "id", "published", "author", "enclosure"))])


def _spread(files: DataFrame, one: Callable[[str | None, Any], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows of each file, some thousands at once: how long a file is costs no memory but its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = iter(one(batch.column("file")[k].as_py(), batch.column("body")[k].as_py()))
                while some := list(islice(rows, _STEP)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return files.select("file", "body").mapInArrow(run, ddl)


def sitemap_urls(files: DataFrame) -> DataFrame:
    """file, ord, kind, address, modified of every entry; ``files`` has file (its address) and body (text or binary)."""
    return _spread(files, lambda f, b: ({"file": f, "ord": k, **x} for k, x in enumerate(_entries(b))), _SITEMAP, "file string, ord int, kind string, address string, modified string")


def feed_items(files: DataFrame) -> DataFrame:
    """file, kind, ord, title, link, id, published, author, enclosure of every item; ``files`` as for sitemap_urls()."""

    def one(f: str | None, b: Any) -> Iterator[dict]:
        kind, items = _items(b, f)
        return ({"file": f, "kind": kind, "ord": k, **{n: v if isinstance(v, str) else None for n, v in x.items()}} for k, x in enumerate(items))

    return _spread(files, one, _FEED, "file string, kind string, ord int, title string, link string, id string, published string, author string, enclosure string")
