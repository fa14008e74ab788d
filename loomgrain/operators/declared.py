"""What pages declare, as tables. One pass parses a page; all readers share it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions.scalars import let
from loomgrain.kernels import declared as kernel
from loomgrain.kernels.tree import base_of, load

#: Readers in order of precedence: name, and whether it reads things or the document.
READERS = (("jsonld", True), ("microdata", True), ("microformats", True), ("rdfa", True), ("dublincore", False), ("opengraph", False), ("twitter", False), ("html", False))
RANK = {name: k for k, (name, _) in enumerate(READERS)}
ABOUT_THINGS = tuple(name for name, things in READERS if things)

_ITEM = "array<struct<reader:string,ix:int,types:array<string>,json:string>>"
_META = "array<struct<ord:int,property:string,name:string,content:string>>"
_LINK = "array<struct<ord:int,tag:string,rel:string,href:string,type:string,hreflang:string,title:string,in_head:boolean>>"
SCHEMA = f"page_id long, url string, base string, lang string, title string, items {_ITEM}, metas {_META}, links {_LINK}"

_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("base", pa.string()), ("lang", pa.string()), ("title", pa.string()),
    ("items", pa.list_(pa.struct([("reader", pa.string()), ("ix", pa.int32()), ("types", pa.list_(pa.string())), ("json", pa.string())]))),
    ("metas", pa.list_(pa.struct([("ord", pa.int32()), ("property", pa.string()), ("name", pa.string()), ("content", pa.string())]))),
    ("links", pa.list_(pa.struct([("ord", pa.int32()), ("tag", pa.string()), ("rel", pa.string()), ("href", pa.string()), ("type", pa.string()), ("hreflang", pa.string()), ("title", pa.string()), ("in_head", pa.bool_())]))),
])


def _page(page_id: int | None, url: str | None, html: str | None, wanted: frozenset[str], closed: bool = False) -> dict:
    tree = load(html, closed)
    low = (html or "").lower()
    items = []
    # a vocabulary whose mark the page lacks is not looked for
    reads = (
        ("jsonld", "ld+json" in low, lambda: kernel.jsonld(tree)),
        ("microdata", "itemscope" in low, lambda: kernel.microdata(tree, url, len(low))),
        ("microformats", "h-" in low, lambda: kernel.microformats(tree, url)),
        ("rdfa", "typeof" in low, lambda: kernel.rdfa(tree, url, len(low))),
    )
    for reader, there, read in reads:
        if there and reader in wanted:
            for k, item in enumerate(read()):
                types = item.get("@type") or []
                types = [kernel.type_name(t) for t in ([types] if isinstance(types, str) else types) if isinstance(t, str)]
                held = kernel.canonical({key: v for key, v in item.items() if not key.startswith("@") or key == "@id"}) or {}
                items.append({"reader": reader, "ix": k, "types": types, "json": json.dumps(held, ensure_ascii=False)})
    metas, links, title = [], [], None
    for node in tree.iter():
        if node.tag == "meta" and (node.get("property") is not None or node.get("name") is not None):
            metas.append({"ord": node.order, "property": node.get("property"), "name": node.get("name"), "content": (node.get("content") or "").strip()})
        elif node.tag in ("a", "link", "area") and node.get("href") is not None:
            # a plain link matters to a crawl, a related one to the readers
            links.append({"ord": node.order, "tag": node.tag, "rel": node.get("rel"), "href": node.get("href"), "type": node.get("type"), "hreflang": node.get("hreflang"), "title": node.get("title"), "in_head": any(a.tag == "head" for a in node.above())})
        elif node.tag == "title" and title is None and not any(a.tag in ("svg", "math") for a in node.above()):
            title = " ".join(node.words().split()) or None
    return {"page_id": page_id, "url": url, "base": base_of(tree, url), "lang": (tree.get("lang") or "").strip() or None, "title": title, "items": items, "metas": metas, "links": links}


def parse(pages: DataFrame, readers: tuple[str, ...] = ("jsonld", "microdata", "rdfa")) -> DataFrame:
    """One row a page with its items, metas and links. ``readers`` names the readers about things that run."""
    wanted = frozenset(readers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                rows = zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
                yield pa.RecordBatch.from_pylist([_page(*r, wanted) for r in rows], schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def items(parsed: DataFrame) -> DataFrame:
    """page_id, reader, ix, types, json of every item about a thing."""
    return parsed.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")


# --- readers about the document: relational over the metas


def metas(parsed: DataFrame) -> DataFrame:
    """page_id, ord, keys (terms of ``property``, then the name), name, content of every meta with a value."""
    m = parsed.select("page_id", F.explode("metas").alias("m")).select("page_id", "m.*").where("content <> ''")
    terms = F.filter(F.split(F.lower(F.coalesce("property", F.lit(""))), r"\s+"), lambda x: x != "")
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    return m.select("page_id", "ord", F.concat(terms, F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))).alias("keys"), name.alias("name"), "content")


def _first(rows: DataFrame, reader: str) -> DataFrame:
    return rows.groupBy("page_id", "key").agg(F.min_by("content", "ord").alias("value")).select("page_id", F.lit(reader).alias("reader"), "key", "value")


def dublin_core(parsed: DataFrame) -> DataFrame:
    """page_id, reader, key, value of Dublin Core's metas, the first of a key."""
    key = F.regexp_replace("name", r"^(dc|dcterms)\.", "")
    return _first(metas(parsed).where(F.col("name").rlike(r"^(dc|dcterms)\.")).select("page_id", "ord", key.alias("key"), "content"), "dublincore")


def twitter(parsed: DataFrame) -> DataFrame:
    found = metas(parsed).withColumn("k", F.get(F.filter("keys", lambda x: x.startswith("twitter:")), F.lit(0))).where("k is not null")
    return _first(found.select("page_id", "ord", F.substring("k", 9, 1000).alias("key"), "content"), "twitter")


def html_meta(parsed: DataFrame) -> DataFrame:
    names = ("author", "description", "keywords", "generator", "application-name", "theme-color")
    return _first(metas(parsed).where(F.col("name").isin(*names)).select("page_id", "ord", F.col("name").alias("key"), "content"), "html")


_NAMESPACES = ("article:", "book:", "profile:", "video:", "music:", "product:")
_STRUCTURED = {
    "image": ("url", "secure_url", "type", "width", "height", "alt"), "video": ("url", "secure_url", "type", "width", "height"), "audio": ("url", "secure_url", "type"),
    "music:song": ("disc", "track"), "music:album": ("disc", "track"), "video:actor": ("role",),
}
_ARRAYS = (*_STRUCTURED, "locale:alternate", "music:musician", "video:director", "video:writer", "video:tag", "article:author", "article:tag", "book:author", "book:tag")


def _og_rows(parsed: DataFrame) -> DataFrame:
    """page_id, nth, key, content of OpenGraph's tags: the protocol's own first, then the namespaces', each in order."""
    own = F.get(F.filter("keys", lambda x: x.startswith("og:")), F.lit(0))
    vertical = F.get(F.filter("keys", lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in _NAMESPACES])), F.lit(0))
    both = F.array_compact(F.array(F.when(own.isNotNull(), F.struct(F.lit(0).alias("part"), F.substring(own, 4, 1000).alias("key"))), F.when(vertical.isNotNull(), F.struct(F.lit(1).alias("part"), vertical.alias("key")))))
    return metas(parsed).select("page_id", "ord", "content", F.explode(both).alias("x")).select("page_id", "x.part", "ord", "x.key", "content")


def opengraph(parsed: DataFrame) -> DataFrame:
    """page_id, reader, key, value: one value of each property, the first; of a structured one that of its first root.

    Sessions of a root are a running count of its tags over the page's order.
    """
    rows = _grouped(parsed)
    first = rows.where("root is null or session <= 1")
    best = first.groupBy("page_id", "key").agg(F.min_by("content", F.struct("part", "ord")).alias("value"))
    return best.select("page_id", F.lit("opengraph").alias("reader"), "key", "value")


def _grouped(parsed: DataFrame) -> DataFrame:
    rows = _og_rows(parsed)
    root = F.lit(None).cast("string")
    sub = F.lit(None).cast("string")
    for name, parts in _STRUCTURED.items():
        for part in parts:
            root = F.when(F.col("key") == f"{name}:{part}", F.lit(name)).otherwise(root)
            sub = F.when(F.col("key") == f"{name}:{part}", F.lit(part)).otherwise(sub)
        root = F.when(F.col("key") == name, F.lit(name)).otherwise(root)
        sub = F.when(F.col("key") == name, F.lit("")).otherwise(sub)
    rows = rows.withColumn("root", root).withColumn("sub", sub)
    along = Window.partitionBy("page_id", "root").orderBy("part", "ord")
    # a root that names the last one again starts nothing; an address before any root is one
    before = F.lag("content").over(Window.partitionBy("page_id", "root", F.col("sub").isin("", "url")).orderBy("part", "ord"))
    starts = ((F.col("sub") == "") & ((before.isNull()) | (before != F.col("content")))) | ((F.col("sub") == "url") & (F.row_number().over(along) == 1))
    return rows.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("session", F.when(F.col("root").isNotNull(), F.sum(F.col("starts").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))))


def opengraph_arrays(parsed: DataFrame) -> DataFrame:
    """page_id, key, value: every OpenGraph property in JSON; arrays as lists, several roots as a list of objects."""
    sub = F.when(F.col("sub") == "", F.lit("url")).otherwise(F.col("sub"))
    tag = F.struct("part", "ord", F.greatest("session", F.lit(1)).alias("session"), sub.alias("sub"), "content")
    # a page's tags of one property meet in one row, so that pages are read once
    each = _grouped(parsed).groupBy("page_id", F.col("root").isNotNull().alias("rooted"), F.coalesce("root", "key").alias("key")).agg(F.array_sort(F.collect_list(tag)).alias("all"))
    values = F.slice(F.array_distinct(F.transform("all", lambda x: x["content"])), 1, 100)
    many = F.col("key").isin(*_ARRAYS) & (F.size(values) > 1)
    plain = F.when(many, F.to_json(values)).otherwise(_quoted(F.get(values, F.lit(0))))
    # the first tag of a part counts in each session
    first = lambda own: F.filter(own, lambda x, k: F.array_position(F.transform(own, lambda y: y["sub"]), x["sub"]) == k + 1)
    parts = lambda s: F.array_sort(F.transform(let(F.filter("all", lambda x: x["session"] == s), first), lambda x: F.struct(x["sub"].alias("sub"), x["content"].alias("content"))))
    sessions = F.array_sort(F.array_distinct(F.transform("all", lambda x: x["session"])))
    row = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    told = let(
        F.transform(sessions, parts),
        lambda objects: F.when(F.size(objects) > 1, F.array(row(F.col("key"), F.concat(F.lit("["), F.array_join(F.transform(objects, lambda o: F.to_json(F.map_from_entries(o))), ","), F.lit("]"))))).otherwise(
            F.transform(F.get(objects, F.lit(0)), lambda x: row(F.when(x["sub"] == "url", F.col("key")).otherwise(F.concat_ws(":", F.col("key"), x["sub"])), _quoted(x["content"])))
        ),
    )
    return each.select("page_id", F.explode(F.when(F.col("rooted"), told).otherwise(F.array(row(F.col("key"), plain)))).alias("x")).select("page_id", "x.key", "x.value")


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def document_fields(parsed: DataFrame) -> DataFrame:
    """page_id, reader, key, value of all readers about the document."""
    return dublin_core(parsed).unionByName(opengraph(parsed)).unionByName(twitter(parsed)).unionByName(html_meta(parsed))
