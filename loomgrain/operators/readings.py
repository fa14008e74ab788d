"""Other readings of pages: what they show, their text as Markdown, their headers, and the shapes that other tools expect."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrain.kernels import encoded, headers
from loomgrain.kernels.declared import jsonld, microdata, microformats, rdfa
from loomgrain.kernels.markdown import markdown
from loomgrain.kernels.tree import base_of, load
from loomgrain.kernels.visible import guesses
from loomgrain.operators.declared import _page
from loomgrain.operators.extract import _document


def _each(pages: DataFrame, columns: list[str], one: Callable[..., list[dict[str, Any]]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = zip(*(batch.slice(k, 200).column(c).to_pylist() for c in columns), strict=True)
                yield pa.RecordBatch.from_pylist([x for row in rows for x in one(*row)], schema=schema)

    return pages.select(*columns).mapInArrow(run, ddl)


def visible(pages: DataFrame) -> DataFrame:
    """page_id, question, value, rule and place of what a page shows: title, author, published, modified."""
    schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("question", "value", "rule", "place"))])
    return _each(pages, ["page_id", "url", "html"], lambda p, u, h: [{"page_id": p, "question": q, "value": v, "rule": r, "place": w} for q, v, r, w in guesses(load(h), u)], schema, "page_id long, question string, value string, rule string, place string")


def as_markdown(pages: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """page_id and markdown. With ``answers`` (page_id and columns of answers) these go before it as front matter."""
    schema = pa.schema([("page_id", pa.int64()), ("markdown", pa.string())])

    def one(page_id: int | None, url: str | None, html: str | None) -> list[dict]:
        tree = load(html)
        return [{"page_id": page_id, "markdown": markdown(tree, base_of(tree, url))}]

    text = _each(pages, ["page_id", "url", "html"], one, schema, "page_id long, markdown string")
    if answers is None:
        return text
    quoted = lambda c: F.concat(F.lit(f"{c}: "), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    lines = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), quoted(c)) for c in answers.columns if c != "page_id")))
    front = answers.select("page_id", F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"))).alias("front"))
    return text.join(front, "page_id", "left").select("page_id", F.concat(F.coalesce("front", F.lit("")), "markdown").alias("markdown"))


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    """The text of a page's bytes, with the transport's charset where it said one."""
    return pd.Series([encoded.decoded(b, c) for b, c in zip(body, charset)], dtype=object)


# built without a session, since workers import this module too
_HEADERS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "agent", "value")]))


@F.pandas_udf(_HEADERS)
def _declared(names: pd.Series, values: pd.Series) -> pd.Series:
    def one(n: list[str], v: list[str]) -> list[dict[str, str]]:
        h = headers.lowered(list(zip(n, v, strict=True))) if n is not None else {}
        out = [{"kind": "robots", "agent": a, "value": d} for a, d in headers.robots(h.get("x-robots-tag", ""))]
        out += [{"kind": k, "agent": "*", "value": h[k]} for k in ("tdm-reservation", "tdm-policy") if h.get(k)]
        out += [{"kind": "usage", "agent": k, "value": x} for k, x in headers.usage(h.get("content-usage", "")).items()]
        for link in headers.links(h.get("link", "")):
            for rel in (link.get("rel") or "").lower().split():
                out.append({"kind": f"link-{rel}", "agent": link.get("hreflang") or "*", "value": link["target"]})
        return out

    return pd.Series([one(n, v) for n, v in zip(names, values)], dtype=object)


def header_declarations(pages: DataFrame) -> DataFrame:
    """page_id, kind, agent and value of what response headers declare. ``pages`` has page_id and headers, an array of (name, value)."""
    return pages.select("page_id", F.explode(_declared("headers.name", "headers.value")).alias("d")).select("page_id", "d.*")


def nofollow(declarations: DataFrame) -> DataFrame:
    """page_id of the pages whose headers ask that their links aren't followed."""
    return declarations.where((F.col("kind") == "robots") & (F.col("agent") == "*") & F.col("value").isin("nofollow", "none")).select("page_id").distinct()


SYNTAXES = ("json-ld", "microdata", "opengraph", "microformat", "rdfa", "dublincore")


def _shaped(page_id: int | None, url: str | None, html: str | None, uniform: bool) -> list[dict]:
    tree = load(html)
    base, size = base_of(tree, url), len(html or "")
    about = _document(_page(page_id, url, html, frozenset())["metas"])
    flat = lambda items, context: [{"@context": context, **({"@type": t[0] if len(t) == 1 else t} if (t := x.get("@type") or x.get("types") or []) else {}), **{k: v for k, v in x.items() if k not in ("types", "@type")}} for x in items]
    found: dict[str, list] = {
        "json-ld": jsonld(tree), "microdata": microdata(tree, base, size), "microformat": microformats(tree, base), "rdfa": rdfa(tree, base, size),
        "opengraph": [{"namespace": {"og": "http://ogp.me/ns#"}, "properties": [[f"og:{x['key']}" if ":" not in x["key"] else x["key"], x["value"]] for x in about if x["reader"] == "opengraph"]}],
        "dublincore": [{"elements": [{"name": x["key"], "content": x["value"]} for x in about if x["reader"] == "dublincore"]}],
    }
    if not found["opengraph"][0]["properties"]:
        found["opengraph"] = []
    if not found["dublincore"][0]["elements"]:
        found["dublincore"] = []
    if uniform:
        found["opengraph"] = [{"@context": x["namespace"], **{k: v for k, v in reversed(x["properties"])}} for x in found["opengraph"]]
        found["microdata"] = flat(found["microdata"], "http://schema.org")
    return [{"page_id": page_id, "syntax": s, "items": json.dumps(found[s], ensure_ascii=False, default=str)} for s in SYNTAXES]


def by_syntax(pages: DataFrame, uniform: bool = False) -> DataFrame:
    """page_id, syntax and items (JSON) in the shape that syntax-wise extractors give, six syntaxes a page."""
    schema = pa.schema([("page_id", pa.int64()), ("syntax", pa.string()), ("items", pa.string())])
    return _each(pages, ["page_id", "url", "html"], lambda p, u, h: _shaped(p, u, h, uniform), schema, "page_id long, syntax string, items string")


def products_json(files: DataFrame) -> DataFrame:
    """file, id, title, vendor, handle, sku, price, available of every variant in a shop's products.json; prices keep their text.

    ``files`` has file (its address) and body. What is no such file gives no rows.
    """
    names = ("id", "title", "vendor", "handle", "sku", "price", "available")
    schema = pa.schema([("file", pa.string()), *((c, pa.string()) for c in names)])

    def one(file: str | None, body: str | None) -> list[dict]:
        try:
            told = json.loads(body or "", parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            return []
        products = told.get("products") if isinstance(told, dict) else None
        out = []
        for p in products if isinstance(products, list) else []:
            for v in (p.get("variants") or [{}]) if isinstance(p, dict) else []:
                said = {"id": p.get("id"), "title": p.get("title"), "vendor": p.get("vendor"), "handle": p.get("handle"), "sku": v.get("sku"), "price": v.get("price"), "available": v.get("available")}
                out.append({"file": file, **{k: None if x is None or x == "" else str(x).lower() if isinstance(x, bool) else str(x) for k, x in said.items()}})
        return out

    return _each(files, ["file", "body"], one, schema, "file string, " + ", ".join(f"{c} string" for c in names))
