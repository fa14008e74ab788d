"""Pages to records, the fixed questions' answers and the disagreements, from one parse of each page."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import scalars
from loomgrain.kernels.answers import QUESTIONS, candidates
from loomgrain.kernels.fold import fold, leaves
from loomgrain.kernels.tree import join
from loomgrain.operators.declared import ABOUT_THINGS, _page

_FIELD = pa.struct([("key", pa.string()), ("value", pa.string()), ("source", pa.string())])
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()),
    ("records", pa.list_(pa.struct([("ix", pa.int32()), ("types", pa.list_(pa.string())), ("source", pa.string()), ("fields", pa.list_(_FIELD))]))),
    ("aside", pa.list_(pa.struct([("ix", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("source", pa.string())]))),
    ("candidates", pa.list_(pa.struct([("question", pa.string()), ("rank", pa.int32()), ("value", pa.string()), ("source", pa.string()), ("key", pa.string())]))),
])
SCHEMA = (
    "page_id long, url string, records array<struct<ix:int,types:array<string>,source:string,fields:array<struct<key:string,value:string,source:string>>>>,"
    " aside array<struct<ix:int,key:string,value:string,source:string>>, candidates array<struct<question:string,rank:int,value:string,source:string,key:string>>"
)


def _document(metas: list[dict]) -> list[dict]:
    """reader, key, value of the readers about the document in order of precedence; the first of a key wins."""
    found: dict[str, dict[str, str]] = {"dublincore": {}, "opengraph": {}, "twitter": {}, "html": {}}
    for m in metas:
        if not m["content"]:
            continue
        name = (m["name"] or "").strip().lower()
        keys = [*(m["property"] or "").lower().split(), *([name] if name else [])]
        if name.startswith(("dc.", "dcterms.")):
            found["dublincore"].setdefault(name.split(".", 1)[1], m["content"])
        own = next((k for k in keys if k.startswith("og:")), None)
        if own:
            found["opengraph"].setdefault(own[3:], m["content"])
        vertical = next((k for k in keys if k.startswith(("article:", "book:", "profile:", "video:", "music:", "product:"))), None)
        if vertical:
            found["opengraph"].setdefault(vertical, m["content"])
        card = next((k for k in keys if k.startswith("twitter:")), None)
        if card:
            found["twitter"].setdefault(card[8:], m["content"])
        if name in ("author", "description", "keywords", "generator", "application-name", "theme-color"):
            found["html"].setdefault(name, m["content"])
    return [{"reader": r, "key": k, "value": v} for r, held in found.items() for k, v in held.items()]


def _extracted(page: dict, parts: frozenset[str]) -> dict:
    about = _document(page["metas"])
    records, aside = fold(page["items"], about, ABOUT_THINGS)
    written = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    told = {"page_id": page["page_id"], "url": page["url"], "records": None, "aside": None, "candidates": None}
    if "records" in parts:
        told["records"] = [{"ix": k, "types": r["types"], "source": r["source"], "fields": [{"key": n, "value": written(v), "source": s} for n, (v, s) in r["fields"].items()]} for k, r in enumerate(records)]
    if "aside" in parts:
        told["aside"] = [dict(zip(("ix", "key", "value", "source"), x, strict=True)) for x in aside]
    if "candidates" not in parts:
        return told
    canonicals = {join(page["base"], x["href"]) for x in page["links"] if x["tag"] == "link" and x["in_head"] and "canonical" in (x["rel"] or "").lower().split() and x["href"].strip()}
    page = page | {"canonical": canonicals.pop() if len(canonicals) == 1 else None}
    said = candidates(page, records, {(x["reader"], x["key"]): x["value"] for x in about})
    told["candidates"] = [dict(zip(("question", "rank", "value", "source", "key"), x, strict=True)) for x in said]
    return told


#: What extract() can give besides page_id and url.
PARTS = ("records", "aside", "candidates")


def extract(pages: DataFrame, readers: tuple[str, ...] = ("jsonld", "microdata", "rdfa"), parts: tuple[str, ...] = PARTS, closed: bool = False) -> DataFrame:
    """page_id, url, records, aside (values that a fold set aside) and candidates of every page; a null page has none.

    Of these three the ``parts`` that aren't asked for are null, and cost nothing. ``closed`` as for kernels.tree.load().
    """
    wanted, asked = frozenset(readers), frozenset(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = zip(*(batch.slice(k, 500).column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
                yield pa.RecordBatch.from_pylist([_extracted(_page(*r, wanted, closed), asked) for r in rows], schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def record_fields(extracted: DataFrame) -> DataFrame:
    """page_id, ix, type, key, value (text or JSON) and source of every field of every record."""
    rows = extracted.select("page_id", F.explode("records").alias("r")).select("page_id", F.col("r.ix").alias("ix"), F.get("r.types", F.lit(0)).alias("type"), F.explode("r.fields").alias("f"))
    return rows.select("page_id", "ix", "type", "f.key", "f.value", "f.source")


def texts_of(key: str, value: str) -> list[tuple[str, str]]:
    """(path, text) of every text inside a field's value, which is text or JSON."""
    found: list[tuple[str, str]] = []
    try:
        held = json.loads(value) if value[:1] in "[{" else value
    except ValueError:
        held = value
    leaves(held, key, found)
    return found


def paths(fields: DataFrame) -> DataFrame:
    """page_id, ix, key, path and leaf of every text inside the fields' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, ix, key, value in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                out += [{"page_id": page, "ix": ix, "key": key, "path": p, "leaf": v} for p, v in texts_of(key, value)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("ix", pa.int32()), ("key", pa.string()), ("path", pa.string()), ("leaf", pa.string())]))

    return fields.select("page_id", "ix", "key", "value").mapInArrow(run, "page_id long, ix int, key string, path string, leaf string")


#: Characters that places may take: so many times a page's length, and LEAST_PLACES at least.
PLACES, LEAST_PLACES = 2, 10_000


def places(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, ix, path, leaf and place of every text in the records: its vocabulary, record and JSON pointer, as ``jsonld:0#/offers/price``.

    ``pages`` has page_id and html. A page's places take PLACES times its length together; those beyond, in order of records and paths, are null: a page can't
    make its places longer than itself without end.
    """
    fields = record_fields(extracted)
    sources = fields.select("page_id", "ix", "key", "source")
    found = paths(fields).join(sources.hint("merge"), ["page_id", "ix", "key"])
    steps = F.filter(F.split(F.regexp_replace("path", r"\[(\d+)\]", ".$1"), r"\."), lambda x: x != "")
    placed = found.withColumn("place", F.concat("source", F.lit(":"), F.col("ix").cast("string"), F.lit("#"), scalars.json_pointer(steps)))
    room = pages.select("page_id", F.greatest(F.lit(LEAST_PLACES), PLACES * F.length(F.coalesce("html", F.lit("")))).alias("room"))
    order = Window.partitionBy("page_id").orderBy("ix", "path", "leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.length("place")).over(order)
    return placed.join(room.hint("merge"), "page_id").withColumn("spent", spent).select("page_id", "ix", "path", "leaf", F.when(F.col("spent") <= F.col("room"), F.col("place")).alias("place"))


def best(question: str, candidates: Column | None = None) -> Column:
    """The struct that answers a question: the candidate of the least rank. No shuffle: a page has its candidates with it."""
    held = F.col("candidates") if candidates is None else candidates
    return F.array_min(F.transform(F.filter(held, lambda c: c["question"] == question), lambda c: F.struct(c["rank"].alias("rank"), c["value"].alias("value"), c["source"].alias("source"), c["key"].alias("key"))))


def summary(extracted: DataFrame) -> DataFrame:
    """page_id and a column for each question with its answer, null where the page gives none."""
    return extracted.select("page_id", *(best(q)["value"].alias(q) for q in QUESTIONS))


def summary_long(extracted: DataFrame, *also: str) -> DataFrame:
    """page_id, question, value, source and key of every answer, with the columns ``also`` of its page."""
    # candidates sort by question and rank: the first of each question answers it
    first = scalars.let(F.array_sort("candidates"), lambda all_: F.filter(all_, lambda c, k: (k == 0) | (F.get(all_, k - 1)["question"] != c["question"])))
    rows = extracted.select("page_id", *also, F.explode(first).alias("x"))
    return rows.select("page_id", *also, "x.question", "x.value", "x.source", "x.key")


def normalised(long: DataFrame) -> DataFrame:
    """The answers that have a meaning besides their text: page_id, question, meaning."""
    q, v = F.col("question"), F.col("value")
    meaning = (
        F.when(q.isin("published", "modified"), scalars.iso_date(v))
        .when(q.isin("price", "price_regular", "price_low", "price_high"), scalars.amount(v))
        .when(q == "currency", scalars.currency(v))
        .when(q == "gtin", scalars.gtin(v))
    )
    return long.select("page_id", "question", meaning.alias("meaning")).where("meaning is not null")


#: Keys that say when something was published; a creation date isn't one.
_PUBLISHED = r"(datePublished|article:published_time|dc\.date\.issued|dc\.issued)$"


def conflicts(extracted: DataFrame) -> DataFrame:
    """page_id, question and answers (values of different meanings, the summary's first) where a page contradicts itself.

    Price and currency by value, dates by their day; what can't be read is no disagreement. Values that a fold set aside
    for the same thing count after the others.
    """
    asked = ("price", "currency", "published", "modified")
    said = lambda question, rank, value, key: F.struct(question.alias("question"), rank.alias("rank"), value.alias("value"), key.alias("key"))
    own = F.transform(F.filter("candidates", lambda c: c["question"].isin(*asked)), lambda c: said(c["question"], c["rank"], c["value"], c["key"]))
    late = lambda question, value: said(F.lit(question), F.lit(1000), value, F.lit("Thing.datePublished"))
    more = F.flatten(F.transform("aside", lambda a: F.when(a["key"] == "offers", F.array(late("price", F.get_json_object(a["value"], "$.price")), late("currency", F.get_json_object(a["value"], "$.priceCurrency"))))
        .when(a["key"] == "datePublished", F.array(late("published", a["value"]))).when(a["key"] == "dateModified", F.array(late("modified", a["value"]))).otherwise(F.array().cast("array<struct<question:string,rank:int,value:string,key:string>>"))))
    # one explode, so that a page is parsed once
    said_all = extracted.select("page_id", F.explode(F.concat(own, F.coalesce(more, F.array().cast("array<struct<question:string,rank:int,value:string,key:string>>")))).alias("x")).select("page_id", "x.*").where("value is not null")
    q, v = F.col("question"), F.col("value")
    meaning = (
        F.when(q == "price", scalars.amount(v).try_cast("decimal(38,10)").cast("string"))
        .when(q == "currency", scalars.currency(v))
        .when(q.isin("published", "modified"), F.substring(scalars.iso_date(v), 1, 10))
    )
    rows = said_all.where((q != "published") | F.col("key").rlike(_PUBLISHED)).withColumn("meaning", meaning).where("meaning is not null")
    each = rows.groupBy("page_id", "question", "meaning").agg(F.min(F.struct("rank", "value")).alias("first"))
    found = each.groupBy("page_id", "question").agg(F.array_sort(F.collect_list("first")).alias("all")).where(F.size("all") > 1)
    return found.select("page_id", "question", F.transform("all", lambda x: x["value"]).alias("answers"))
