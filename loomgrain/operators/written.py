"""Contracts whose selectors a person wrote: learnt, replayed, checked and healed, and contracts as JSON.

A written contract is one row an extractor: extractor, rows (a selector, or null for one record a page) and fields (a map of names to
selectors). Selectors come as data, so every extractor of a table is read in one parse of its pages. A selector that can't be read is no error
of the job but a failed check of its extractor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.kernels.select import BadSelector, found
from loomgrain.kernels.tree import Node, base_of, join, load, squeezed
from loomgrain.operators import contract
from loomgrain.sources.tables import measured

#: Share of rows on which a field may be found twice before that is a failure.
TWICE = 0.2
_CELL = pa.struct([("path", pa.string()), ("value", pa.string()), ("found", pa.int32())])
_ARROW = pa.schema([("extractor", pa.string()), ("page_id", pa.int64()), ("container", pa.string()), ("member", pa.string()), ("n_members", pa.int32()), ("rows", pa.list_(pa.list_(_CELL))), ("broken", pa.list_(pa.string()))])
SCHEMA = "extractor string, page_id long, container string, member string, n_members int, rows array<array<struct<path:string,value:string,found:int>>>, broken array<string>"


def _read(text: str):
    try:
        return found(text)
    except BadSelector:
        return None


def _page(extractor: str | None, page_id: int | None, url: str | None, html: str | None, rows: str | None, fields: list[tuple[str, str]]) -> dict:
    tree = load(html)
    base = base_of(tree, url)
    read = {name: _read(text) for name, text in fields}
    broken = sorted(name for name, f in read.items() if f is None)
    outer = _read(rows) if rows is not None else None
    if rows is not None and outer is None:
        broken = ["rows", *broken]
    if rows is None:
        members = [tree]
    else:
        members = [n for _, n in outer(tree)] if outer else []
    addressed = {name for name, text in fields if text.rstrip().endswith(("@href", "@src", "attr(href)", "attr(src)"))}
    out = []
    for m in members:
        top = m
        if rows is not None:
            top = Node("#row", {}, None)
            top.children = [m]
        cells = []
        for name, f in read.items():
            got = [v for v, _ in f(top) if squeezed(v)] if f else []
            if got:
                cells.append({"path": name, "value": join(base, got[0]) if name in addressed else got[0], "found": len(got)})
        if cells:
            out.append(cells)
    return {"extractor": extractor, "page_id": page_id, "container": rows or "page", "member": rows or "page", "n_members": len(members), "rows": out, "broken": broken}


def read(pages: DataFrame, written: DataFrame) -> DataFrame:
    """SCHEMA's row for each page of an extractor that ``written`` has: what its selectors find, how often in a row, and which can't be read."""
    joined = pages.select("extractor", "page_id", "url", "html").join(measured(written).select("extractor", F.col("rows").alias("rows_selector"), F.map_entries("fields").alias("fields")), "extractor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                rows = zip(*(some.column(c).to_pylist() for c in ("extractor", "page_id", "url", "html", "rows_selector", "fields")), strict=True)
                yield pa.RecordBatch.from_pylist([_page(*r[:5], [(f["key"], f["value"]) for f in r[5] or []]) for r in rows], schema=_ARROW)

    return joined.mapInArrow(run, SCHEMA)


def _plain(nested: DataFrame) -> DataFrame:
    """As rows.induced() gives pages, for the profiles and checks of contracts."""
    return nested.withColumn("rows", F.transform("rows", lambda row: F.transform(row, lambda c: F.struct(c["path"].alias("path"), c["value"].alias("value"))))).withColumn("facts", F.lit(False)).drop("broken")


def learn(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing, columns) as contract.learn() gives them, from read() of the pages that a contract is learnt from."""
    return contract.learn(_plain(nested))


def refused(nested: DataFrame, written: DataFrame) -> DataFrame:
    """extractor, page_id, name and why (``unreadable`` or ``nothing``) of selectors that a contract can't be learnt with: each must find something on every page."""
    names = written.select("extractor", F.explode(F.map_keys("fields")).alias("name"))
    each = nested.join(names, "extractor")
    has = F.exists("rows", lambda row: F.exists(row, lambda c: c["path"] == F.col("name")))
    fields = each.select("extractor", "page_id", "name", F.when(F.array_contains("broken", F.col("name")), "unreadable").when(~has, "nothing").alias("why"))
    rows = nested.select("extractor", "page_id", F.lit("rows").alias("name"), F.when(F.array_contains("broken", "rows"), "unreadable").when(F.col("n_members") == 0, "nothing").alias("why"))
    return fields.unionByName(rows).where("why is not null")


def checks(nested: DataFrame, listing: DataFrame, columns: DataFrame) -> DataFrame:
    """contract.checks() of read()'s pages, with ``selector`` for selectors that can't be read and ``twice`` for fields found more than once in too many rows."""
    usual = contract.checks(_plain(nested), listing, columns, slots=False)
    known = nested.join(measured(listing).select("extractor"), "extractor", "left_semi")
    broken = known.select("extractor", "page_id", F.lit("selector").alias("kind"), F.explode("broken").alias("name"), F.lit(0.0).alias("measured"), F.lit(False).alias("ok"))
    cells = known.select("extractor", "page_id", F.explode("rows").alias("row")).select("extractor", "page_id", F.explode("row").alias("c"))
    often = cells.groupBy("extractor", "page_id", F.col("c.path").alias("name")).agg(F.avg(F.when(F.col("c.found") > 1, 1.0).otherwise(0.0)).alias("measured"))
    twice = often.where("measured > 0").select("extractor", "page_id", F.lit("twice").alias("kind"), "name", F.round("measured", 6).alias("measured"), (F.col("measured") <= TWICE).alias("ok"))
    return usual.unionByName(broken).unionByName(twice)


def heal(columns: DataFrame, nested: DataFrame, written: DataFrame) -> DataFrame:
    """extractor, kind (kept or broken) and name of each written field on pages as they are now. A person wrote the selectors, so none is moved.

    A field is kept where its selector still finds something on a page, and values of the learnt shape in KEPT of its rows.
    """
    cells = nested.select("extractor", F.explode("rows").alias("row")).select("extractor", F.explode("row").alias("c")).select("extractor", F.col("c.path").alias("name"), F.col("c.value").alias("value"))
    learnt = measured(columns).select("extractor", "name", "shape")
    fit = F.avg(F.when(F.col("shape").isNull() | contract.scalars.fits(F.col("value"), F.col("shape")), 1.0).otherwise(0.0))
    sound = cells.join(learnt, ["extractor", "name"]).groupBy("extractor", "name").agg((fit >= contract.KEPT).alias("sound"))
    names = written.select("extractor", F.explode(F.map_keys("fields")).alias("name"))
    return names.join(sound, ["extractor", "name"], "left").select("extractor", F.when(F.coalesce("sound", F.lit(False)), "kept").otherwise("broken").alias("kind"), "name")


# --- contracts as JSON

FORMAT = 1
_LISTING = "struct<container:string,member:string,rows_least:int,rows_most:int,n_pages:long,empty:double>"
_COLUMN = "struct<path:string,missing:double,shape:string,samples:array<string>,reads:string,missing_in_page:boolean,constant_in_page:boolean,name:string>"
_FIELD = "struct<name:string,anchor:string,path:string,form:string,label:string,shape:string,reads:string,samples:array<string>>"
_WRITTEN = "struct<rows:string,fields:map<string,string>>"


def _rows_of(table: DataFrame, schema: str, name: str) -> DataFrame:
    """extractor and its rows as an array of structs of the schema, in order."""
    columns = [c.split(":")[0] for c in _split(schema)]
    row: Column = F.struct(*(F.col(c) for c in columns)).cast(schema)
    return table.groupBy("extractor").agg(F.array_sort(F.collect_list(row)).alias(name))


def _split(schema: str) -> list[str]:
    """The members of a struct's schema."""
    inner, depth, out = schema[len("struct<") : -1], 0, [""]
    for c in inner:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def to_json(listing: DataFrame, columns: DataFrame, fields: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """extractor and contract, the JSON of all that an extractor has learnt; a contract has few columns, so one row holds it."""
    all_of = _rows_of(listing, _LISTING, "listing").select("extractor", F.get("listing", F.lit(0)).alias("listing")).join(_rows_of(columns, _COLUMN, "columns"), "extractor", "full")
    if fields is not None:
        all_of = all_of.join(_rows_of(fields, _FIELD, "fields"), "extractor", "full")
    if written is not None:
        all_of = all_of.join(written.select("extractor", F.struct("rows", "fields").cast(_WRITTEN).alias("select")), "extractor", "full")
    parts = [c for c in all_of.columns if c != "extractor"]
    return all_of.select("extractor", F.to_json(F.struct(F.lit(FORMAT).alias("format"), *parts)).alias("contract"))


def from_json(contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(listing, columns, fields, written) of to_json()'s rows; a text that isn't such JSON, or of another format, gives no rows."""
    schema = f"format int, listing {_LISTING}, columns array<{_COLUMN}>, fields array<{_FIELD}>, `select` {_WRITTEN}"
    told = contracts.select("extractor", F.from_json("contract", schema).alias("c")).where(F.col("c.format") == FORMAT)
    many = lambda name: told.select("extractor", F.explode(f"c.{name}").alias("x")).select("extractor", "x.*")
    listing = told.where("c.listing is not null").select("extractor", "c.listing.*")
    return listing, many("columns"), many("fields"), told.where("c.select is not null").select("extractor", "c.select.*")
