"""Rows of pages: what the markup repeats, and what selectors name. One parse gives a page's rows, nested; they leave by explode."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.kernels.induced import facts_of_one_thing, induce, induce_wanted, kind, path_of, records
from loomgrain.kernels.select import compiled, found
from loomgrain.kernels.tree import Node, base_of, join, load, squeezed

_CELLS = pa.list_(pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))
_ARROW = pa.schema([("extractor", pa.string()), ("page_id", pa.int64()), ("container", pa.string()), ("member", pa.string()), ("n_members", pa.int32()), ("facts", pa.bool_()), ("rows", _CELLS)])
SCHEMA = "extractor string, page_id long, container string, member string, n_members int, facts boolean, rows array<array<struct<path:string,value:string>>>"
_STEP = 200


def _resolved(tree: Node, url: str | None, rows: list[dict[str, str]]) -> list[list[dict[str, str]]]:
    base = base_of(tree, url)
    return [[{"path": p, "value": join(base, v) if "@" in p.rpartition(">")[2] else v} for p, v in row.items()] for row in rows]


def _pages(batches: Iterator[pa.RecordBatch], columns: list[str], one, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _STEP):
            rows = zip(*(batch.slice(k, _STEP).column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_pylist([x for row in rows for x in one(*row)], schema=schema)


def induced(pages: DataFrame, minimum: int = 3) -> DataFrame:
    """extractor, page_id, container, member, n_members, facts and rows of the listing of every page, as SCHEMA says.

    ``extractor`` is a column of ``pages`` beside page_id, url and html. A page that repeats nothing has no rows and a null container.
    """

    def one(extractor: str | None, page_id: int | None, url: str | None, html: str | None) -> list[dict]:
        tree = load(html)
        container, member, rows = induce(tree, minimum)
        return [{"extractor": extractor, "page_id": page_id, "container": container or None, "member": member or None, "n_members": len(rows), "facts": False, "rows": _resolved(tree, url, rows)}]

    columns = ["extractor", "page_id", "url", "html"]
    return pages.select(*columns).mapInArrow(lambda b: _pages(b, columns, one, _ARROW), SCHEMA)


def wanted(pages: DataFrame) -> DataFrame:
    """As induced(), of the first listing that holds every example of the map ``wanted`` (a column of ``pages``) in a column of its own; paths are the examples' names."""

    def one(extractor: str | None, page_id: int | None, url: str | None, html: str | None, examples: list[tuple[str, str]] | None) -> list[dict]:
        tree = load(html)
        base = base_of(tree, url)
        container, member, rows = induce_wanted(tree, dict(examples or []), base)
        addressed = {n for n, x in examples or [] if any(row.get(n) is not None and row[n] != x and join(base, row[n]) == join(base, x) for row in rows)} | {n for n, x in examples or [] if x.startswith(("/", "http"))}
        cells = [[{"path": n, "value": join(base, v) if n in addressed else v} for n, v in row.items()] for row in rows]
        return [{"extractor": extractor, "page_id": page_id, "container": container or None, "member": member or None, "n_members": len(rows), "facts": facts_of_one_thing(rows), "rows": cells}]

    columns = ["extractor", "page_id", "url", "html", "wanted"]
    return pages.select(*columns).mapInArrow(lambda b: _pages(b, columns, one, _ARROW), SCHEMA)


def replayed(pages: DataFrame) -> DataFrame:
    """As induced(), from the place that the columns ``container`` and ``member`` of ``pages`` name; null where a page hasn't it.

    A member keeps its tag and all classes it was learnt with; it may have gained others. A member that holds nothing is no row.
    """

    def one(extractor: str | None, page_id: int | None, url: str | None, html: str | None, container: str | None, member: str | None) -> list[dict]:
        tree = load(html)
        places = [n for n in tree.iter() if n.tag == (container or "").rpartition(">")[2].partition(".")[0] and path_of(n) == container]
        wanted = set((member or "").split("."))
        found = [c for c in places[0].children if wanted <= set(kind(c).split(".")) | set((c.get("class") or "").split())] if len(places) == 1 else []
        rows = records(found) if found else []
        return [{"extractor": extractor, "page_id": page_id, "container": container if len(places) == 1 else None, "member": member, "n_members": len(found), "facts": facts_of_one_thing(rows), "rows": _resolved(tree, url, rows)}]

    columns = ["extractor", "page_id", "url", "html", "container", "member"]
    return pages.select(*columns).mapInArrow(lambda b: _pages(b, columns, one, _ARROW), SCHEMA)


def rows_long(nested: DataFrame) -> DataFrame:
    """extractor, page_id, row_ix, path and value of every cell."""
    rows = nested.select("extractor", "page_id", F.posexplode("rows").alias("row_ix", "row"))
    return rows.select("extractor", "page_id", "row_ix", F.explode("row").alias("c")).select("extractor", "page_id", "row_ix", "c.path", "c.value")


def selected(pages: DataFrame, selectors: dict[str, str], closed: bool = False) -> DataFrame:
    """page_id, name, nth, value and place of all that named selectors find. A selector that can't be read is an error at once. ``closed`` as for kernels.tree.load()."""
    for text in selectors.values():
        compiled(text)
    schema = pa.schema([("page_id", pa.int64()), ("name", pa.string()), ("nth", pa.int32()), ("value", pa.string()), ("place", pa.string())])

    def one(page_id: int | None, html: str | None) -> list[dict]:
        tree = load(html, closed)
        return [{"page_id": page_id, "name": name, "nth": k, "value": v, "place": w} for name, text in selectors.items() for k, (v, w) in enumerate(compiled(text)(tree))]

    return pages.select("page_id", "html").mapInArrow(lambda b: _pages(b, ["page_id", "html"], one, schema), "page_id long, name string, nth int, value string, place string")


def selected_rows(pages: DataFrame, rows: str, fields: dict[str, str]) -> DataFrame:
    """As induced(), with the elements that ``rows`` finds as members and ``fields`` read inside each, the first value of each."""
    for text in (rows, *fields.values()):
        compiled(text)

    def one(extractor: str | None, page_id: int | None, url: str | None, html: str | None) -> list[dict]:
        tree = load(html)
        members = [n for _, n in found(rows)(tree)]
        out = []
        for m in members:
            top = Node("#row", {}, None)
            top.children = [m]
            cells = {}
            for name, text in fields.items():
                got = found(text)(top)
                if got and squeezed(got[0][0]):
                    cells[name] = got[0][0]
            if cells:
                out.append(cells)
        return [{"extractor": extractor, "page_id": page_id, "container": rows if members else None, "member": rows, "n_members": len(members), "facts": False, "rows": _resolved(tree, url, out)}]

    columns = ["extractor", "page_id", "url", "html"]
    return pages.select(*columns).mapInArrow(lambda b: _pages(b, columns, one, _ARROW), SCHEMA)
