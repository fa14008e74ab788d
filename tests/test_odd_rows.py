"""Queries against their SQL over rows that the small tables don't hold."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from loomgrain.kernels.tree import load
from loomgrain.plans.registry import QUERIES, SQL

from .test_queries_match_sql import _plain


def _alike(spark, folder, name, table, rows):
    """Whether a query over a table with these rows gives its SQL's rows."""
    con = duckdb.connect()
    con.execute(f"create table {table} as {rows}")
    con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    want = con.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    return got == Counter(tuple(map(_plain, r)) for r in want)


_PAGES = """select i as page_id, 'https://x.example/' || i as url, '<html lang="en"><head><title>' || t || '</title><script>var a = "&amp";</script></head><body><h1>' || t || '</h1></body></html>' as html
 from (select unnest(range(6)) as i, unnest(['a &amp;&amp; b&amp', 'a &lt b', 'a & b', '&amp;lt; &quot;x&quot;', 'x &#39y&#39;', 'plain']) as t)"""


@pytest.mark.parametrize("name", ["archive_extract", "pages_first_heading"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    assert _alike(spark, tmp_path, name, "pages", _PAGES)


def test_references_are_read_as_browsers_do_unless_asked():
    html = '<h1 title="a&ampb">a&amp</h1><script>"&amp"</script>'
    assert [n.words() for n in load(html).iter() if n.tag in ("h1", "script")] == ["a&", '"&amp"']
    assert [n.words() for n in load(html, closed=True).iter() if n.tag in ("h1", "script")] == ["a&amp", '"&amp"']


def test_negative_zero_keeps_its_sign(spark, tmp_path):
    assert _alike(spark, tmp_path, "page_table_csv_safe", "events", "select i as event_id, 'view' as event_type, v as value from (select unnest([1, 4, 7, 10, 13, 2, 3]) as i, unnest([0.0, -0.0, 0.004, -0.004, 7.125, 0.0, 0.0]::double[]) as v)")


_JSON = '{"version":"https://jsonfeed.org/version/1.1","items":['


@pytest.mark.parametrize(
    "text",
    ['<rss version="2.0"><channel>' + "".join(f"<item><title>Order {k}</title><link>/o/{k}</link></item>" for k in range(30_000)) + "</channel></rss>", _JSON + ",".join(f'{{"id":{k},"title":"Order {k}","url":"/o/{k}"}}' for k in range(30_000)) + "]}"],
    ids=["rss", "json"],
)
def test_a_feed_costs_no_memory_but_its_text(text):
    import tracemalloc

    from loomgrain.sources import sitemaps

    tracemalloc.start()
    n = sum(x["title"] == f"Order {k}" and x["link"] == f"https://x/o/{k}" for k, x in enumerate(sitemaps._items(text, "https://x/")[1]))
    assert n == 30_000 and tracemalloc.get_traced_memory()[1] < len(text)
    tracemalloc.stop()


@pytest.mark.parametrize(("text", "titles"), [(_JSON + '{"title":"a"},]}', None), (_JSON + '{"title":"a"}]} x', None), (_JSON + "]}", []), (_JSON + '{"title":"a"}],"items":[{"title":"b"}, 3]}', ["b"]), ("<rss><channel><item><title>a</title></item><item><title>b", ["a"])])
def test_broken_and_repeated_lists_of_feeds(text, titles):
    from loomgrain.sources import sitemaps

    kind, items = sitemaps.feed(text, None)
    assert (kind is None) == (titles is None) and [x["title"] for x in items] == (titles or [])
