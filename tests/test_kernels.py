import gzip
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrain.kernels import encoded, headers
from loomgrain.kernels.induced import alike, induce
from loomgrain.kernels.markdown import markdown
from loomgrain.kernels.select import BadSelector, compiled
from loomgrain.kernels.tree import load
from loomgrain.kernels.visible import guesses, person
from loomgrain.sources.archives import _streams, records
from loomgrain.sources.robots import _robots, _tdm
from loomgrain.sources.sitemaps import feed, sitemap


@pytest.mark.parametrize(
    ("data", "said", "name"),
    [
        (b"\xef\xbb\xbfhi", "latin1", "utf-8"),
        ("é".encode(), "latin1", "utf-8"),
        (b"\xe9", "iso-8859-2", "iso-8859-2"),
        (b"plain", None, "windows-1252"),
        (b'<meta charset="koi8-r">\xe9', None, "koi8-r"),
        (b'<!-- <meta charset="koi8-r"> -->\xe9', None, "windows-1252"),
        (b"+AGE-", "utf-7", "windows-1252"),
        (b"\xe9", "ascii", "windows-1252"),
    ],
)
def test_encoding(data, said, name):
    assert encoded.sniff(data, said) == name


def test_decoded_of_nothing():
    assert encoded.decoded(None) == encoded.decoded(b"") == ""


def test_link_header():
    found = headers.links('<a,b>; rel="next prev"; title="x\\"y", </c>; rel=alternate; hreflang=de, broken')
    assert [x["target"] for x in found] == ["a,b", "/c"]
    assert found[0]["title"] == 'x"y'
    assert headers.robots("noindex, googlebot: nofollow, max-snippet: 3") == [("*", "noindex"), ("googlebot", "nofollow"), ("googlebot", "max-snippet: 3")]
    assert headers.usage("train-ai=n, search=y;x=1, other=?1") == {"train-ai": "n", "search": "y"}
    assert headers.charset("text/html; charset='UTF-8'") == "utf-8"


@pytest.mark.parametrize(
    ("selector", "values"),
    [
        ("li.a", ["1", "3"]), ("ul > li:nth-child(2)", ["2"]), ("li + li.a::text", ["3"]), ("li:not(.a)", ["2"]), ("a::attr(href)", ["/x"]), ("//li[2]", ["2"]), ("//a/@href", ["/x"]),
        ("li.a, a", ["1", "3", "link"]), ("xpath://li[contains(@class, 'a')]", ["1", "3"]), ("li:contains('2')", ["2"]), ("li[class~=a]", ["1", "3"]), ("nothing", []),
    ],
)
def test_selectors(selector, values):
    tree = load('<ul><li class="a">1<li>2<li class="a b">3</ul><a href="/x">link</a>')
    assert [v for v, _ in compiled(selector)(tree)] == values


@pytest.mark.parametrize("selector", ["", "li:hover(", "//li[position()<3]", "li::text, a", "css:"])
def test_bad_selectors_are_errors(selector):
    with pytest.raises(BadSelector):
        compiled(selector)


def test_induction_passes_over_furniture():
    page = "<nav><ul>" + "<li><a href=/m>menu</a>" * 9 + "</ul></nav><ol>" + "".join(f"<li><b>{k}</b><i>x{k}</i>" for k in range(4)) + "</ol>"
    container, member, rows = induce(load(page))
    assert (container, member, len(rows)) == ("html>body>ol", "li", 4)
    assert rows[2] == {"b": "2", "i": "x2"}


def test_alike_is_two_thirds():
    assert alike(frozenset("ab"), frozenset("abc")) and not alike(frozenset("ab"), frozenset("acd")) and alike(frozenset(), frozenset())


@pytest.mark.parametrize(("text", "name"), [("By Ada Lovelace", "Ada Lovelace"), ("Ludwig van Beethoven, Editor", "Ludwig van Beethoven"), ("Staff Reporter", None), ("Ada", None), ("ada lovelace", None), ("Ada Love1ace", None)])
def test_person(text, name):
    assert person(text) == name


def test_visible_prefers_earlier_rules():
    said = {q: (v, r) for q, v, r, _ in guesses(load('<h1>T</h1><p>Updated <time>2024-01-02</time></p><time datetime="2023-01-01">x</time>'), "https://x/2020/01/02/a")}
    assert said == {"title": ("T", "sole-h1"), "modified": ("2024-01-02", "time"), "published": ("2023-01-01", "time")}
    assert "title" not in {q for q, *_ in guesses(load("<h1>a</h1><h1>b</h1>"), None)}


def test_markdown():
    html = "<body><nav>n</nav><main><h2>A  b</h2>x <em>y</em><ol><li>1<ul><li>in</ul><li>2</ol><pre>a\n b</pre><table><tr><th>h<tr><td>c|d</table><blockquote>q</blockquote></main>"
    assert markdown(load(html), None) == "## A b\n\nx *y*\n\n1. 1\n   - in\n2. 2\n\n```\na\n b\n```\n\n| h |\n| --- |\n| c\\|d |\n\n> q"


def test_robots_groups():
    got = _robots("User-agent: a\nUser-agent: B\nDisallow: /x # no\nnoise\nUser-agent: *\nAllow: /\nSitemap: s")
    assert [(g, a, k, v) for g, a, k, v in got if k != "agent"] == [(0, "a", "disallow", "/x"), (0, "b", "disallow", "/x"), (1, "*", "allow", "/"), (-1, "", "sitemap", "s")]
    assert _tdm('[{"location":"/","tdm-reservation":true},{"location":"/a","tdm-reservation":1}]') == [{"location": "/a", "reservation": "1", "policy": None}]
    assert _tdm("{") == _tdm(None) == []


def test_sitemaps():
    body = b'\n<?xml version="1.0"?><sitemapindex><sitemap><loc>https://x/1</loc></sitemap><sitemap><loc>https://x/2'
    assert [x["address"] for x in sitemap(gzip.compress(body))] == ["https://x/1"]
    assert sitemap("https://x/a\nno\nhttps://x/b\n") == [{"kind": "url", "address": "https://x/a", "modified": None}, {"kind": "url", "address": "https://x/b", "modified": None}]
    assert sitemap('<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>https://x/&a;</loc></url></urlset>') == [] == sitemap(gzip.compress(body)[:-9]) == sitemap(None)


def test_feeds():
    kind, items = feed('<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>t</title><link>/a</link><dc:date>2024</dc:date></item></rdf:RDF>', "https://x/")
    assert kind == "rdf" and items[0]["link"] == "https://x/a" and items[0]["published"] == "2024"
    kind, items = feed('<rss><channel><item><guid isPermaLink="false">7</guid></item><item><guid>https://x/8</guid></item></channel></rss>', None)
    assert [x["link"] for x in items] == [None, "https://x/8"]
    assert feed('{"version":"1"}', None) == (None, []) == feed("<html>", None) == feed(None, None)


def _record(kind, body, mime="application/http; msgtype=response", uri="https://x/"):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {mime}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


class Held:
    """Bytes that are read as a file."""

    def __init__(self, data):
        self.data = data

    def read(self, at, n):
        return self.data[at : at + n]


def archived(data, size=None, largest=16 << 20):
    size = size or max(1, len(data))
    return [r for start in range(0, max(1, len(data)), size) for _, stream in _streams(Held(data), start, min(len(data), start + size)) for r in records(stream, largest)]


def test_archives():
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    packed = gzip.compress("é".encode())
    chunked += f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n"
    data = _record("warcinfo", b"x") + _record("response", chunked) + _record("response", b"HTTP/1.1 404 No\r\n\r\n") + _record("response", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nx") + _record("resource", b"<p>", "text/html")
    want = ["type-warcinfo", "é", "status", "not-html", "<p>"]
    for body in (data, gzip.compress(data), b"".join(map(gzip.compress, [data[:50], data[50:]]))):
        assert [r.get("skipped") or r["html"] for r in archived(body)] == want
    assert [r.get("skipped") for r in archived(gzip.compress(data)[:-20])][-1] == "broken"
    deflated = zlib.compress(b"d")[2:-4]
    assert archived(_record("response", b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + deflated))[0]["html"] == "d"


def test_archives_by_any_range():
    """Members that hold the magic and other archives' members; stored, so that the bytes stand in the file as they are."""
    import random

    rnd = random.Random(1)
    inner = gzip.compress(b"no record") + b"\x1f\x8b\x08\x1f\x1f\x8b\x08"
    bodies = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (inner if k % 3 == 0 else rnd.randbytes(rnd.randrange(300))) + b"<p>%d" % k for k in range(40)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = gzip.compress(b"") + b"".join(gzip.compress(_record("response", b), 0) for b in bodies) + stored.flush()
    whole = [r["html"].rpartition("<p>")[2] for r in archived(data)]
    assert whole == [str(k) for k in range(40)]
    for size in (1, 7, 100, 1000):
        assert [r["html"].rpartition("<p>")[2] for r in archived(data, size)] == whole
    # longer bodies than asked for give a row that says so, from plain and from packed archives
    long = _record("response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"x" * 200_000) + _record("resource", b"<p>", "text/html")
    for body in (long, gzip.compress(long)):
        assert [r.get("skipped") or r["html"] for r in archived(body, largest=1000)] == ["too-large", "<p>"]
        assert len(archived(body, largest=None)[0]["html"]) == 200_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='<>/="\'abdivpul lih1#&;!-\n', max_size=200))
def test_pages_never_raise(html):
    tree = load(html)
    induce(tree)
    guesses(tree, "https://x/")
    markdown(tree, "https://x/")
    compiled("div > p:not(.a)::text")(tree)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_bytes_never_raise(data):
    encoded.decoded(data, "x")
    sitemap(data)
    feed(data, None)
    archived(data)
    archived(_record("response", data))
    archived(gzip.compress(_record("response", data)), 40)
