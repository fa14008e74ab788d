"""Nulls, empty tables, ties, and the same answer however the rows are dealt."""

import pytest
from pyspark.sql import functions as F

from loomgrain.operators import audit, contract, crawl, declared, diff, extract, readings, rows
from loomgrain.sources import archives, robots, sitemaps

PAGES = "extractor string, page_id long, url string, html string"


def _page(k, values, cls="v"):
    return ("s", k, "https://x/", "<ol>" + "".join(f'<li class="r"><b class="{cls}">{v}</b><i>n{j}</i>' for j, v in enumerate(values)) + "</ol>")


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def learnt(spark):
    pages = spark.createDataFrame([_page(0, "10.50 11.50 12.50 13.50 14.50 15.50".split()), _page(1, "20.50 21.50 22.50 23.50 24.50 25.50".split())], PAGES)
    nested = rows.induced(pages)
    listing, columns = contract.learn(nested)
    # as tables, so that each test doesn't learn again
    return spark.createDataFrame(listing.collect(), listing.schema), spark.createDataFrame(columns.collect(), columns.schema)


def _failed(spark, learnt, page):
    listing, columns = learnt
    found = contract.checks(contract.replay(spark.createDataFrame([page], PAGES), listing), listing, columns)
    return {(r["kind"], r["name"]) for r in found.where("not ok").collect()}


@pytest.mark.parametrize(
    ("page", "failed"),
    [
        (_page(7, "1.50 2.50 3.50 4.50 5.50".split()), set()),
        (_page(7, ["ask"] * 3), {("reads", "b.v")}),
        (_page(7, ["2.50"] * 6), {("values", "b.v")}),
        (_page(7, "1.50 2.50 3.50".split(), "other"), {("field", "b.v")}),
        (("s", 7, "https://x/", "<p>none</p>"), {("rows", "rows")}),
        (("s", 7, None, None), {("rows", "rows")}),
        (("unknown", 7, "https://x/", "<p>"), set()),
    ],
)
def test_a_contract_finds_drift_and_nothing_else(spark, learnt, page, failed):
    assert _failed(spark, learnt, page) == failed


def test_heal_follows_values_and_reports_what_is_gone(spark, learnt):
    moved = spark.createDataFrame([_page(9, "10.50 11.50 12.50 13.50 14.50 15.50".split(), "price")], PAGES)
    assert {(r["kind"], r["name"], r["path"]) for r in contract.heal(learnt[1], rows.induced(moved)).collect()} == {("moved", "b.v", "b.price"), ("kept", "i", "i")}
    gone = spark.createDataFrame([_page(9, ["a", "b", "c"], "other")], PAGES)
    found = contract.heal(learnt[1], rows.induced(gone))
    assert {(r["kind"], r["name"]) for r in contract.losses(found).collect()} == {("vanished", "b.v")}


def test_empty_tables(spark, learnt):
    none = spark.createDataFrame([], PAGES)
    parsed = declared.parse(none)
    extracted = extract.extract(none)
    frames = [
        rows.rows_long(rows.induced(none)), contract.learn(rows.induced(none))[1], contract.checks(contract.replay(none, learnt[0]), *learnt), contract.heal(learnt[1], rows.induced(none)).where("kind <> 'vanished'"),
        extract.summary(extracted), extract.conflicts(extracted), audit.missing(extracted), audit.page_findings(parsed), readings.visible(none), readings.as_markdown(none), readings.by_syntax(none),
        sitemaps.sitemap_urls(spark.createDataFrame([], "file string, body string")), robots.robots_rules(spark.createDataFrame([], "site string, text string")),
    ]
    for df in frames:
        assert df.count() == 0


def test_null_pages(spark):
    pages = spark.createDataFrame([("s", None, None, None), (None, 1, "https://x/", ""), ("s", 2, None, "<h1>a")], PAGES)
    assert extract.summary(extract.extract(pages)).count() == 3
    assert {(r["page_id"], r["value"]) for r in readings.visible(pages).collect()} == {(2, "a")}
    assert rows.induced(pages).where("container is not null").count() == 0


def test_the_same_answer_however_rows_are_dealt(spark):
    pages = spark.createDataFrame([_page(k, [f"{k}{j}.5" for j in range(5)]) for k in range(12)], PAGES)
    one, many = ({"listing": _rows(a), "columns": _rows(b)} for a, b in (contract.learn(rows.induced(pages.repartition(n))) for n in (1, 7)))
    assert one == many


def test_crawl_order_limits_and_names(spark):
    links = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("c", 1, "e"), ("d", 0, "a"), ("e", 0, "f")], "source string, ord int, target string")
    got = crawl.crawl(links, "a", max_pages=4, max_depth=3).orderBy("place").collect()
    assert [(r["address"], r["depth"], r["found_on"]) for r in got] == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")]
    known = spark.createDataFrame([("b", "d")], "address string, other string")
    assert {r["address"] for r in crawl.crawl(links, "a", None, 9, also=known).collect()} == set("abcef")
    assert [r["address"] for r in crawl.crawl(links, "a", 10, 0).collect()] == ["a"]


def test_diff_kinds(spark):
    schema = "page_id long, question string, value string"
    before = spark.createDataFrame([(1, "price", "10"), (1, "currency", "EUR"), (2, "price", "$10"), (3, "title", "a"), (4, "title", "same"), (5, "published", "2024-01-02")], schema)
    after = spark.createDataFrame([(1, "price", "€10.00"), (1, "currency", "EUR"), (2, "price", "€10"), (3, "url", "b"), (4, "title", "same"), (5, "published", "2 January 2024")], schema)
    assert {(r["page_id"], r["question"]): r["kind"] for r in diff.compare(before, after).collect()} == {(1, "price"): "rewritten", (2, "price"): "changed", (3, "title"): "removed", (3, "url"): "added", (5, "published"): "rewritten"}


@pytest.mark.parametrize(
    ("pattern", "target", "fits"),
    [("/", "/a", True), ("/a", "/b", False), ("/*.php$", "/x.php", True), ("/*.php$", "/x.php?a", False), ("/a*b*c", "/a1b2c3", True), ("/a*b*c", "/acb", False), ("/a$", "/a", True), ("/a$", "/ab", False), ("*", "/x", True), ("/a*a$", "/a", False), ("/x*", "/x", True)],
)
def test_path_patterns(spark, pattern, target, fits):
    assert spark.range(1).select(robots.path_matches(F.lit(target), F.lit(pattern)).alias("x")).first()["x"] is fits


def test_archives_from_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>t</title>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://x/\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + body + b"\r\n\r\n" + head.replace(b"response", b"request"))
    found = archives.read(spark, f"file://{tmp_path}/*.warc")
    assert [r["html"] for r in found.where("html is not null").collect()] == ["<title>t</title>"]
    assert {(r["reason"], r["n"]) for r in archives.skipped(found).collect()} == {("type-request", 1)}
    import gzip

    members = b"".join(gzip.compress(head.replace(b"https://x/", b"https://x/%05d" % k).replace(b"Type: response", b"Type: response") + body + b"\r\n\r\n") for k in range(200))
    (tmp_path / "b.warc.gz").write_bytes(members)
    for size in (1000, 1 << 20):
        rows = archives.read(spark, f"file://{tmp_path}/*.warc.gz", size=size).collect()
        assert sorted(r["url"] for r in rows) == [f"https://x/{k:05d}" for k in range(200)] and {r["html"] for r in rows} == {"<title>t</title>"}


def test_command_line(spark, tmp_path):
    from loomgrain.__main__ import COMMANDS, main, parser
    from loomgrain.sources import files

    html = "<html><head><title>t</title></head><body><ol>" + "".join(f'<li class="row"><b>n{k}</b><i>{k}.50</i></li>' for k in range(6)) + "</ol></body></html>"
    spark.createDataFrame([(1, "https://x/", html), (2, "https://x/2", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    for name in COMMANDS:
        assert parser().parse_args([name, "in", "out", *(["--contracts", "c"] if name in ("run", "heal") else [])]).command == name
    assert main(["answers", f"{tmp_path}/pages", f"{tmp_path}/answers", "--format", "csv"]) == 0
    assert [r["value"] for r in spark.read.option("header", True).csv(f"{tmp_path}/answers").collect()] == ["t"]
    assert main(["learn", f"{tmp_path}/pages", f"{tmp_path}/learnt", "--format", "jsonl"]) == 0
    assert main(["run", f"{tmp_path}/pages", f"{tmp_path}/checks", "--contracts", f"{tmp_path}/learnt"]) == 0
    found = spark.read.parquet(f"{tmp_path}/checks")
    assert found.where("page_id = 1 and not ok").count() == 0 and found.where("page_id = 2 and not ok").count() == 1
    assert main(["heal", f"{tmp_path}/pages", f"{tmp_path}/healed", "--contracts", f"{tmp_path}/learnt"]) == 0
    assert {r["kind"] for r in spark.read.parquet(f"{tmp_path}/healed").collect()} == {"kept"}
    # lines that another writer left unfinished are no rows
    (tmp_path / "lines.json").write_text('{"url":"a","n":1}\n{"url":"b","n"')
    done = files.read_jsonl(spark, f"{tmp_path}/lines.json", "url string, n long")
    assert [tuple(r) for r in done.collect()] == [("a", 1)]
    assert [r["url"] for r in files.left_to_do(spark.createDataFrame([("a",), ("b",)], "url string"), done).collect()] == ["b"]
    assert files.settings('{"depth": 3}', {"depth": int}) == {"depth": 3}
    for bad in ('{"deep": 3}', '{"depth": "3"}', "[]"):
        with pytest.raises(ValueError):
            files.settings(bad, {"depth": int})


def test_facts_of_one_thing_are_no_listing():
    from loomgrain.kernels.induced import facts_of_one_thing, induce, induce_wanted, says
    from loomgrain.kernels.tree import load

    rows = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in (("Brand", "Acme"), ("Weight", "12 kg"), ("Price", "$ 10.00"), ("Added", "2024-01-02")))
    list_ = "".join(f'<li><a href="/p/{k}">thing {k}</a><b>{k}.00</b></li>' for k in range(4))
    tree = load(f"<table>{rows}</table><ul>{list_}</ul>")
    assert facts_of_one_thing([{"a": "Brand", "b": "Acme"}, {"a": "Price", "b": "$ 10.00"}, {"a": "Added", "b": "2024-01-02"}])
    assert not facts_of_one_thing([{"a": f"n{k}", "b": f"{k}.00"} for k in range(4)])
    assert induce(tree)[2][0]["b"] == "0.00"
    container, _, found = induce_wanted(tree, {"what": "thing 2", "cost": "$2", "where": "/p/2"}, "https://x/")
    assert container.endswith("ul") and found[2] == {"what": "thing 2", "cost": "2.00", "where": "/p/2"} and len(found) == 4
    # two names of one value need two columns that hold it
    assert induce_wanted(tree, {"one": "thing 2", "two": "thing 2"}, None)[2] == []
    assert says("1.299,50 €", "1,299.50") and says(" a  b", "a b") and not says("L12", "12") and not says("12", "13")
