import base64
import gzip
import hashlib
import random
from collections import defaultdict

from loomgrain.llm import warc
from loomgrain.llm.shared import scratch_path
from tests.llm.helpers import LONG

SCHEMA = "page_id long, url string, html string, headers string, h string"
ROWS = [
    (3, "http://a/", "same"), (1, "http://b/ x", "same"), (2, None, "same"), (4, "http://c/", None), (5, "http://d/", ""),
    (6, "http://e/", LONG), (None, "http://f/", "same"), (None, "http://g/", "lone"), (7, "http://h/", "é\r\n\r\n\x00WARC/1.1"), (7, "http://h/", "é\r\n\r\n\x00WARC/1.1"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def want(rows):
    ids = defaultdict(list)
    for page, _, html in rows:
        ids[html or ""].append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        named = [p for p in ids[html or ""] if p is not None]
        first = min(named) if named else None
        revisit = first is not None and page != first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark):
    got = warc.round_trip(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == want(ROWS)
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_any_split_gives_the_same_records(spark):
    rnd = random.Random(5)
    rows = [(k, f"http://x/{k}", "".join(chr(rnd.randrange(32, 3000)) for _ in range(rnd.randrange(1, 4000)))) for k in range(60)]
    # stored members hold the magic itself, so cuts fall inside them
    into = scratch_path(spark, "test")
    warc.write(frame(spark, rows).coalesce(2), into)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("777", "5000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, warc.digest(spark, into, warc._read_by_spark(spark, into)).collect()), key=str) == want(rows)
            assert sorted(map(tuple, warc.digest(spark, into, warc.read(spark, into, int(size))).collect()), key=str) == want(rows)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_magic_inside_a_member():
    import zlib

    inner = gzip.compress(b"no record") + b"\x1f\x8b\x08\x1f\x1f\x8b\x08"
    raws = [warc.record(k, "http://x", p, None) for k, p in enumerate((b"first", inner, b"last"))]
    data = b""
    for raw in raws:
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        data += packer.compress(raw) + packer.flush()
    pieces = [warc.MAGIC + p for p in data.split(warc.MAGIC)[1:]]
    assert len(pieces) > 3
    assert list(warc._stitched(iter(pieces), None)) == raws
    # cut into two ranges at any piece, what the ranges leave is stitched by the second pass
    for cut in range(len(pieces) + 1):
        loose, got = [], []
        for part in (pieces[:cut], pieces[cut:]):
            got += warc._stitched(iter(part), loose)
        got += warc._stitched(iter(loose), None)
        assert [x for x in raws if x in got] == raws


def test_records_are_plain_gzip(spark):
    into = scratch_path(spark, "test")
    warc.write(frame(spark, ROWS[:3]).coalesce(1), into)
    data = b"".join(r[0] for r in spark.read.format("binaryFile").load(into).select("content").collect())
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit") == 2
    assert {r["target_uri"] for r in warc.read(spark, into).collect()} == {"http://a/", "http://b/%20x", None}


def test_broken_members_are_left_out(spark):
    good = [warc._gzip(warc.record(k, "http://x", b"payload %d" % k, None)) + b"\x00" for k in range(3)]
    pieces = [good[0], good[1][:40], good[2]]
    assert len(list(warc._stitched(iter(pieces), None))) >= 1


def test_names_that_end_in_gz(spark, tmp_path):
    import pytest

    data = b"".join(warc._gzip(warc.record(k, "http://x", b"payload %d" % k, None)) + b"\x00" for k in range(50))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(data[: len(data) // 2])
    for size in (100, 1 << 20):
        got = [bytes(r["payload"]) for r in warc.read(spark, f"file://{tmp_path}/*.gz", size).collect()]
        assert sorted(set(got)) == sorted(b"payload %d" % k for k in range(50)) and 70 <= len(got) <= 75
    with pytest.raises(ValueError, match="gz"):
        warc._read_by_spark(spark, f"file://{tmp_path}/*.gz")


def test_the_sql_twin(spark, tmp_path):
    import duckdb

    frame(spark, ROWS).write.parquet(f"{tmp_path}/pages")
    told = duckdb.connect()
    told.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(told.sql(warc.SQL).select(*columns).fetchall(), key=str) == want(ROWS)
