"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. Archives are written through Spark's text sink, whose line end is
the last byte of every member, so they are committed by task and go to any file system that Spark writes.

The reader's tasks scan byte ranges for the gzip magic, take candidates whose header decodes to the begin of a WARC record, own
those that begin in their range and read each to its end (loomgrain.sources.ranges). In a store that only Spark reads, Spark's text
source cuts the ranges at the magic instead; a cut may also lie inside a compressed member, so pieces that don't decode so continue the
member before them, and what continues a member of the range before is stitched in a second pass by file and place.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm.shared import scratch_path
from loomgrain.sources import ranges

MAGIC = b"\x1f\x8b\x08"
#: The size field ends a member; its last byte is zero below 16 MiB, and behind larger records an empty member follows.
LAST = b"\x00"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def _gzip(data: bytes) -> bytes:
    """A member without its last byte, which the sink adds."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    if member[-1:] != LAST:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += packer.compress(b"") + packer.flush()
    return member[:-1]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit of the page ``first`` that has the same payload."""
    digest = base32_sha1(payload)
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        block = http + payload
    else:
        block = http
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_PAGE}{first}>")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, into: str) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html; null html: empty).

    Of rows with equal payloads those with the smallest page_id are responses, the others revisit it; a null page_id is
    never the smallest unless all are null, and rows that repeat the smallest one are each a response.
    """
    hashed = F.sha2(F.coalesce("html", F.lit("")), 256).alias("h")
    copies = pages.select("page_id", hashed).groupBy("h").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    rows = pages.select("page_id", "url", "html", hashed).join(copies, "h", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                columns = (some.column(n).to_pylist() for n in ("page_id", "url", "html", "refers"))
                members = [_gzip(record(p, u, (h or "").encode(), r)) for p, u, h, r in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    members = rows.select("page_id", "url", "html", refers).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", LAST.decode("latin-1")).text(into)


def _starts(data: bytes) -> bool:
    """Whether a candidate's header decodes and the record in it begins as it should; an empty member does too."""
    if len(data) < 18 or data[3] & 0xE0:
        return False
    try:
        opened = zlib.decompressobj(31)
        said = opened.decompress(data[:4096], 5)
        return said == b"WARC/" or (said == b"" and opened.eof)
    except zlib.error:
        return False


class _Member:
    """A member that may go on in later pieces."""

    def __init__(self, data: bytes) -> None:
        self.raw = [data]
        self.open = zlib.decompressobj(31)
        self.out = [self._more(data)]

    def _more(self, data: bytes) -> bytes:
        try:
            return self.open.decompress(data)
        except zlib.error:
            self.open = None
            return b""

    def add(self, data: bytes) -> None:
        self.raw.append(data)
        self.out.append(self._more(data))

    @property
    def state(self) -> str:
        return "broken" if self.open is None else "whole" if self.open.eof else "open"


def _stitched(pieces: Iterator[bytes], loose: list[bytes] | None) -> Iterator[bytes]:
    """The records of pieces in order. ``loose`` gets what continues an earlier member, and the open member at the end."""
    member = None
    for piece in pieces:
        if member is None:
            if _starts(piece):
                member = _Member(piece)
            elif loose is not None:
                loose.append(piece)
                continue
            else:
                continue
        else:
            member.add(piece)
        if member.state == "whole":
            if said := b"".join(member.out):
                yield said
            member = None
        elif member.state == "broken":
            member = None
    if member is not None and loose is not None:
        loose.append(b"".join(member.raw))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """piece, file and start of its byte range, in the order of the file inside a range."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            for piece, file, start in zip(*(some.column(n).to_pylist() for n in range(3)), strict=True):
                yield (file, start), MAGIC + piece


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    from itertools import groupby
    from operator import itemgetter

    for at, own in groupby(_ranges(batches), key=itemgetter(0)):
        yield at, (piece for _, piece in own)


def _batched(rows: Iterator[bytes], most: int = 4_000_000) -> Iterator[list[bytes]]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _parsed(raw: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """The version line, the headers and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers.append((name.strip().lower(), value.strip()))
    length = dict(headers).get("content-length", "")
    return lines[0], headers, rest[: int(length)] if length.isdigit() else rest


_RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, headers map<string,string>, payload binary"
_FIELDS = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _rows(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for some in _batched(records):
        rows = []
        for raw in some:
            _, headers, block = _parsed(raw)
            said = dict(headers)
            if said.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            bare = lambda x: None if x is None else x.strip("<>")
            rows.append({"record_type": said.get("warc-type"), "record_id": bare(said.get("warc-record-id")), "target_uri": said.get("warc-target-uri"), "refers_to": bare(said.get("warc-refers-to")), "payload_digest": said.get("warc-payload-digest"), "headers": list(said.items()), "payload": block})
        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def read(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """A row for each record of the archives under ``path``, whose members are gzip; ``size``: bytes of a range.

    record_type, record_id, target_uri, refers_to, payload_digest, headers and payload (of an HTTP record its body). Broken
    members give no row. Names without archives raise as every reader of Spark does.
    """
    if not ranges.opens(path):
        return _read_by_spark(spark, path)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for file, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                opened = ranges.Opened(file)
                for _, content in ranges.members(opened, start, stop, b"WARC/"):
                    try:
                        raw = content.read()
                    except (EOFError, zlib.error):
                        continue
                    if raw:
                        yield raw
                opened.close()

    return ranges.cut(spark, path, size).mapInArrow(lambda batches: _rows(records(batches)), _RECORD)


def _read_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """As read(), through Spark's text source; it would inflate files that end in .gz, so those raise."""
    if not spark.read.format("binaryFile").load(path).select("path").where(F.lower("path").endswith(".gz")).isEmpty():
        raise ValueError("archives that end in .gz are read only where pyarrow has a file system for their path")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(record for _, pieces in _by_range(batches) for record in _stitched(pieces, None))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), pieces in _by_range(batches):
            loose: list[bytes] = []
            for _ in _stitched(pieces, loose):
                pass
            if loose:
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(loose)), pa.array([start] * len(loose), pa.int64()), pa.array(range(len(loose)), pa.int64()), pa.array(loose, pa.binary())], names=["file", "start", "nth", "piece"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (row for batch in batches for row in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True))
        yield from _rows(record for _, own in groupby(rows, key=lambda x: x[0]) for record in _stitched((piece for _, piece in own), None))

    pieces = _pieces(spark, path)
    # an open member that ends no range is broken; _stitched gives it up when the next range begins
    loose = pieces.mapInArrow(left, "file string, start long, nth long, piece binary").repartition("file").sortWithinPartitions("file", "start", "nth")
    return pieces.mapInArrow(owned, _RECORD).unionByName(loose.mapInArrow(joined, _RECORD))


def digest(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records that write() made.

    ``found``: the records as read() gives them, where they were read already. A response's figures are those of the payload read back, a revisit's are those in its header.
    """
    found = read(spark, path) if found is None else found
    kept = F.col("record_type") == "response"
    page = lambda c: F.expr(f"try_cast(substr({c}, {len(_PAGE) + 1}) as bigint)")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [None if p is None else base32_sha1(p) for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digests, pa.string())], names=[*batch.schema.names[:-1], "payload_digest"])

    rows = found.select(
        page("record_id").alias("page_id"),
        F.when(kept, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["payload-length"].cast("long")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("said"),
        "record_type",
        page("refers_to").alias("refers_to"),
        F.when(kept, F.col("payload")).alias("payload"),
    )
    told = rows.mapInArrow(own, "page_id long, payload_bytes long, said string, record_type string, refers_to long, payload_digest string")
    return told.select("page_id", "payload_bytes", F.coalesce("payload_digest", "said").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and gives the digest of what is read back."""
    into = scratch_path(pages.sparkSession, "warc")
    write(pages, into)
    return digest(pages.sparkSession, into)


#: The query in DuckDB's SQL; 32 letters of five bits each spell a SHA-1.
SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as least, rpad(cast(cast(unhex(sha1(h)) as bit) as varchar), 160, '0') as bits from p group by h),
t as (
  select page_id, strlen(h) as payload_bytes, least,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast(1 + list_sum(list_transform(range(0, 5), lambda j: cast(bits[5 * i + j + 1] as int) * (16 >> j))) as bigint)]), '') as payload_digest
  from p join f using (h))
select page_id, payload_bytes, payload_digest, case when least is distinct from page_id and least is not null then 'revisit' else 'response' end as record_type,
  case when least is distinct from page_id then least end as refers_to
from t"""
