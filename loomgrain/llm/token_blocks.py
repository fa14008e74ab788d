"""Token ids in files of patched frame-of-reference blocks.

A file is a Parquet part that Spark commits whole; it holds one shard, a run of documents in ascending
doc_id order, as rows of segments. A segment is self-contained: whole documents of about SEGMENT ids. Its
``data`` is

    magic "LGT1" | n_docs, n_ids, n_blocks: uint32 | n_ids of each document: uint32
    start of each block, in bytes from the first block: uint32
    blocks

and a block of up to BLOCK ids is

    minimum: uint32 | width: uint8 | exceptions: uint16 | packed low bits, little end first
    place of each exception: uint16 | high bits of each exception: uint32

The width is that which a PERCENTILE of the block's offsets from its minimum fits, or a wider one where that
makes the block shorter; larger offsets keep their low bits in place and their high bits in the exceptions.
With the block starts any id is reached by decoding one block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.llm.bpe import byte_signs
from loomgrain.llm.shared import scratch_path, slices

MAGIC = b"LGT1"
BLOCK = 1024
PERCENTILE = 90
SEGMENT = 262_144
#: Distinct words that a worker remembers; beyond them it begins anew.
REMEMBERED = 1_000_000
#: The last sign for which the library's cut into words was compared with the one here.
LAST_CUT = 0x1FFFF
LETTER, NUMBER, SPACE, OTHER = range(4)


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """``n`` values of ``width`` bits from a byte array that has eight spare bytes behind them."""
    if width == 0:
        return np.zeros(n, np.uint32)
    bit = np.arange(n, dtype=np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 1 to 65,535 ids."""
    low = int(ids.min())
    offsets = ids - np.uint32(low)
    widths = np.frexp(offsets.astype(np.float64))[1]
    at_percentile = int(np.partition(widths, k := (len(ids) * PERCENTILE + 99) // 100 - 1)[k])
    counts = np.bincount(widths, minlength=33)
    beyond = len(ids) - np.cumsum(counts)
    # exceptions cost six bytes each, so a wider packing can be shorter; never narrower than the percentile
    width = min(range(at_percentile, 33), key=lambda w: len(ids) * w + 48 * int(beyond[w]))
    out = np.flatnonzero(widths > width)
    packed = _pack(offsets, width)
    high = (offsets[out].astype(np.uint64) >> np.uint64(width)).astype("<u4")
    return struct.pack("<IBH", low, width, len(out)) + packed + out.astype("<u2").tobytes() + high.tobytes()


def decode_block(data: bytes | memoryview, n: int) -> np.ndarray:
    low, width, m = struct.unpack_from("<IBH", data)
    end = 7 + (n * width + 7) // 8
    values = _unpack(np.frombuffer(bytes(data[7:end]) + bytes(8), np.uint8), n, width)
    if m:
        at = np.frombuffer(data, "<u2", m, end)
        high = np.frombuffer(data, "<u4", m, end + 2 * m).astype(np.uint64)
        values[at] |= (high << np.uint64(width)).astype(np.uint32)
    return values + np.uint32(low)


def encode_segment(lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents with so many ids each."""
    blocks = [encode_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    head = struct.pack("<III", len(lengths), len(ids), len(blocks))
    return b"".join([MAGIC, head, np.array(lengths, "<u4").tobytes(), starts.astype("<u4").tobytes(), *blocks])


def segment_index(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The documents' lengths, the block starts, where the blocks begin, and the number of ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks = struct.unpack_from("<III", data, 4)
    return np.frombuffer(data, "<u4", docs, 16), np.frombuffer(data, "<u4", blocks, 16 + 4 * docs), 16 + 4 * (docs + blocks), n


def decode_range(data: bytes, begin: int, end: int) -> np.ndarray:
    """The ids of places begin .. end-1, from the blocks that hold them."""
    _, starts, base, n = segment_index(data)
    view, end = memoryview(data), min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    first, last = begin // BLOCK, (end - 1) // BLOCK
    found = [decode_block(view[base + int(starts[k]) :], min(BLOCK, n - k * BLOCK)) for k in range(first, last + 1)]
    return np.concatenate(found)[begin - first * BLOCK : end - first * BLOCK]


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the documents, and all ids; blocks of one width are unpacked together."""
    lengths, starts, base, n = segment_index(data)
    ids = np.zeros(n, np.uint32)
    if n == 0:
        return lengths, ids
    raw = np.frombuffer(data + bytes(8), np.uint8)
    at = base + starts.astype(np.int64)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, exceptions = raw[at + 4], raw[at[:, None] + np.arange(5, 7)].copy().view("<u2")[:, 0]
    size = np.minimum(BLOCK, n - np.arange(len(at)) * BLOCK)
    full = size == BLOCK
    for w in np.unique(width[full]).tolist():
        own = np.flatnonzero(full & (width == w))
        span = BLOCK * w // 8
        data_of = raw[(at[own] + 7)[:, None] + np.arange(span)] if w else np.zeros((len(own), 0), np.uint8)
        values = _unpack(np.concatenate([data_of.reshape(-1), np.zeros(8, np.uint8)]), BLOCK * len(own), w).reshape(-1, BLOCK)
        ids[(own[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)] = (values + low[own][:, None]).reshape(-1)
    for k in np.flatnonzero(full & (exceptions > 0)).tolist():
        m, w = int(exceptions[k]), int(width[k])
        end = int(at[k]) + 7 + BLOCK * w // 8
        place = np.frombuffer(data, "<u2", m, end).astype(np.int64)
        high = np.frombuffer(data, "<u4", m, end + 2 * m).astype(np.uint64) << np.uint64(w)
        ids[k * BLOCK + place] += high.astype(np.uint32)
    for k in np.flatnonzero(~full).tolist():
        ids[k * BLOCK : k * BLOCK + int(size[k])] = decode_block(memoryview(data)[int(at[k]) :], int(size[k]))
    return lengths, ids


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every sign up to the last that is cut here."""
    signs = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, LAST_CUT + 1)]))
    found = np.full(len(signs), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, signs):
            found[m.start() : m.end()] = kind
    return found


def cut(signs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin by the byte-level pre-tokenizer's pattern, in code points of texts that lie one behind the other.

    first: whether a text begins at each place. Runs of letters, numbers or other signs are words, with one space before them;
    of a run of white space the last sign stands alone or goes with the word behind it; and an apostrophe that begins a word
    takes a contraction's letters from the run behind it.
    """
    n = len(signs)
    kind = _classes()[signs if signs.dtype == np.uint8 else np.minimum(signs, LAST_CUT)]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begins = run.copy()
    inside = ~first[1:]
    begins[1:] &= ~(~space[1:] & (signs[:-1] == 0x20) & inside)
    begins[:-1] |= space[:-1] & ~space[1:] & inside
    quote = np.flatnonzero(begins & (signs == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~first[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        end = np.append(np.flatnonzero(run), n)
        end = end[np.searchsorted(end, quote + 1, side="right")]  # of the letters' run
        one, two = signs[quote + 1], np.where(quote + 2 < end, signs[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken = np.where(short, 1, np.where(long, 2, 0))
        has = taken > 0
        begins[quote[has] + 1] = False
        rest = quote[has] + 1 + taken[has]
        begins[rest[rest < end[has]]] = True
    return begins


class Encoder:
    """Ids as ``tokenizers`` gives them for a file of byte-level BPE.

    The library's model encodes each distinct word once a worker; cut() finds the words, as the library's pre-tokenizer does. A text with a special string or with a sign beyond
    LAST_CUT, for which the two cuts weren't compared, is encoded by the library as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.theirs = Tokenizer.from_file(path)
        self.theirs.no_truncation()
        self.theirs.no_padding()
        self.special = [x.content for x in self.theirs.get_added_tokens_decoder().values()]
        self.signs = {b: c for c, b in byte_signs().items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        self.known |= {w: k for k, w in enumerate(words, len(self.known))}
        got = [[t.id for t in self.theirs.model.tokenize(w.decode("latin-1").translate(self.signs))] for w in words]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (null: empty), and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        column = column.fill_null("").cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = memoryview(column.buffers()[2] or b"")[int(edges[0]) : int(edges[-1])]
        edges = edges - edges[0]
        text = str(raw, "utf-8")
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if len(text) == len(raw):
            signs, at = np.frombuffer(raw, np.uint8), None
        else:
            signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        ends = edges if at is None else np.searchsorted(at, edges)
        first = np.zeros(len(signs) + 1, bool)
        first[ends] = True
        begins = np.flatnonzero(cut(signs, first[:-1]))
        whole = {k for k in range(len(column)) if any(s.encode() in raw[edges[k] : edges[k + 1]].tobytes() for s in self.special)} if any(s in text for s in self.special) else set()
        whole |= set((np.searchsorted(ends, np.flatnonzero(signs > LAST_CUT), side="right") - 1).tolist())
        offsets = np.append(begins if at is None else at[begins], len(raw)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self.known])
        codes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.sizes[codes]
        after = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.begins[codes] - (after - sizes), sizes) + np.arange(int(after[-1]))]
        cuts = np.append(0, after)[np.searchsorted(begins, ends)]
        if whole:
            parts = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            for k in whole:
                parts[k] = np.array(self.theirs.encode(str(raw[edges[k] : edges[k + 1]], "utf-8"), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, np.diff(cuts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def write(docs: DataFrame, into: str, path: str, end_id: int = 0) -> None:
    """Writes the ids of every whole text (null: empty) with ``end_id`` behind each, in ascending doc_id order.

    A shard is a range of doc_ids, ties in order of their texts' hashes, null ids first. Columns of a file: shard,
    segment, first (ids of the shard before the segment), n_docs, n_ids, doc_ids, data.
    """
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(path), TaskContext.get().partitionId()
        segment, first = 0, 0
        lengths: list[int] = []
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        waiting = 0

        def closed() -> pa.RecordBatch:
            nonlocal segment, first, waiting
            ids = np.concatenate(parts)
            row = [[shard], [segment], [first], [len(lengths)], [len(ids)], [list(names)], [encode_segment(lengths, ids)]]
            segment, first, waiting = segment + 1, first + len(ids), 0
            for x in (lengths, names, parts):
                x.clear()
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "segment", "first", "n_docs", "n_ids", "doc_ids", "data"])

        for batch in slices(batches, "text"):
            flat, counts = own.encode(batch.column("text"))
            ends = np.cumsum(counts + 1)
            ids = np.full(int(ends[-1]), end_id, np.uint32)
            held = np.ones(len(ids), bool)
            held[ends - 1] = False
            ids[held] = flat
            begin = 0
            for doc, n, end in zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist(), ends.tolist(), strict=True):
                names.append(doc)
                lengths.append(n)
                waiting += n
                if waiting >= SEGMENT:
                    parts.append(ids[begin:end])
                    begin = end
                    yield closed()
            if begin < len(ids):
                parts.append(ids[begin:])
        if waiting:
            yield closed()

    ordered.mapInArrow(run, "shard long, segment long, first long, n_docs long, n_ids long, doc_ids array<long>, data binary").write.option("compression", "zstd").parquet(into)


def shard_starts(files: DataFrame) -> DataFrame:
    """(shard, base): ids before each shard. One row a shard, from the length columns alone."""
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of long) of every document of the files."""
    return _documents(spark, path, "ids array<long>", lambda ids, lengths: pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), pa.array(ids.astype(np.int64))))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""

    def crc(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        ends = np.cumsum(lengths, dtype=np.int64)
        raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
        return pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())

    return _documents(spark, path, "ids_crc32 long", crc)


def _documents(spark: SparkSession, path: str, column: str, make) -> DataFrame:
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, names, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lengths, ids = decode_segment(data)
                start = first + np.cumsum(lengths, dtype=np.int64) - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([shard] * len(names), pa.int64()), pa.array(start), pa.array(lengths.astype(np.int64)), make(ids, lengths)],
                    names=["doc_id", "shard", "first", "n_tokens", column.split()[0]],
                )

    found = files.select("shard", "first", "doc_ids", "data").mapInArrow(run, f"doc_id long, shard long, first long, n_tokens long, {column}")
    return found.join(shard_starts(files), "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", column.split()[0])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and gives the digest of what the files hold."""
    into = scratch_path(docs.sparkSession, "token-blocks")
    write(docs, into, path)
    return digest(docs.sparkSession, into)
