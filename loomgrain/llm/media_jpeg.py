"""Media columns of baseline JPEG.

The reader parses markers, undoes byte stuffing, and Huffman-decodes the scans of many images at once: every
restart interval is a lane, and all lanes decode their next symbol together in numpy. Of the luminance
blocks it keeps the DC terms, which make a thumbnail of one pixel a block, and hashes it beside the dimensions.

The writer stores bytes losslessly as quantised coefficients, the units that a JPEG keeps exactly: 192 bytes are the three blocks of
one MCU, in zigzag order, with a quantiser of one and a restart marker behind every MCU. A byte becomes a coefficient from
-128 to 128 that is never zero, so each takes one symbol.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgrain.llm.shared import slices, written

MCU = 192
#: MCUs in a row at most; a side has 65,535 pixels at most.
ROW = 8191
#: Lanes that are decoded together.
LANES = 32_768
#: Code lengths by magnitude category, short for those of small letters.
LENGTHS = {5: 1, 4: 2, 7: 3, 6: 4, 3: 5, 2: 6, 1: 7, 8: 8, 0: 9}


class NotBaseline(ValueError):
    """The bytes are no baseline JPEG that can be read whole."""


def _table() -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The counts and symbols of a Huffman table, and (code, length) by symbol."""
    symbols = sorted(LENGTHS, key=LENGTHS.__getitem__)
    counts = bytearray(16)
    codes, code, before = {}, 0, 0
    for s in symbols:
        n = LENGTHS[s]
        counts[n - 1] += 1
        code <<= n - before
        codes[s] = (code, n)
        code, before = code + 1, n
    return bytes(counts) + bytes(symbols), codes


_DHT, _CODES = _table()


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The bits and their number for each byte; DC and AC terms have the same table here."""
    bits, lengths = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for b in range(256):
        v = b - 128 if b < 128 else b - 127
        s = abs(v).bit_length()
        code, n = _CODES[s]
        bits[b] = code << s | (v if v > 0 else v + (1 << s) - 1)
        lengths[b] = n + s
    return bits, lengths


_BITS, _LENGTHS = _symbols()
_EMPTY = sum(((_CODES[0][0] << 9 | _CODES[0][0]) << (18 * k)) for k in range(3))  # three blocks of zeros: 54 bits
_EMPTY_MCU = ((_EMPTY << 2 | 3).to_bytes(7, "big")).replace(b"\xff", b"\xff\x00")


def _lanes(payload: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of MCUs, each with the restart marker before it (but the first of an image), and their lengths."""
    n = len(payload) // MCU
    lengths = _LENGTHS[payload].reshape(n, MCU)
    ends = np.cumsum(lengths, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(sizes) - sizes
    at = (starts[:, None] * 8 + ends - lengths).reshape(-1)
    shifted = _BITS[payload].astype(np.int64) << (24 - lengths.reshape(-1) - (at & 7))
    byte, total = at >> 3, int(sizes.sum())
    buffer = np.zeros(total + 2, np.int64)
    for k in range(3):
        buffer += np.bincount(byte + k, (shifted >> (16 - 8 * k)) & 255, minlength=total + 2).astype(np.int64)[: total + 2]
    buffer = buffer[:total]
    buffer[starts + sizes - 1] |= (1 << (sizes * 8 - ends[:, -1])) - 1
    full = buffer == 255
    marked = nth > 0
    before = np.cumsum(full) - full + 2 * np.repeat(np.cumsum(marked), sizes)
    out = np.zeros(total + int(full.sum()) + 2 * int(marked.sum()), np.uint8)
    out[np.arange(total) + before] = buffer
    first = starts + before[starts] - 2
    out[first[marked]] = 0xFF
    out[first[marked] + 1] = 0xD0 + (nth[marked] - 1) % 8
    return out, sizes + np.add.reduceat(full, starts) + 2 * marked


def _head(mcus: int, n_bytes: int) -> bytes:
    wide = min(mcus, ROW)
    high = -(-mcus // wide)
    if high > ROW:
        raise ValueError("the payload is too long for one image")
    said = b"payload %d mcus %d" % (n_bytes, mcus)
    return b"".join([
        b"\xff\xd8\xff\xfe", struct.pack(">H", 2 + len(said)), said,
        b"\xff\xdb\x00\x43\x00", b"\x01" * 64,
        b"\xff\xc0", struct.pack(">HBHHB", 17, 8, 8 * high, 8 * wide, 3), b"\x01\x11\x00\x02\x11\x00\x03\x11\x00",
        b"\xff\xc4", struct.pack(">H", 2 + 2 * (1 + len(_DHT))), b"\x00", _DHT, b"\x10", _DHT,
        b"\xff\xdd\x00\x04\x00\x01",
        b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00",
    ])


def encode(values: list[bytes]) -> list[bytes]:
    """An image for each value: its bytes, padded by spaces to a positive multiple of 192."""
    padded = [v + b" " * (-len(v) % MCU or (0 if v else MCU)) for v in values]
    mcus = [len(p) // MCU for p in padded]
    nth = np.concatenate([np.arange(m) for m in mcus]) if mcus else np.zeros(0, int)
    everything = np.frombuffer(b"".join(padded), np.uint8)
    parts, sizes = [], []
    for k in range(0, len(nth), LANES):
        coded, size = _lanes(everything[k * MCU : (k + LANES) * MCU], nth[k : k + LANES])
        parts.append(coded.tobytes())
        sizes.append(size)
    stream = b"".join(parts)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, int)
    cuts = ends[np.cumsum([0, *mcus])].tolist()
    images = []
    for k, (value, m) in enumerate(zip(values, mcus, strict=True)):
        blank = min(m, ROW) * -(-m // min(m, ROW)) - m
        rest = b"".join(b"\xff" + bytes([0xD0 + (m + i - 1) % 8]) + _EMPTY_MCU for i in range(blank))
        images.append(b"".join([_head(m, len(value)), stream[cuts[k] : cuts[k + 1]], rest, b"\xff\xd9"]))
    return images


@dataclass
class Image:
    """What the markers of an image say, and its scan."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quantisers: dict[int, bytes] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    huffman: dict[int, bytes] = field(default_factory=dict)
    scan_tables: tuple[tuple[int, int, int], ...] = ()  # component, DC table, AC table
    restart: int = 0
    scan: bytes = b""

    @property
    def mcus(self) -> tuple[int, int]:
        across, down = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))


def _whole(body: bytes, at: int, size: int) -> bytes:
    """So many bytes of a segment; a table that its segment doesn't hold is no table."""
    if at + size > len(body):
        raise NotBaseline("a table is longer than its segment")
    return body[at : at + size]


def parse(data: bytes) -> Image:
    """Reads the markers up to the scan. A baseline image of one scan is read; others raise NotBaseline."""
    if data[:2] != b"\xff\xd8":
        raise NotBaseline("no start of an image")
    image, at = Image(), 2
    try:
        while True:
            if data[at] != 0xFF:
                raise NotBaseline("no marker where one should be")
            while data[at] == 0xFF:
                at += 1
            marker, at = data[at], at + 1
            if marker in (0x01, *range(0xD0, 0xD8)):
                continue
            if marker == 0xD9:
                raise NotBaseline("no scan")
            n = struct.unpack_from(">H", data, at)[0]
            body, at = data[at + 2 : at + n], at + n
            if marker == 0xFE:
                image.comment = body
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    size = 64 * (1 + (body[k] >> 4))
                    image.quantisers[body[k] & 15] = _whole(body, k + 1, size)
                    k += 1 + size
            elif marker == 0xC0:
                depth, image.height, image.width, count = struct.unpack_from(">BHHB", body)
                if depth != 8 or not image.width or not image.height:
                    raise NotBaseline("samples are not of 8 bits, or a side is missing")
                image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
                if any(not 1 <= c[1] <= 4 or not 1 <= c[2] <= 4 for c in image.components):
                    raise NotBaseline("sampling factors")
            elif marker in range(0xC1, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
                raise NotBaseline("a frame that is not baseline")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    size = 16 + sum(_whole(body, k + 1, 16))
                    image.huffman[body[k]] = _whole(body, k + 1, size)
                    k += 1 + size
            elif marker == 0xDD:
                image.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                where = {c[0]: i for i, c in enumerate(image.components)}
                image.scan_tables = tuple((where[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
                if len(image.scan_tables) != len(image.components) or not image.components:
                    raise NotBaseline("more than one scan")
                image.scan = data[at:]
                return image
    except (IndexError, struct.error, KeyError) as e:
        raise NotBaseline("the image ends early") from e


def _lookup(table: bytes) -> np.ndarray:
    """(length << 8 | symbol) by the next 16 bits; 0 where no code begins so."""
    found, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            found[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return found


def _intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where each restart interval begins in it."""
    raw = np.frombuffer(scan, np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    end = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(end[0]) if len(end) else len(raw)
    full, after = full[full < stop], after[full < stop]
    keep = np.ones(stop, bool)
    keep[full[after == 0] + 1] = False
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    before = np.cumsum(keep)
    return raw[:stop][keep], np.concatenate(([0], before[marks]))


def _decode_lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, pattern: np.ndarray, tables: np.ndarray, n_components: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``depth`` coefficients in zigzag order of all blocks of all lanes, and the lanes that are broken.

    pattern: the component of each block of an MCU; tables: a lookup for DC and AC of each component.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(data) + 8
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : k + n] << np.uint64(56 - 8 * k)
    first = np.cumsum(blocks) - blocks
    coefficients = np.zeros((int(blocks.sum()), depth), np.int16)
    flat = coefficients.reshape(-1)
    lane = np.flatnonzero(blocks > 0)
    broken = np.zeros(len(starts), bool)
    at, end = starts[lane].astype(np.int64) * 8, np.int64(len(data) * 8)
    base, todo = first[lane], blocks[lane]
    block, k = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    last = np.zeros((len(lane), n_components), np.int64)
    rows = np.arange(len(lane))
    while len(lane):
        w = words[at >> 3] << (at & 7).astype(np.uint64)
        dc = k == 0
        component = pattern[block % len(pattern)]
        entry = tables[2 * component + ~dc, (w >> np.uint64(48)).astype(np.int64)]
        used, symbol = entry >> 8, entry & 255
        size = symbol & 15
        run = np.where(dc, 0, symbol >> 4)
        value = ((w << used.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        at = at + used + size
        place = k + run
        if dc.any():
            r, c = rows[dc], component[dc]
            last[r, c] += value[dc]
            value[dc] = last[r, c]
        bad = (entry == 0) | (at > end) | ((size > 0) & (place > 63))
        put = (dc | (size > 0)) & ~bad & (place < depth)
        flat[(base[put] + block[put]) * depth + place[put]] = value[put]
        k = np.where(dc | (size > 0), place + 1, np.where(run == 15, k + 16, 64))
        over = k > 63
        block, k = block + over, np.where(over, 0, k)
        gone = (block >= todo) | bad
        if gone.any():
            broken[lane[bad]] = True
            stay = ~gone
            lane, at, base, todo, block, k, last = lane[stay], at[stay], base[stay], todo[stay], block[stay], k[stay], last[stay]
            rows = np.arange(len(lane))
    return coefficients, broken


def decode(images: list[Image], depth: int = 64) -> list[np.ndarray | None]:
    """The coefficients (blocks x depth, zigzag order, in scan order) of each image; None for one whose scan is broken.

    A block takes two bits of the scan at least, so memory goes by the bytes that are there, whatever sides a header names.
    """
    found: list[np.ndarray | None] = [None] * len(images)
    alike: dict[tuple, list[int]] = defaultdict(list)
    for k, x in enumerate(images):
        tables = tuple((c, x.huffman.get(d), x.huffman.get(16 | a)) for c, d, a in x.scan_tables)
        if any(t is None for row in tables for t in row[1:]):
            continue
        alike[(tables, tuple((c[1], c[2]) for c in x.components))].append(k)
    for (tables, sampling), own in alike.items():
        single = len(tables) == 1
        pattern = np.concatenate([np.full(1 if single else sampling[c][0] * sampling[c][1], i) for i, (c, _, _) in enumerate(tables)])
        lookups = np.stack([_lookup(t) for row in tables for t in row[1:]])
        waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        lanes = 0

        def done() -> None:
            data = np.concatenate([w[1] for w in waiting])
            shift = np.cumsum([0, *(len(w[1]) for w in waiting)])
            starts = np.concatenate([w[2] + s for w, s in zip(waiting, shift)])
            blocks = np.concatenate([w[3] for w in waiting])
            coefficients, broken = _decode_lanes(data, starts, blocks, pattern, lookups, len(tables), depth)
            a = b = 0
            for k, _, s, n in waiting:
                if not broken[a : a + len(s)].any():
                    found[k] = coefficients[b : b + int(n.sum())]
                a, b = a + len(s), b + int(n.sum())
            waiting.clear()

        for k in own:
            x = images[k]
            wide, high = (-(-x.width // 8), -(-x.height // 8)) if single else x.mcus
            data, starts = _intervals(x.scan)
            each = x.restart or wide * high
            count = -(-wide * high // each)
            if len(starts) < count or wide * high * len(pattern) > 4 * len(data):
                continue
            blocks = np.full(count, each)
            blocks[-1] = wide * high - each * (count - 1)
            waiting.append((k, data, starts[:count], blocks * len(pattern)))
            lanes += count
            if lanes >= LANES:
                done()
                lanes = 0
        if waiting:
            done()
    return found


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The luminance of an image, a pixel for each block of 8 x 8 samples: its mean, from the DC term alone."""
    first, across, down, quantiser = image.components[0]
    table = image.quantisers.get(quantiser)
    if table is None:
        raise NotBaseline("no quantiser")
    step = table[0] if len(table) == 64 else struct.unpack_from(">H", table)[0]
    dc = coefficients[:, 0].astype(np.int64)
    if len(image.components) == 1:
        grid = dc.reshape(-(-image.height // 8), -(-image.width // 8))
    else:
        wide, high = image.mcus
        per = sum(c[1] * c[2] for c in image.components)
        grid = dc.reshape(high, wide, per)[:, :, : across * down].reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
        grid = grid[: -(-image.height * down // (8 * max(c[2] for c in image.components))), : -(-image.width * across // (8 * max(c[1] for c in image.components)))]
    return np.clip((grid * step + 1024 + 4) >> 3, 0, 255).astype(np.uint8)


def feature(image: Image, small: np.ndarray) -> str:
    """Dimensions, a hash of the thumbnail's look (8 x 8 cells against their mean), and one of all its pixels."""
    rows = np.add.reduceat(small, _cells(small.shape[0]), axis=0, dtype=np.int64) if small.shape[0] > 8 else small[np.arange(8) * small.shape[0] // 8].astype(np.int64)
    cells = np.add.reduceat(rows, _cells(small.shape[1]), axis=1) if small.shape[1] > 8 else rows[:, np.arange(8) * small.shape[1] // 8]
    size = np.outer(_extent(small.shape[0]), _extent(small.shape[1]))
    bright = cells / size > (cells / size).mean()
    return f"{image.width}x{image.height}:{np.packbits(bright).tobytes().hex()}:{zlib.crc32(small.tobytes()):08x}"


def _cells(n: int) -> np.ndarray:
    return np.arange(8) * n // 8


def _extent(n: int) -> np.ndarray:
    return np.diff(np.append(_cells(n), n)) if n > 8 else np.ones(8, int)


def payload(image: Image, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The padded payload that encode() stored, and the length of the value in it."""
    said = image.comment.split()
    if len(said) != 4 or said[0] != b"payload":
        raise NotBaseline("no payload is named")
    v = coefficients.reshape(-1)[: int(said[3]) * MCU].astype(np.int16)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes(), int(said[1])


def store(docs: DataFrame, column: str = "text", into: str = "media") -> DataFrame:
    """doc_id and the media column ``into``: an image that holds the UTF-8 of ``column`` (null: empty).

    Each row has its image, rows that repeat too; a null doc_id stays null, other columns don't matter, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 4_000_000):
            values = [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode(values), pa.binary())], names=["doc_id", into])

    return docs.select("doc_id", column).mapInArrow(run, f"doc_id long, {into} binary")


def thumbnails(media: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, width, height, feature and problem of any JPEGs, a row for each row; what can't be read, a null too, has a problem and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 4_000_000):
            rows: list[dict] = []
            images: list[tuple[int, Image]] = []
            for k, (doc, data) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column(column).to_pylist(), strict=True)):
                rows.append({"doc_id": doc, "width": None, "height": None, "feature": None, "problem": None})
                try:
                    images.append((k, parse(data or b"")))
                except NotBaseline as e:
                    rows[k]["problem"] = str(e)
            for (k, image), got in zip(images, decode([x for _, x in images], 1), strict=True):
                try:
                    if got is None:
                        raise NotBaseline("the scan is broken")
                    rows[k] |= {"width": image.width, "height": image.height, "feature": feature(image, thumbnail(image, got))}
                except NotBaseline as e:
                    rows[k]["problem"] = str(e)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("feature", pa.string()), ("problem", pa.string())]))

    return media.select("doc_id", column).mapInArrow(run, "doc_id long, width long, height long, feature string, problem string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the images of ``docs`` to the shared folder and gives the digest of what is read back."""
    return digest(written(store(docs), "media"))


def digest(media: DataFrame) -> DataFrame:
    """What the images of store() hold: the payload's and the image's lengths and digests, and the feature.

    A row for each row of ``media``, repeated ones and those without a doc_id too; an empty table gives none. Equal texts have equal values.
    """
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4_000_000):
            files = batch.column("media").to_pylist()
            images = [parse(x) for x in files]
            rows = []
            for doc, data, image, got in zip(batch.column("doc_id").to_pylist(), files, images, decode(images), strict=True):
                if got is None:
                    raise NotBaseline("a stored image is broken")
                held, n = payload(image, got)
                rows.append((doc, n, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(image, thumbnail(image, got))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
