import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrain.llm import media_jpeg as mj
from tests.llm.helpers import ODD, docs, empty


def back(values):
    images = [mj.parse(x) for x in mj.encode(values)]
    return [mj.payload(i, c) for i, c in zip(images, mj.decode(images), strict=True)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5))
def test_bytes_come_back(values):
    for v, (held, n) in zip(values, back(values), strict=True):
        assert n == len(v) and held[:n] == v and set(held[n:]) <= {32} and len(held) % 192 == 0 and held


def test_two_rows_of_blocks_and_many_lanes(monkeypatch):
    monkeypatch.setattr(mj, "ROW", 5)
    monkeypatch.setattr(mj, "LANES", 7)
    v = np.random.default_rng(0).integers(0, 256, 192 * 23 + 11, dtype=np.uint8).tobytes()
    assert [p[:n] for p, n in back([v, b"", v[:500]])] == [v, b"", v[:500]]


def slow_decode(image):
    """Symbol by symbol, bit by bit."""
    raw, pieces, k = image.scan, [bytearray()], 0
    while k < len(raw):
        if raw[k] == 0xFF:
            if raw[k + 1] == 0:
                pieces[-1].append(0xFF)
            elif 0xD0 <= raw[k + 1] <= 0xD7:
                pieces.append(bytearray())
            else:
                break
            k += 2
        else:
            pieces[-1].append(raw[k])
            k += 1
    books = {}
    for name, table in image.huffman.items():
        code, at, books[name] = 0, 16, {}
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                books[name][n, code] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
    pattern = [(i, d, a) for i, (c, d, a) in enumerate(image.scan_tables) for _ in range(image.components[c][1] * image.components[c][2])]
    wide, high = image.mcus
    each, blocks = image.restart or wide * high, []
    for nth, piece in enumerate(pieces):
        bits, at, last = "".join(f"{b:08b}" for b in piece), 0, [0] * len(image.components)
        for _ in range(min(each, wide * high - nth * each)):
            for i, d, a in pattern:
                block, k = [0] * 64, 0
                while k < 64:
                    code, n = 0, 0
                    while (n, code) not in books[d if k == 0 else 16 | a]:
                        code, n, at = code << 1 | int(bits[at]), n + 1, at + 1
                    symbol = books[d if k == 0 else 16 | a][n, code]
                    run, size = (symbol >> 4, symbol & 15) if k else (0, symbol)
                    v = int(bits[at : at + size] or "0", 2)
                    at += size
                    v = v if not size or v >> (size - 1) else v - (1 << size) + 1
                    if k == 0:
                        last[i] += v
                        block[0], k = last[i], 1
                    elif size:
                        k += run
                        block[k], k = v, k + 1
                    else:
                        k = k + 16 if run == 15 else 64
                blocks.append(block)
    return np.array(blocks)


def subsampled(seed, restart):
    """An image of 2x2 luminance sampling with runs of zeros, differences of DC terms, and maybe no restarts."""
    rng = np.random.default_rng(seed)
    width, height = 37, 21
    wide, high = -(-width // 16), -(-height // 16)
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    ac = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + bytes([1, 2, 3, 0, 4, 17, 5, 18, 33])
    ac = ac[:16] + ac[16:25] + bytes([s for s in symbols if s not in ac[16:25]])[: sum(ac[:16]) - 9]
    books = []
    for table in (dc, ac):
        code, at, book = 0, 16, {}
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                book[table[at]] = f"{code:0{n}b}"
                code, at = code + 1, at + 1
            code <<= 1
        books.append(book)
    low = lambda v, s: f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""
    scan, bits, last = bytearray(), "", [0, 0, 0]

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(wide * high):
        if restart and m and m % restart == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, last = "", [0, 0, 0]
        for i in (0, 0, 0, 0, 1, 2):
            v = int(rng.integers(-200, 200))
            s = abs(v - last[i]).bit_length()
            bits += books[0][s] + low(v - last[i], s)
            last[i] = v
            k = 1
            while k < 64:
                if rng.random() < 0.3:
                    bits += books[1][0]
                    break
                run = int(rng.integers(0, 3))
                if k + run > 63:
                    bits += books[1][0]
                    break
                s = int(rng.integers(1, 3))
                while run << 4 | s not in books[1]:
                    s, run = 1, max(0, run - 1)
                v = int(rng.integers(1 << (s - 1), 1 << s)) * int(rng.choice([-1, 1]))
                bits += books[1][run << 4 | s] + low(v, s)
                k += run + 1
    scan += flush(bits)
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\x00"), segment(0xDB, b"\x00" + bytes([16]) * 64),
        segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        segment(0xC4, b"\x00" + dc + b"\x10" + ac), segment(0xDD, struct.pack(">H", restart)) if restart else b"",
        segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"), bytes(scan), b"\xff\xd9",
    ])


@pytest.mark.parametrize("restart", [0, 1, 2, 3])
def test_any_baseline_image(restart):
    images = [mj.parse(subsampled(seed, restart)) for seed in range(4)]
    for image, got in zip(images, mj.decode(images), strict=True):
        want = slow_decode(image)
        assert np.array_equal(got, want)
        small = mj.thumbnail(image, got)
        assert small.shape == (3, 5)
        y = want[:, 0].reshape(2, 3, 6)[:, :, :4].reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)[:3, :5]
        assert np.array_equal(small, np.clip((y * 16 + 1028) >> 3, 0, 255))


def test_broken_images_have_problems(spark):
    good = mj.encode([b"hello"])[0]
    rows = [(1, good), (2, good[:40]), (3, b""), (4, None), (5, good[:200] + b"\xff\xd9"), (6, b"GIF89a")]
    got = {r["doc_id"]: r for r in mj.thumbnails(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["problem"] is None and got[1]["width"] == 8
    assert all(got[k]["problem"] and got[k]["width"] is None for k in (2, 3, 4, 5, 6))


def looked_at(data):
    """What thumbnails() does with one image."""
    try:
        image = mj.parse(data)
        got = mj.decode([image], 1)[0]
        return None if got is None else mj.feature(image, mj.thumbnail(image, got))
    except mj.NotBaseline:
        return None


def test_tables_that_their_segment_does_not_hold():
    good = mj.encode([b"hello"])[0]
    at = good.index(b"\xff\xc4")
    bad = bytearray(good)
    bad[at + 5] = 200  # two hundred codes of one bit
    assert looked_at(bytes(bad)) is None and looked_at(good) is not None
    bad = bytearray(good)
    bad[good.index(b"\xff\xdb") + 3] = 7
    assert looked_at(bytes(bad[: good.index(b"\xff\xdb") + 20]) + bytes(bad[at:])) is None


def test_a_giant_header_over_a_few_bytes():
    good = bytearray(mj.encode([b"hello"])[0])
    at = good.index(b"\xff\xc0")
    good[at + 5 : at + 9] = b"\xff\xff\xff\xff"
    restart = good.index(b"\xff\xdd")
    assert looked_at(bytes(good)) is None
    assert looked_at(bytes(good[:restart] + good[restart + 6 :])) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255)), min_size=1, max_size=4), st.booleans())
def test_changed_bytes_never_raise(changes, own):
    data = bytearray(mj.encode([b"some text " * 30])[0] if own else subsampled(1, 2))
    for at, value in changes:
        data[at % len(data)] = value
    looked_at(bytes(data))


def test_query_on_odd_rows(spark):
    got = mj.round_trip(docs(spark, ODD, ["media", "feature"])).collect()

    def want(text):
        b = (text or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted((str(r[0]), *want(r[1])) for r in ODD)
    assert len({r[1:] for r in got if r["doc_id"] == 4}) == 1
    assert mj.round_trip(empty(spark)).count() == 0
