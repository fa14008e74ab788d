import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgrain.llm import token_blocks as tb
from loomgrain.llm.shared import scratch_path
from tests.llm.helpers import ODD, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2500), st.integers(0, 2500), st.integers(0, 2500))
def test_segments_round_trip(values, a, b):
    ids = np.array(values, np.uint32)
    data = tb.encode_segment([len(ids) // 3, len(ids) - len(ids) // 3], ids)
    lengths, back = tb.decode_segment(data)
    assert lengths.sum() == len(ids) and np.array_equal(back, ids)
    assert np.array_equal(tb.decode_range(data, a, b), ids[a:b] if a < b else ids[:0])


def test_outliers_are_exceptions():
    ids = np.full(1024, 7, np.uint32)
    ids[::100] = 2**31
    assert len(tb.encode_block(ids)) < 200
    assert np.array_equal(tb.decode_block(tb.encode_block(ids), 1024), ids)


def ids_of(column):
    flat, counts = tb.encoder(PATH).encode(pa.array(column, pa.string()))
    ends = np.cumsum(counts)
    return [flat[b - n : b].tolist() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def theirs(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


PIECES = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "\u0085", "\x1c", "a", "Re", "l", "x1", "9", "²", "!", "é", "日", "😀", "\U00020000", "<|endoftext|>", "ǅ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)), max_size=6))
def test_ids_are_the_librarys(column):
    assert ids_of(column) == [theirs(x) for x in column]


def test_every_sign_is_cut_alike():
    signs = [chr(c) for c in range(1, tb.LAST_CUT + 2) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1" for c in signs[k : k + 64]) for k in range(0, len(signs), 64)]
    assert ids_of(texts) == [theirs(x) for x in texts]


def test_very_long_white_space():
    assert ids_of([" " * 1_000_000, "\n" * 1_000_000, " " * 2_000_000 + "x"]) == [theirs(x) for x in (" " * 1_000_000, "\n" * 1_000_000, " " * 2_000_000 + "x")]


def test_a_full_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(tb, "REMEMBERED", 2)
    own = tb.Encoder(PATH)
    for text in ("one two three", "two four", "one two"):
        assert own.encode(pa.array([text]))[0].tolist() == theirs(text)


def test_query_on_odd_rows(spark, monkeypatch):
    rows = [r for r in ODD]
    got = sorted(tb.round_trip(docs(spark, rows, ["shard", "first", "tie"]), PATH).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    want = {}
    for r in rows:
        ids = THEIRS.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0)) and len(names) == len(rows)
    assert tb.round_trip(empty(spark), PATH).count() == 0


def test_ids_are_read_back(spark):
    into = scratch_path(spark, "test")
    tb.write(docs(spark, [(2, "b b"), (1, "a")]), into, PATH)
    got = {r["doc_id"]: r["ids"] for r in tb.read(spark, into).collect()}
    assert got == {1: THEIRS.encode("a").ids + [0], 2: THEIRS.encode("b b").ids + [0]}
