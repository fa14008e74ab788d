import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgrain.llm import bpe
from tests.llm.helpers import ODD, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = bpe.load(PATH), Tokenizer.from_file(PATH)


def ids(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(text):
    packed = OURS.encode(text)
    assert memoryview(packed).cast("I").tolist() == ids(text)
    assert OURS.decode(packed) == THEIRS.decode(ids(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 5000, "x<|endoftext|><|endoftext|> y", "I'll we've  \n\n  \t", "éêß 日本 😀", " 　\x85 a"])
def test_fixed(text):
    assert memoryview(OURS.encode(text)).cast("I").tolist() == ids(text)


def test_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "one two three four five six one two"
    assert memoryview(bpe.Bpe(PATH).encode(text)).cast("I").tolist() == ids(text)


def test_query_on_odd_rows(spark):
    got = bpe.digests(docs(spark, ODD, ["ids", "decoded"]), PATH).collect()
    assert len(got) == len(ODD)
    want = sorted((str(r[0]), len(ids(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ODD)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in got) == want
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_columns_pass_through(spark):
    df = bpe.encode_column(docs(spark, ODD, ["ids"]), PATH)
    back = bpe.decode_column(df, PATH)
    assert back.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
