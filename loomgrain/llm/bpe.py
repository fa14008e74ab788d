"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a word in a doubly linked list and the merges that apply in a priority
queue of merge ranks. A queue entry that no longer describes two living neighbours is stale and is
skipped when it comes up. Decoding concatenates the vocabulary strings of the ids.

Nulls encode as the empty text; equal texts give equal ids; columns besides the text pass through.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgrain.llm.shared import slices, texts, turn

#: The word pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; frequent words stay, and a full memory begins anew.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary file, as sign to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    return signs | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Bpe:
    """A tokenizer file of the ``tokenizers`` library of the kind byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or told["normalizer"] is not None:
            raise ValueError("only a byte-level BPE without a normalizer is read")
        if not before.get("use_regex", True) or before.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("this file's options are not supported")
        signs = byte_signs()
        vocab: dict[str, int] = model["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(signs[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = [0] * 256
        for s, b in signs.items():
            self.byte_ids[b] = vocab[s]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.byte_ids[b] for b in word]
        merges, n = self.merges, len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # an entry holds rank, place, and the pair it was made for
        queue = []
        for i in range(n - 1):
            pair = ids[i] << 20 | ids[i + 1]
            if (found := merges.get(pair)) is not None:
                queue.append((found[0], i, pair, found[1]))
        heapify(queue)
        while queue:
            _, i, pair, new = heappop(queue)
            j = after[i]
            if j < 0 or ids[i] < 0 or ids[i] << 20 | ids[j] != pair:
                continue  # stale: one of the two was merged away meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                pair = new << 20 | ids[k]
                if (found := merges.get(pair)) is not None:
                    heappush(queue, (found[0], i, pair, found[1]))
            h = before[i]
            if h >= 0:
                pair = ids[h] << 20 | new
                if (found := merges.get(pair)) is not None:
                    heappush(queue, (found[0], h, pair, found[1]))
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text without special strings, as little-endian unsigned 32-bit integers."""
        known, parts = self.known, []
        add, get = parts.append, known.get
        for word in self.words.findall(text):
            ids = get(word)
            if ids is None:
                ids = array("I", self.merged(word.encode())).tobytes()
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            add(ids)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; special strings become their ids."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.packed(text)
        pieces = self.special_split.split(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if i % 2 else self.packed(x) for i, x in enumerate(pieces))

    def decode(self, packed: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement sign."""
        return b"".join(map(self.strings.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_column(df: DataFrame, path: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of ``column`` in an array column ``into``."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != into), T.StructField(into, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in schema.fields[:-1]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe", load.cache_clear)
        bpe = load(path)
        for batch in slices(batches, column):
            ids = [memoryview(bpe.encode(x)).cast("I").tolist() for x in texts(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.field("element", pa.int32(), False)))], names=[*names, into])

    return df.mapInArrow(encode, schema)


def decode_column(df: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``column``; null ids decode to null."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != into), T.StructField(into, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe", load.cache_clear)
        bpe = load(path)
        for batch in batches:
            found = [None if x is None else bpe.decode(array("I", x).tobytes()) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string())], names=[*names, into])

    return df.mapInArrow(decode, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe", load.cache_clear)
        bpe = load(path)
        for batch in slices(batches, "text"):
            n, a, b = [], [], []
            for text in texts(batch.column("text")):
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
