import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgrain.llm import simhash_dedup as sd
from loomgrain.llm.components import connected_components
from loomgrain.sources.tables import table
from tests.llm.helpers import ODD, docs, empty


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(words):
    """The least place of each word's component, by comparing all."""
    words = np.array(words, np.uint64)
    i, j = np.nonzero(np.bitwise_count(words[:, None] ^ words[None]) <= 3)
    return sd._roots(len(words), i, j)


@pytest.mark.parametrize("text", ["", " \n", "one", "one two", "A b\tC\x0bd É e É e É", "x " * 3000, "a\x1cb c\xa0d e f g"])
def test_fingerprints(text):
    assert sd.fingerprint(text) == slow_fingerprint(text)


def test_long_texts_count_in_parts(monkeypatch):
    monkeypatch.setattr(sd, "SHINGLES_AT_ONCE", 7)
    rnd = random.Random(1)
    text = " ".join(str(rnd.randrange(50)) for _ in range(200))
    assert sd.fingerprint(text) == slow_fingerprint(text)


def test_gray_rank_orders_the_gray_sequence():
    gray = np.array([k ^ (k >> 1) for k in range(4096)], np.uint64)
    assert sd.gray_rank(gray).tolist() == list(range(4096))


@pytest.mark.parametrize("step", [300, 2_000_000])
def test_index_links_what_all_pairs_link(monkeypatch, step):
    monkeypatch.setattr(sd, "STEP", step)
    rng = np.random.default_rng(2)
    for _ in range(12):
        base = rng.integers(0, 2**63, size=int(rng.integers(1, 30)), dtype=np.uint64)
        words = base[rng.integers(0, len(base), int(rng.integers(2, 700)))]
        for _ in range(int(rng.integers(0, 4))):
            words = words ^ (np.uint64(1) << rng.integers(0, 64, len(words)).astype(np.uint64))
        words = np.unique(words)
        u, v = sd._bucket_links(np.zeros(len(words), int), words, np.arange(len(words)))
        assert np.array_equal(sd._roots(len(words), u, v), components(words))
        assert len(u) < len(words)


@pytest.mark.parametrize("bucket", [4, 8192])
def test_buckets_lose_no_link(spark, monkeypatch, bucket):
    """Also where buckets are dealt again, down to the last bits."""
    monkeypatch.setattr(sd, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    base = rng.integers(0, 2**63, size=40, dtype=np.uint64)
    words = base[rng.integers(0, 40, 300)]
    for _ in range(2):
        words = words ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    words = np.unique(words)
    nodes = spark.createDataFrame([(k, int(w)) for k, w in enumerate(words.view(np.int64).tolist())], "id long, fp long")
    found = sd.similar(nodes).collect()
    u, v = np.array([r["u"] for r in found], int), np.array([r["v"] for r in found], int)
    assert np.array_equal(sd._roots(len(words), u, v), components(words))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)] + [(7, 7), (1, 0)]
    u, v = np.array(edges).T
    label = sd._roots(260, u, v)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    inside = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: int(label[x]) for x in inside}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def by_hand(rows):
    words = [slow_fingerprint(r[1] or "") for r in rows]
    label = components(words)
    named = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            named[label[k]] = min(named.get(label[k], r[0]), r[0])
    return sorted(((r[0], f"{w:016x}", named.get(label[k])) for k, (r, w) in enumerate(zip(rows, words))), key=str)


def test_query_on_odd_rows(spark):
    rows = [*ODD, (11, "The same words again, and again the same words."), (10, "the same WORDS again, and again the same words."), (12, "the same words")]
    got = sd.digest(docs(spark, rows, ["fp", "id", "component"])).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    assert sd.digest(empty(spark)).count() == 0


def test_query_on_a_table(spark, tiny):
    documents = table(spark, tiny, "documents")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, sd.digest(documents).collect()), key=str) == by_hand(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [*ODD, (11, "the same words again"), (10, "the same words again"), (10, "the same words again")]
    df = docs(spark, rows, ["nth", "component_id"])
    kept = sd.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect())) == [0, 3, 4, 5, 7, 8, 10]
    assert kept.where("doc_id is null").count() == 2


def test_a_repeated_id_ties_no_unlike_texts(spark):
    """(5, 0) and (3, 1) are near, (5, ~0) is far from both: its component is its own."""
    marked = spark.createDataFrame([(5, 0), (5, -1), (3, 1)], "doc_id long, fp long")
    assert sorted(map(tuple, sd._grouped(marked).collect())) == [(3, 1, 3), (5, -1, 5), (5, 0, 3)]
    pairs = spark.createDataFrame([(5, 0), (3, 0), (5, -1), (9, -1), (None, 255)], "doc_id long, fp long")
    assert sorted(map(tuple, sd._grouped(pairs).collect()), key=str) == sorted([(3, 0, 3), (5, 0, 3), (5, -1, 5), (9, -1, 5), (None, 255, None)], key=str)
    texts = ["one two three four five six", "entirely other words stand here today, none shared"]
    kept = sd.keep_first(docs(spark, [(5, texts[0]), (3, texts[0]), (5, texts[1]), (9, texts[1])])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, texts[0]), (5, texts[1])]
