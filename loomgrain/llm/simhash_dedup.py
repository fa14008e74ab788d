"""Near-duplicates by SimHash fingerprints in a Gray-order hierarchical index.

Equal fingerprints meet in an aggregate first, so a group of copies is one vertex. Distinct fingerprints
are dealt to buckets by two rounds of the pigeonhole principle: two words that differ in three bits at
most agree on one of four 16-bit blocks, and, of the 48 bits left, on one of four 12-bit blocks. A
bucket is therefore a 28-bit agreement; one that still holds too many fingerprints is dealt again by
four blocks of the bits left, until it is small or no bits are left.

Inside a task, the buckets are sorted by Gray rank, in which neighbours differ in few bits. Upper nodes
of fan-out 16 hold the bits on which all fingerprints below agree. Pairs of nodes descend together:
the differences of the shared agreed bits accumulate into a lower bound that prunes whole groups, and an
upper bound that links whole groups without looking inside. A task gives a forest of links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.components import connected_components
from loomgrain.llm.shared import fresh, slices, texts, turn, written

DISTANCE = 3
FAN = 16
#: A bucket of more distinct fingerprints is dealt again by its bits left.
BUCKET = 8192
#: Node pairs that are looked at in one step.
STEP = 2_000_000
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: zero where it has no word; a bit is set if over half the shingles set it."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined, h = b" ".join(tokens), xxhash.xxh64_intdigest
    n = len(tokens) - words + 1
    if n <= 1:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        some = np.array([h(joined[i:j], seed) for i, j in zip(starts[k : k + SHINGLES_AT_ONCE], stops[k : k + SHINGLES_AT_ONCE])], np.uint64)
        counts += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``beside`` it (long), and fp, the fingerprint as a signed long, of every whole text (null: no words)."""
    names = ["doc_id", *beside, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("simhash")
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(x, words, seed) for x in texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(found.view(np.int64))], names=names)

    return docs.select("doc_id", "text", *beside).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least vertex of each vertex's component among 0 .. n-1."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


class _Index:
    """The upper nodes over words sorted by bucket and Gray rank."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.words = words
        self.ands, self.ors, self.first, self.count = [words], [words], [np.arange(len(words))], [np.ones(len(words), np.int64)]
        start, count = ends - sizes, sizes
        while True:
            more = -(-count // FAN)
            above = np.cumsum(more) - more
            inside = np.arange(more.sum()) - np.repeat(above, more)
            begin = np.repeat(start, more) + inside * FAN
            held = np.minimum(FAN, np.repeat(count, more) - inside * FAN)
            self.first.append(begin)
            self.count.append(held)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], begin))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], begin))
            start, count = above, more
            if (more == 1).all():
                break

    def links(self) -> np.ndarray:
        """The root of each word after all pairs of its bucket within DISTANCE are linked."""
        n, top = len(self.words), len(self.first) - 1
        low = [np.arange(n)]  # the first word below each node, by level
        for level in range(1, top + 1):
            low.append(low[-1][self.first[level]])
        size = [np.ones(n, np.int64)]
        for level in range(1, top + 1):
            size.append(np.add.reduceat(size[-1], self.first[level]))
        label, us, vs, waiting = np.arange(n), [], [], 0
        roots = np.arange(len(self.first[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > STEP // (FAN * FAN) and level:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            if level == 0:
                us.append(a)
                vs.append(b)
                waiting += len(a)
                if waiting > max(n, STEP):
                    label, us, vs, waiting = _roots(n, np.concatenate(us), np.concatenate(vs), label), [], [], 0
                continue
            # children of both, and of one node each pair once
            na, nb = self.count[level][a], self.count[level][b]
            each = na * nb
            at = np.repeat(np.arange(len(a)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = self.first[level][a][at] + k // nb[at], self.first[level][b][at] + k % nb[at]
            keep = i <= j if level > 1 else i < j
            i, j = i[keep], j[keep]
            level -= 1
            agree = ~((self.ors[level][i] ^ self.ands[level][i]) | (self.ors[level][j] ^ self.ands[level][j]))
            apart = np.bitwise_count((self.ands[level][i] ^ self.ands[level][j]) & agree)
            keep = apart <= DISTANCE
            i, j, agree, apart = i[keep], j[keep], agree[keep], apart[keep]
            if level:
                whole = apart + np.bitwise_count(~agree) <= DISTANCE
                if whole.any():
                    x, y = i[whole], j[whole]
                    for p, q in ((x, y), (y, x)):
                        s = size[level][p]
                        at = np.repeat(np.arange(len(p)), s)
                        member = low[level][p][at] + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                        us.append(member)
                        vs.append(low[level][q][at])
                        waiting += len(member)
                    i, j = i[~whole], j[~whole]
            if len(i):
                stack.append((level, i, j))
        return _roots(n, np.concatenate(us), np.concatenate(vs), label) if us else label


def _bucket_links(keys: np.ndarray, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) ids of a forest that links what lies within DISTANCE in a common bucket."""
    order = np.lexsort((gray_rank(words), keys))
    keys, words, ids = keys[order], words[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    shared = np.repeat(sizes > 1, sizes)
    words, ids, sizes = words[shared], ids[shared], sizes[sizes > 1]
    if not len(words):
        return ids, ids
    root = _Index(words, sizes).links()
    linked = root != np.arange(len(root))
    return ids[linked], ids[root[linked]]


def _bits(at: list[int]) -> int:
    return sum(1 << k for k in at)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(bits: list[int], parts: int = DISTANCE + 1) -> list[list[int]]:
    """Bits dealt to parts in rounds, so that each part has near and far bits."""
    return [bits[k::parts] for k in range(parts)]


def _first_masks() -> list[int]:
    masks = []
    for block in _parts(list(range(64))):
        left = [k for k in range(64) if k not in set(block)]
        masks += [_bits(block) | _bits(inner) for inner in _parts(left)]
    return masks


def _keyed(mask: Column, fp: Column) -> Column:
    return F.xxhash64(mask, fp.bitwiseAND(mask))


def similar(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the ids of ``nodes`` (id, fp; fp distinct) that hold every pair within DISTANCE together.

    A pair within the distance is joined by a path of links, and each link joins two of a chain of such pairs.
    """
    spark = nodes.sparkSession
    masks = F.array(*(F.lit(_signed(m)) for m in _first_masks()))
    dealt = nodes.select("id", "fp", F.explode(masks).alias("mask"))
    found = []
    while True:
        dealt = dealt.withColumn("key", _keyed(F.col("mask"), F.col("fp")))
        full = written(dealt.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "full-buckets")
        if full.isEmpty():
            found.append(dealt)
            break
        # hot buckets are few; their rows go on with one more block of the bits that are left
        found.append(dealt.join(full, "key", "left_anti"))
        hot = dealt.join(full, "key", "left_semi").drop("key")
        finer = {m: _finer(m) for m in (r[0] for r in hot.select("mask").distinct().collect())}
        ended = [m for m, more in finer.items() if not more]
        if ended:
            found.append(hot.where(F.col("mask").isin(ended)).withColumn("key", _keyed(F.col("mask"), F.col("fp"))))
        going = {m: more for m, more in finer.items() if more}
        if not going:
            break
        table = spark.createDataFrame([(m, x) for m, more in going.items() for x in more], "mask long, finer long")
        dealt = written(hot.join(F.broadcast(table), "mask").select("id", "fp", F.col("finer").alias("mask")), "hot-buckets")
    rows = reduce(DataFrame.unionByName, found).select("key", "fp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, fp, ids = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in range(3))
        u, v = _bucket_links(key, fp.view(np.uint64), ids)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.repartition(F.col("key")).mapInArrow(run, "u long, v long")


def _finer(mask: int) -> list[int]:
    """The masks of one more block; none where so few bits are left that a block would be empty."""
    left = [k for k in range(64) if not mask >> k & 1]
    return [_signed(mask % (1 << 64) | _bits(p)) for p in _parts(left)] if len(left) > 4 * (DISTANCE + 1) else []


def groups(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every document.

    component_id is the smallest doc_id that links of DISTANCE bits or fewer reach, its own included. Texts
    without words have the fingerprint zero and link like others. Links are between fingerprints: rows that repeat a doc_id stay, each with
    its own fingerprint and component. A null doc_id links like others but names no component; one of null ids alone is null.
    """
    marked = written(fingerprints(docs, words, seed), "fingerprints")
    return _grouped(marked)


def _grouped(marked: DataFrame) -> DataFrame:
    """The rows of a table with doc_id and fp, with component_id beside them."""
    # a fingerprint is its own vertex, so that rows of one doc_id don't tie unlike texts together
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = written(connected_components(similar(nodes.select(F.col("fp").alias("id"), "fp"))), "fingerprint-components").withColumnRenamed("node", "fp")
    whole = nodes.join(linked, "fp")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    many = whole.select("fp", "component").join(least, "component").select("fp", "component_id")
    named = nodes.join(many, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(named, "fp").select(*marked.columns, "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group: that whose doc_id names the component, of several the one with the least text's hash.

    Rows without a doc_id stay.
    """
    key, nth = fresh(docs, "text_key"), fresh(docs, "nth")
    named = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text"))
    marked = written(fingerprints(named, words, seed, (key,)), "fingerprints")
    kept = _grouped(marked).where("doc_id = component_id").groupBy("component_id").agg(F.min(key).alias(key)).withColumnRenamed("component_id", "doc_id")
    once = Window.partitionBy("doc_id", key).orderBy("text")  # as the join parts them, so that the texts are shuffled once
    first = named.join(kept, ["doc_id", key], "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return first.select(docs.columns).unionByName(docs.where("doc_id is null"))
