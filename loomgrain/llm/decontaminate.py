"""Benchmark items in documents, also where their numbers, names or units were exchanged.

Words become a template: numbers, names and units turn into typed placeholders, other words lose case and the signs
around them. Windows of five template words are hashed and joined with the windows of the benchmark's items. A document
that has at least CONTAINMENT of an item's windows close together is a candidate; then its slots are compared: one value of the item
must always stand for one value of the document. Consistent slots make a leak, ``exact`` where all values are the item's
and ``reparameterised`` elsewhere; inconsistent ones make none.

Beside them stand literal windows: five words each without case, numbers and names as they are; of an item of fewer words all of
them. A document that has at least CONTAINMENT of an item's literal windows close together is an ``exact`` leak, whatever its templates say.

The join is on each item's rarest windows alone, so many that a document without any of them can't reach CONTAINMENT: a stem that
many items share is joined only where an item has little else. Documents are read once for their windows; a filter of fixed size lets
through those that some item has. Pairs that meet are read exactly, from the texts of both.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.shared import fresh, slices, turn, written

WINDOW = 5
CONTAINMENT = 0.8
CONSISTENT = 0.8
#: Words of a window that must be no placeholder.
LITERALS = 3
#: The windows of a leak lie within so many times the item's words.
SPREAD = 2
#: Bits of the filter of windows; 8 MB whatever the benchmark's size.
FILTER_BITS = 26
#: Items that are read beside a document's text at once.
ITEMS_AT_ONCE = 256
#: Distinct words that a worker remembers; beyond them it begins anew.
REMEMBERED = 200_000
#: Bytes of text that are cut into words at once; the words' columns take many times as much.
BYTES_AT_ONCE = 2_000_000

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec secs min mins h hr hrs ms hz khz mhz ghz w kw mw v a ma kb mb gb tb bit bits byte bytes"
    " inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams kilogram kilograms"
    " pound pounds ounce ounces ton tons liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years"
    " dollar dollars cent cents euro euros usd eur gbp percent degrees celsius fahrenheit kelvin joule joules newton newtons watt watts volt volts mph kmh".split()
)
_NUMBER = regex.compile(r"[-+]?[\p{Sc}]?\p{Nd}[\p{Nd}.,:/'’]*(?:[\p{Sc}%‰°]|\p{L}{1,3})?")
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_SENTENCE = regex.compile(r"[.!?:][^\p{L}\p{N}]*$")
NUM, NAME, UNIT = (xxhash.xxh64_intdigest(f"<{x}>", 1) for x in ("num", "name", "unit"))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def _read(word: str, bare: str) -> tuple[int, int, int]:
    """The template hash of a word, whether it could be a name (1) or is another slot (2), and whether a sentence ends behind it."""
    ends = word[-1:] not in _LETTERS and _SENTENCE.search(word) is not None
    low = bare.lower()
    if bare and not bare.isalpha() and _NUMBER.fullmatch(bare):
        return NUM, 2, ends
    if low in UNITS:
        return UNIT, 2, ends
    return xxhash.xxh64_intdigest(low, 0), int(bare[:1].isupper()), ends


class _Told:
    """What is read of each distinct word: template hash, kind, sentence end, literal hash, and whether it has a sign of its own.

    A worker remembers the words that a batch has more than once. Most others never come again, and would fill the memory.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.columns = [np.zeros(0, kind) for kind in (np.uint64, np.int8, bool, np.uint64, bool)]

    def of(self, words: list[str], times: np.ndarray) -> list[np.ndarray]:
        """``words`` are distinct; times: how often each stands in the batch."""
        if len(self.known) > REMEMBERED:
            self.__init__()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        new = new[np.argsort(times[new] < 2, kind="stable")]  # those to remember come first
        if len(new):
            rows = []
            for k in new.tolist():
                w = words[k]
                bare = _bare(w)
                rows.append((*_read(w, bare), xxhash.xxh64_intdigest(bare.casefold(), 2), bool(bare)))
            held = len(self.known)
            columns = [np.concatenate([have, np.array(more, have.dtype)]) for have, more in zip(self.columns, zip(*rows), strict=True)]
            at[new] = np.arange(held, held + len(new))
            kept = int(np.count_nonzero(times[new] > 1))
            self.known.update((words[k], held + i) for i, k in enumerate(new[:kept].tolist()))
            self.columns = [c[: held + kept].copy() for c in columns]
        else:
            columns = self.columns
        return [c[at] for c in columns]


_TOLD = _Told()


def _forget() -> None:
    _TOLD.__init__()
    _item.cache_clear()


def _templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Offsets of the words of each text, their template hashes, slot marks, literal hashes and codes, and the distinct words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.utf8_split_whitespace(column.fill_null("").cast(pa.large_string()))
    flat, offsets = lists.values, lists.offsets.to_numpy()
    coded = flat.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    offsets = offsets - offsets[0]
    hashes, kind, ends, plain, solid = _TOLD.of(words, np.bincount(codes, minlength=len(words)))
    held = solid[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(held)))
    offsets, codes = kept[offsets], codes[held]
    begins = np.ones(len(codes), bool)  # at the begin of a sentence a capital makes no name
    begins[1:] = ends[codes[:-1]]
    begins[offsets[:-1][offsets[:-1] < len(codes)]] = True
    kinds = kind[codes]
    name = (kinds == 1) & ~begins
    template = np.where(name, np.uint64(NAME), hashes[codes])
    return offsets, template, name | (kinds == 2), plain[codes], codes, words


def _bare(word: str) -> str:
    return word if word.isalnum() else _EDGES.sub("", word)


def _windows(template: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the window that begins at each word but the last four, and whether it has enough words of its own."""
    n = len(template) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    hashed = np.zeros(n, np.uint64)
    literal = np.zeros(n, np.int8)
    for k in range(WINDOW):
        hashed = hashed * _FACTORS[1] + template[k : k + n]
        literal += ~slot[k : k + n]
    hashed ^= hashed >> np.uint64(32)
    return hashed * np.uint64(0xD6E8FEB86659FD93), literal >= LITERALS


def _literal(plain: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The hash of the ``width`` words without case that begin at each place where so many follow."""
    n = max(0, len(plain) - width + 1)
    hashed = np.full(n, width, np.uint64)
    for k in range(width):
        hashed = hashed * _FACTORS[1] + plain[k : k + n]
    hashed ^= hashed >> np.uint64(32)
    return hashed * np.uint64(0xD6E8FEB86659FD93)


class Item:
    """An item's words, template windows and literal windows: (place, hash) of each."""

    def __init__(self, text: str) -> None:
        _, template, slot, plain, codes, words = _templates(pa.array([text], pa.string()))
        self.words, self.slot = [_bare(words[c]).lower() for c in codes.tolist()], slot
        own, good = _windows(template, slot)
        places = np.flatnonzero(good)
        self.needed = len(places)
        hashes = own[places]
        # inside a document's sentence the item's first word may pass for a name
        if len(own) and not slot[0] and words[codes[0]] and _bare(words[codes[0]])[:1].isupper():
            template, slot = template[:WINDOW].copy(), slot[:WINDOW].copy()
            template[0], slot[0] = np.uint64(NAME), True
            other, good = _windows(template, slot)
            if good[0]:
                places, hashes, self.needed = np.append(places, 0), np.append(hashes, other), self.needed + (0 not in places)
        self.places, self.hashes = places, hashes
        self.width = min(WINDOW, len(codes))
        self.literal = _literal(plain, self.width) if self.width else np.zeros(0, np.uint64)


@lru_cache(maxsize=4096)
def _item(text: str) -> Item:
    return Item(text)


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, text) of each distinct text, under its least item_id; and (item, set, width, place, hash) of all its windows.

    Null texts and texts without words have none. set: 0 for template windows, 1 for literal ones.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("text").alias("item"), "item_id", "text")
    items = written(items, "benchmark-items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("decontaminate", _forget)
        for batch in batches:
            for key, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Item(text)
                n, m = len(own.hashes), len(own.literal)
                sets = np.repeat(np.array([0, 1], np.int32), [n, m])
                widths = np.repeat(np.array([0, own.width], np.int32), [n, m])
                places = np.concatenate([own.places, np.arange(m)]).astype(np.int64)
                hashes = np.concatenate([own.hashes, own.literal]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + m, key)), pa.array(sets), pa.array(widths), pa.array(places), pa.array(hashes)], names=["item", "set", "width", "place", "hash"])

    return items, items.select("item", "text").mapInArrow(run, "item long, set int, width int, place long, hash long")


def _rarest(windows: DataFrame) -> DataFrame:
    """(item, width, hash) of so many of each set's rarest places that CONTAINMENT can't be reached without them."""
    known = windows.groupBy("hash").agg(F.count("*").alias("n"))
    each = windows.join(known, "hash")
    places = each.groupBy("item", "set", "place").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("item", "set")
    ranked = places.withColumn("rank", F.row_number().over(own.orderBy("n", "place"))).withColumn("all", F.count("*").over(own))
    kept = ranked.where(F.col("rank") <= F.col("all") - F.ceil(F.col("all") * CONTAINMENT) + 1).select("item", "set", "place")
    return windows.join(kept, ["item", "set", "place"], "left_semi").select("item", "width", "hash").distinct()


def _filter(rarest: DataFrame) -> np.ndarray:
    """A bit for each window; of fixed size, so it may go through the driver."""
    place = F.shiftright(F.col("hash"), 64 - FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    rows = rarest.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return found.view(np.uint64)


def _passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    place = hashed >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` windows of a column end in the text in which they begin."""
    return doc[:n] == doc[len(doc) - n :]


def candidates(docs: DataFrame, key: str, rarest: DataFrame) -> DataFrame:
    """(key, item) of texts that have one of an item's rarest windows."""
    widths = sorted(r[0] for r in rarest.select("width").distinct().collect())  # six at most
    shipped = docs.sparkSession.sparkContext.broadcast(_filter(rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("decontaminate", _forget)
        bits = shipped.value
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            offsets, template, slot, plain, _, _ = _templates(batch.column("text"))
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            rows, hashes = [], []
            for width in widths:
                hashed, good = _windows(template, slot) if width == 0 else (_literal(plain, width), True)
                at = np.flatnonzero(good & _inside(doc, len(hashed)) & _passes(bits, hashed))
                rows.append(doc[at])
                hashes.append(hashed[at])
            if rows:
                found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(hashes)]), axis=1)
                keys = batch.column(key).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys[found[0].astype(np.int64)]), pa.array(found[1].view(np.int64))], names=["key", "hash"])

    hits = docs.select(key, "text").mapInArrow(run, "key long, hash long")
    return hits.join(rarest.select("hash", "item"), "hash").select("key", "item").distinct()


def _spans(place: np.ndarray, inner: np.ndarray, reach: int, needed: int) -> Iterator[slice]:
    """Of hits in order of their place, the stretches within ``reach`` that have so many of the item's windows; one that a longer one holds is left out."""
    end, over = 0, 0
    counts: Counter = Counter()
    for begin in range(len(place)):
        while end < len(place) and place[end] < place[begin] + reach:
            counts[int(inner[end])] += 1
            end += 1
        if len(counts) >= needed and end > over:
            yield slice(begin, end)
            over = end
        counts[int(inner[begin])] -= 1
        if not counts[int(inner[begin])]:
            del counts[int(inner[begin])]


def _hits(order: np.ndarray, ranked: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text and in the item of the windows that both have, in order of the text; ranked: the text's hashes, sorted by ``order``."""
    low, high = (np.searchsorted(ranked, hashes, side=side) for side in ("left", "right"))
    times = high - low
    each = np.repeat(np.arange(len(hashes)), times)
    place = order[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
    inner = places[each]
    by = np.lexsort((inner, place))
    return place[by], inner[by]


class _Text:
    """A document's windows, sorted for look-up."""

    def __init__(self, text: str) -> None:
        _, template, slot, self.plain, self.codes, self.words = _templates(pa.array([text], pa.string()))
        hashed, good = _windows(template, slot)
        at = np.flatnonzero(good)
        self.order = at[np.argsort(hashed[at], kind="stable")]
        self.ranked = hashed[self.order]
        self.literal: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def word(self, place: int) -> str:
        return _bare(self.words[self.codes[place]]).lower()

    def leak(self, item: Item) -> tuple[float, str, int] | None:
        """containment, kind and changed slot values of the best stretch that has the item."""
        reach = SPREAD * max(len(item.words), WINDOW)
        best: tuple[float, int] | None = None
        place, inner = _hits(self.order, self.ranked, item.places, item.hashes)
        if item.needed:
            for s in _spans(place, inner, reach, _least(item.needed)):
                ok, changed = self._consistent(item, inner[s], place[s])
                told = (len(np.unique(inner[s])) / item.needed, -changed)
                if ok and (best is None or told > best):
                    best = told
        if best is not None:
            return best[0], "reparameterised" if best[1] else "exact", -best[1]
        n = len(item.literal)
        if n:
            if item.width not in self.literal:
                hashed = _literal(self.plain, item.width)
                order = np.argsort(hashed, kind="stable")
                self.literal[item.width] = order, hashed[order]
            place, inner = _hits(*self.literal[item.width], np.arange(n), item.literal)
            have = [len(np.unique(inner[s])) for s in _spans(place, inner, reach, _least(n))]
            if have:
                return max(have) / n, "exact", 0
        return None

    def _consistent(self, item: Item, inner: np.ndarray, place: np.ndarray) -> tuple[bool, int]:
        """Whether each slot value of the item stands for one value of the document, and how many differ from the item's.

        A window that the document has more than once is read where most windows of the item lie beside it.
        """
        shift = Counter((place - inner).tolist())
        best: dict[int, int] = {}
        for i, p in zip(inner.tolist(), place.tolist(), strict=True):
            if i not in best or shift[p - i] > shift[best[i] - i]:
                best[i] = p
        values: dict[str, Counter] = defaultdict(Counter)
        seen = set()
        for i, p in sorted(best.items()):
            for j in range(WINDOW):
                if item.slot[i + j] and i + j not in seen:
                    seen.add(i + j)
                    values[item.words[i + j]][self.word(p + j)] += 1
        total = sum(sum(c.values()) for c in values.values())
        agreed = sum(max(c.values()) for c in values.values())
        return agreed >= CONSISTENT * total, sum(1 for v, c in values.items() if min(c, key=lambda x: (-c[x], x)) != v)


def _least(n: int) -> int:
    """The least number of windows that is CONTAINMENT of ``n``."""
    return next(k for k in range(int(n * CONTAINMENT), n + 1) if k >= CONTAINMENT * n)


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """The leaks with the key of their row's text, a row for each row of ``docs``."""
    items, windows = item_windows(benchmark)
    windows = written(windows, "benchmark-windows")
    rarest = written(_rarest(windows), "benchmark-rarest")
    pairs = written(candidates(docs, key, rarest), "benchmark-candidates")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("item")) - 1
    some = pairs.withColumn("some", F.floor(nth / ITEMS_AT_ONCE)).join(items, "item")
    beside = some.groupBy("key", "some").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"))).alias("items")).withColumnRenamed("key", key).drop("some")
    # the keys alone are written, whose size on disk is their size, so that few of them are broadcast and the documents stay where they are
    keys = written(pairs.select(F.col("key").alias(key)).distinct(), "benchmark-keys")
    met = docs.select("doc_id", key, "text").join(keys, key, "left_semi").join(beside, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("decontaminate", _forget)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                text = _Text(row["text"] or "")
                rows += [(row["doc_id"], row[key], x["item_id"], *told) for x in row["items"] if (told := text.leak(_item(x["item_text"]))) is not None]
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "item_id", "containment", "kind", "changed"])

    return met.mapInArrow(run, "doc_id long, key long, item_id long, containment double, kind string, changed long")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = fresh(docs, "text_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, containment, kind and changed (slot values that differ) of every leak.

    Null and empty texts and items match nothing; an item shorter than five words matches where it stands whole. Repeated rows each give
    their own leaks. Items of one text are one item, that with the least item_id. An empty benchmark finds none.
    """
    return _leaks(*_readable(docs, benchmark)).drop("key")


def _readable(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    keyed, key = _keyed(docs.select("doc_id", "text"))
    return keyed, benchmark.select("item_id", "text"), key


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    found = written(_leaks(*_readable(docs, benchmark)).select("key").distinct(), "leaking")
    keyed, key = _keyed(docs)
    return keyed.join(found.withColumnRenamed("key", key), key, "left_anti").select(docs.columns)
