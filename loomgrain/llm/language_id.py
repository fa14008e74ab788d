"""Languages of texts and of spans inside them.

A word's script, told from the range of its first letter, narrows the candidates to languages that were
learned in that script. Each candidate scores the word by its letter trigrams, and Viterbi over the words
of a text, with a penalty for each switch, labels spans. The language of a text is the one with most letters.

Learning counts hashed trigrams of a sample of labelled rows, at most about ``sample`` a language, chosen by a hash
of their id; the model is a table of BUCKETS rows and one column a language, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.shared import slices, turn

BUCKETS = 1 << 18
#: Documents to learn from, for each language.
SAMPLE = 1500
#: What a switch of language costs, in natural logarithms of likelihood.
SWITCH = 8.0
#: The most that one word counts for or against a language.
WORD_LIMIT = 12.0
#: Bytes of text that are cut into words at once; the columns of the words and their trigrams take many times as much.
BYTES_AT_ONCE = 4_000_000
#: A script's share of a language's letters from which the language is a candidate for its words.
SCRIPT_SHARE = 0.001
UND = "und"

#: The first code points of ranges, and the script that each begins.
_RANGES = (
    (0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 0), (0x900, 6), (0x980, 7), (0xE00, 8), (0xE80, 0),
    (0x10A0, 9), (0x1100, 10), (0x1200, 11), (0x13A0, 0), (0x1780, 12), (0x1800, 0), (0x1F00, 1), (0x2000, 0), (0x2E80, 13), (0x3040, 14), (0x3100, 13),
    (0x3130, 10), (0x31A0, 13), (0xA000, 0), (0xAC00, 10), (0xD7B0, 0), (0xF900, 13), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0xFF66, 14), (0xFFA0, 10), (0xFFE0, 0), (0x20000, 13), (0x30000, 0),
)
SCRIPTS = 15
_STARTS = np.array([a for a, _ in _RANGES])
_SCRIPT = np.array([b for _, b in _RANGES])


@dataclass(frozen=True)
class Model:
    """languages in order; weights: log probability of each trigram bucket (BUCKETS x languages); candidates: scripts x languages."""

    languages: tuple[str, ...]
    weights: np.ndarray
    candidates: np.ndarray
    likeliest: int


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every trigram of every word, its marks of begin and end included; where each word begins; its script."""
    points = np.frombuffer(("\n" + "\n\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    x = points.astype(np.uint64)
    hashed = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9))
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed >>= np.uint64(46)
    inside = np.ones(len(hashed), bool)
    inside[(starts[1:] - 1)] = False
    inside[(starts[1:] - 2)] = False
    begins = np.cumsum(lengths) - lengths  # a word of n letters has n trigrams
    script = _SCRIPT[np.searchsorted(_STARTS, points[starts + 1], side="right") - 1]
    return hashed[inside].astype(np.int64), begins, script


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Offsets of the words of each text, a code for each word, the distinct words, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.split_pattern_regex(pc.utf8_lower(column.fill_null("").cast(pa.large_string())), r"[^\pL]+")
    flat, offsets = lists.values, lists.offsets.to_numpy()
    coded = flat.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    offsets = offsets - offsets[0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    full = lengths[codes] > 0
    kept = np.concatenate(([0], np.cumsum(full)))
    return kept[offsets], codes[full], words, lengths


def train(labelled: DataFrame, sample: int = SAMPLE, seed: str = "doc_id") -> Model:
    """A model from ``labelled`` (text, lang, and the column ``seed`` that picks the sample). Rows without text or lang teach nothing."""
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool), 0)
    # a language's share of the hash range is such that about ``sample`` of its rows fall in it
    share: Column = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))[F.col("lang")]
    place = F.pmod(F.xxhash64(F.col(seed), F.lit("learn")), F.lit(1_000_000)) / 1_000_000
    picked = rows.where(place < share).select("text", "lang")
    at = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("language")
        grams = np.zeros((len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), SCRIPTS), np.int64)
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            offsets, codes, words, lengths = _words(batch.column("text"))
            langs = np.repeat([at[x] for x in batch.column("lang").to_pylist()], np.diff(offsets))
            if not len(codes):
                continue
            solid = [w or "\n" for w in words]
            bucket, begins, script = _trigrams(solid)
            for k in np.unique(langs).tolist():
                times = np.bincount(codes[langs == k], minlength=len(words))
                n = np.fromiter(map(len, solid), np.int64, len(solid))
                grams[k] += np.bincount(bucket, np.repeat(times, n), minlength=BUCKETS).astype(np.int64)
                scripts[k] += np.bincount(script, times * lengths, minlength=SCRIPTS).astype(np.int64)
        for kind, table in ((0, grams), (1, scripts)):
            k, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind)), pa.array(k), pa.array(b), pa.array(table[k, b])], names=["kind", "lang", "bucket", "n"])

    sums = picked.mapInArrow(count, "kind long, lang long, bucket long, n long").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((SCRIPTS, len(languages)))
    for kind, table in ((0, grams), (1, scripts)):
        own = sums[sums["kind"] == kind]
        table[own["bucket"].to_numpy(), own["lang"].to_numpy()] = own["n"].to_numpy()
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    candidates = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0))
    return Model(languages, weights, candidates, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


def _scores(model: Model, words: list[str]) -> np.ndarray:
    """Of each word, how far each language is behind the best candidate, at most WORD_LIMIT; no candidate in its script: all even."""
    bucket, begins, script = _trigrams([w or "\n" for w in words])
    sums = np.add.reduceat(model.weights[bucket], begins, axis=0)
    allowed = model.candidates[script]
    allowed = allowed | ~allowed.any(axis=1, keepdims=True)
    sums = np.where(allowed, sums, -np.inf)
    sums -= sums.max(axis=1, keepdims=True)
    unseen = ~model.candidates.any(axis=1)[script]
    sums[unseen] = 0
    return np.maximum(sums, -WORD_LIMIT).astype(np.float32)


def viterbi(scores: np.ndarray, codes: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the likeliest path through each text; all texts step together, longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    label = np.zeros(len(codes), np.int16)
    if not longest:
        return label
    n_lang = scores.shape[1]
    own = np.arange(n_lang, dtype=np.int16)
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts that have a word of that place
    back = np.zeros((len(codes), n_lang), np.int16)
    at = np.zeros((active[0], n_lang), np.float32)
    for t in range(longest):
        k = int(active[t])
        place = starts[:k] + t
        at = at[:k] if t < 1 or k == len(at) else _ended(at, k, starts, t, label, lengths)
        if t:
            best = at.max(axis=1, keepdims=True)
            moved = at < best - switch
            if moved.any():
                back[place] = np.where(moved, at.argmax(axis=1).astype(np.int16)[:, None], own)
                at = np.where(moved, best - switch, at)
            else:
                back[place] = own
        at = at + scores[codes[place]]
    _ended(at, 0, starts, longest, label, lengths)
    # back along the pointers, shortest texts join as their last word comes up
    for t in range(longest - 2, -1, -1):
        k = int(active[t + 1])
        place = starts[:k] + t
        label[place] = back[place + 1, label[place + 1]]
    return label


def _ended(at: np.ndarray, k: int, starts: np.ndarray, t: int, label: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels the last word of the texts that end before place ``t``, and gives the scores of the others."""
    over = slice(k, len(at))
    label[starts[over] + lengths[over] - 1] = at[over].argmax(axis=1)
    return at[:k]


def _labels(model: Model, column: pa.Array, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    offsets, codes, words, lengths = _words(column)
    if not len(codes):
        return offsets, codes, np.zeros(0, np.int16), lengths, words
    return offsets, codes, viterbi(_scores(model, words), codes, offsets, switch), lengths, words


def _picked(model: Model, column: pa.Array, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The place of each text's language, one behind the last for none, and its share of the letters."""
    n, n_lang = len(column), len(model.languages)
    if not n_lang:
        return np.zeros(n, np.int64), np.zeros(n)
    offsets, codes, label, lengths, _ = _labels(model, column, switch)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    mass = np.bincount(doc * n_lang + label, lengths[codes], minlength=n * n_lang).reshape(n, n_lang)
    total = mass.sum(axis=1)
    return np.where(total > 0, mass.argmax(axis=1), n_lang), np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred and score (the share of the letters that carry it) of every whole text.

    ``und`` and 0 where a text is null or has no letter. Ties go to the language that comes first by name. A model
    that learned no language gives ``und`` to all.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("language")
        own = shipped.value
        names = [*own.languages, UND]
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            pick, score = _picked(own, batch.column("text"), switch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[k] for k in pick.tolist()], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """The rows, with all their columns, whose text has letters and gives at least ``least`` of them to one language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("language")
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            pick, score = _picked(shipped.value, batch.column("text"), switch)
            yield batch.filter(pa.array((pick < len(shipped.value.languages)) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, begin, end (code points of the lower-cased text, end exclusive) and lang of each run of words in one language."""
    import regex

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    letters = regex.compile(r"\p{L}+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in slices(batches, "text"):
            out: list[tuple[int | None, int, int, str]] = []
            offsets, label = np.zeros(batch.num_rows + 1, np.int64), np.zeros(0, np.int16)
            if own.languages:
                offsets, _, label, _, _ = _labels(own, batch.column("text"), switch)
            lowered = pc.utf8_lower(batch.column("text").fill_null("")).to_pylist()
            for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), lowered, strict=True)):
                before = -1
                for m, lang in zip(letters.finditer(text) if offsets[k] < offsets[k + 1] else (), label[offsets[k] : offsets[k + 1]].tolist(), strict=True):
                    begin = out.pop()[1] if lang == before else m.start()
                    out.append((doc, begin, m.end(), own.languages[lang]))
                    before = lang
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "begin", "end", "lang"), x, strict=True)) for x in out], schema=pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, end long, lang string")


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts for all."""
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
