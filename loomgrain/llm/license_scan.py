"""License texts and notices in documents.

Words lose case and the signs around them; shingles are five words. A document's shingles lie in blocks of BLOCK places. Windows of
2 S places overlap by half for S = BLOCK, 2 BLOCK, 4 BLOCK and so on, and a template is looked for in the windows whose S is at least
1.25 times its number of shingles, so that wherever it stands, one window has it whole. That window shares at least the fraction
``least_similarity`` with the template, and HASHES bands of one row collide with a probability of at least COLLISION for it.
Each retrieved window is then read exactly: the share of the template's shingles that it holds must reach CONTAINMENT.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from loomgrain.llm.shared import slices

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK = 4
HASHES = 64
COLLISION = 0.999
#: Bytes of all templates' texts; more is refused, since all templates are sent to every worker at once.
MOST_BYTES = 64_000_000

#: Short notices, as (license, text). Full texts and standard headers are files of the folder licenses.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

FOLDER = Path(__file__).parent / "licenses"

_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh32_intdigest(str(k)) | 1 for k in range(HASHES)], np.uint32)


def collision(similarity: float, bands: int = HASHES, rows: int = 1) -> float:
    """The probability that a window of that similarity shares a band with a template."""
    return 1 - (1 - similarity**rows) ** bands


def level_of(n: int) -> int:
    """The least level whose S = BLOCK * 2 ** level places hold 1.25 times ``n`` shingles."""
    level = 0
    while BLOCK << level < 1.25 * n:
        level += 1
    return level


def least_similarity(n: int) -> float:
    """The least Jaccard similarity of a template of ``n`` shingles and a window that has CONTAINMENT of it."""
    held = max(1, -(-n * CONTAINMENT // 1))
    return held / ((2 * BLOCK << level_of(n)) + n - held)


def full_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of every full license text, NAME.txt, and of every standard header, NAME.header.txt, without copyright lines' names."""
    return tuple((f.name.removesuffix(".txt").removesuffix(".header"), f.read_text(encoding="utf-8")) for f in sorted(FOLDER.glob("*.txt")))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of the bare words of each text, a code for each, and the distinct bare words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.utf8_split_whitespace(column.fill_null("").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    codes = coded.indices.to_numpy()
    words = [(w if w.isalnum() else _EDGES.sub("", w)).lower() for w in coded.dictionary.to_pylist()]
    solid = np.fromiter(map(bool, words), bool, len(words))[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(solid)))
    return kept[offsets - offsets[0]], codes[solid], words


def _shingles(codes: np.ndarray, words: list[str]) -> np.ndarray:
    """A hash of the shingle that begins at each word but the last four."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(codes) - SHINGLE + 1)
    found = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        found = found * _FACTOR + hashes[k : k + n]
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def _small(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Templates:
    """Templates by level: their shingle hashes, and of each hash function the MinHash values in order, whose they are, and which occur."""

    names: tuple[str, ...]
    shingles: tuple[frozenset[int], ...]
    values: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    present: dict[int, np.ndarray]

    def retrieved(self, level: int, k: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows, and the templates whose value of hash function ``k`` they have."""
        hit = np.flatnonzero(self.present[level][k][window >> 16])
        low, high = (np.searchsorted(self.values[level][k], window[hit], side=side) for side in ("left", "right"))
        times = high - low
        each = np.repeat(np.arange(len(hit)), times)
        return hit[each], self.owners[level][k][low[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]


def prepare(templates: Sequence[tuple[str, str]]) -> Templates:
    """Templates of fewer than five words have no shingle and are not looked for."""
    offsets, codes, words = _words(pa.array([t for _, t in templates], pa.string()))
    names, shingles, signatures, levels = [], [], [], []
    for k, (name, _) in enumerate(templates):
        own = np.unique(_shingles(codes[offsets[k] : offsets[k + 1]], words))
        if len(own):
            if collision(least_similarity(len(own))) < COLLISION:
                raise ValueError(f"the bands would miss {name} too often")
            names.append(name)
            shingles.append(frozenset(own.tolist()))
            signatures.append((_small(own)[None, :] * _SEEDS[:, None]).min(axis=1))
            levels.append(level_of(len(own)))
    values, owners, present = {}, {}, {}
    table = np.array(signatures, np.uint32).reshape(-1, HASHES)
    for level in sorted(set(levels)):
        own = np.flatnonzero(np.array(levels) == level)
        order = np.argsort(table[own], axis=0, kind="stable").T
        owners[level] = own[order]
        values[level] = np.take_along_axis(table[own].T, order, axis=1)
        present[level] = np.zeros((HASHES, 1 << 16), bool)
        for k in range(HASHES):
            present[level][k, values[level][k] >> 16] = True
    return Templates(tuple(names), tuple(shingles), values, owners, present)


def _found(templates: Templates, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, end word) of each match in a column of texts."""
    offsets, codes, words = _words(column)
    if not len(codes) or not templates.values:
        return []
    hashes = _shingles(codes, words)
    counts = np.maximum(0, np.diff(offsets) - SHINGLE + 1)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return []
    # blocks of each text by level; an odd last block stands alone on the level above
    blocks = [-(-counts[rows] // BLOCK)]
    for _ in range(max(templates.values)):
        blocks.append((blocks[-1] + 1) // 2)
    starts = [np.cumsum(b) - b for b in blocks]
    inside = [np.arange(int(b.sum())) - np.repeat(s, b) for b, s in zip(blocks, starts, strict=True)]
    left = [None, *(np.repeat(starts[v - 1], blocks[v]) + 2 * inside[v] for v in range(1, len(blocks)))]
    right = [None, *(np.minimum(left[v] + 1, np.repeat(starts[v - 1] + blocks[v - 1], blocks[v]) - 1) for v in range(1, len(blocks)))]
    last = [s + b - 1 for s, b in zip(starts, blocks, strict=True)]
    # behind its end a text's last shingle repeats, which changes no minimum
    of = np.repeat(np.arange(len(rows)), blocks[0])
    inner = np.minimum(inside[0][:, None] * BLOCK + np.arange(BLOCK), counts[rows][of][:, None] - 1)
    grid = np.ascontiguousarray(_small(hashes[offsets[:-1][rows][of][:, None] + inner]).T)
    pairs: set[tuple[int, int, int]] = set()
    product = np.empty_like(grid)
    for k in range(HASHES):
        np.multiply(grid, _SEEDS[k], out=product)
        least = product.min(axis=0)
        for level in range(len(blocks)):
            if level:
                least = np.minimum(least[left[level]], least[right[level]])
            if level not in templates.values:
                continue
            window = least.copy()
            np.minimum(window[:-1], least[1:], out=window[:-1])
            window[last[level]] = least[last[level]]
            at, whose = templates.retrieved(level, k, window)
            pairs.update(zip([level] * len(at), at.tolist(), whose.tolist()))
    matches = {}
    for level, w, t in sorted(pairs):
        size = BLOCK << level
        row = int(np.searchsorted(starts[level], w, side="right")) - 1
        begin = int(inside[level][w]) * size
        end = min(begin + 2 * size, int(counts[rows[row]]))
        base = int(offsets[rows[row]])
        own = hashes[base + begin : base + end].tolist()
        held = [i for i, h in enumerate(own) if h in templates.shingles[t]]
        share = len({own[i] for i in held}) / len(templates.shingles[t])
        if share >= CONTAINMENT:
            # neighbouring windows see the same place; the one that holds more tells of it
            first, over = begin + held[0], begin + held[-1] + SHINGLE
            key = (int(rows[row]), t, first)
            if key not in matches or matches[key][2] < share:
                matches[key] = (int(rows[row]), t, share, first, over)
    return _best(sorted(matches.values()))


def _best(matches: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Without those of whose words better ones hold half or more; ties stay."""
    best: dict[tuple[int, int], float] = {}
    for row, _, share, begin, end in matches:
        for k in range(begin, end):
            best[row, k] = max(share, best.get((row, k), 0.0))
    return [m for m in matches if 2 * sum(best[m[0], k] > m[2] for k in range(m[3], m[4])) < m[4] - m[3]]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, license, containment, begin and end (bare words of the text, end exclusive) of every template found.

    Null and empty texts and texts of fewer than five words hold none. Repeated rows each give their own. Where
    templates overlap, one goes of which others with a higher containment cover half; without templates there are no rows.
    """
    if sum(len(text.encode()) for _, text in templates) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes of templates")
    shipped = docs.sparkSession.sparkContext.broadcast(prepare(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in slices(batches, "text", 4_000_000):
            rows = _found(own, batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            columns = ([names[r[0]] for r in rows], [own.names[r[1]] for r in rows], *([r[i] for r in rows] for i in (2, 3, 4)))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "containment", "begin", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, begin long, end long")
