"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item if some stretch of it is within ``floor(0.2 * n)`` word edits of the item's
n words (ASCII upper case folded). The search runs inside the scan of the documents:

1. A lossless filter: such a stretch shares at least n - 1 - 2 * floor(0.2 * n) word pairs with the
   item, so only windows with that many pairs of any item are looked at.
2. Each such item-sized window, and each item, goes through the CGK random walk: step j emits the
   word under the pointer and a random bit of (word, j) says whether the pointer moves. Few edits
   become few differing steps. ``REPETITIONS`` independent walks, each sampled at ``BITS`` steps,
   give signatures; a window and an item that agree in one are a candidate. With agreement p per step
   the recall of one window is 1 - (1 - p**BITS)**REPETITIONS, 0.99 at p = 0.46; a leak has several windows.
3. Each candidate is verified by the exact edit distance between the item and any stretch of the
   region (bit-parallel dynamic program).

Items of more than ``PART_WORDS`` words are searched by parts of half that length and more: if an item
is within a fifth of its words, some part is within a fifth of its own, so the recall of a long item is
that of its parts, and each found part is verified as the whole item in the region around it.

Items are the stated query set: they are handed to the scan in blocks of ``BLOCK_ITEMS``, whatever
their number. Documents are never shuffled.

Cases with a defined result: null or empty texts and items match nothing; items of one or two words,
which no edit may touch, match where they stand word for word; a text of any length is searched whole; all items that a document leaks
are reported, with the least number of edits of any place;
repeated rows and repeated items are reported one by one; an empty table on either side gives no
row; a null item_id is an item like others; extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix64, range_hash, split_words, text_slices

MAX_EDIT_SHARE = 0.2
#: Longer items are searched by parts.
PART_WORDS = 80
REPETITIONS = 48
BITS = 3
BLOCK_ITEMS = 10_000
#: Of the starts that pass the filter around one place, every so many-th is embedded; a start that is
#: off by one word costs the walk one edit, and a leak has tens of starts. Of short items every start is.
STRIDE, STRIDE_WORDS = 3, 20
#: Windows embedded at once.
FLUSH_WINDOWS = 8_192
_TABLE_BITS = 20
_PAD = np.uint64(0)


@dataclass
class Items:
    """A block of items, cut into parts; parts are grouped by size classes whose lengths differ by a quarter at most.

    Items of one word are held apart: they have no word pairs.
    """

    ids: list
    words: list[np.ndarray]
    parts: list[np.ndarray] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    classes: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    singles: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        groups = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w) == 1:
                self.singles.setdefault(int(w[0]), []).append(k)
                continue
            for part in np.array_split(w, -(-len(w) // PART_WORDS)):
                groups[int(np.log(len(part)) / np.log(1.25))].append(len(self.parts))
                self.parts.append(part)
                self.of.append(k)
        self.classes = [np.array(groups[g]) for g in sorted(groups)]
        for members in self.classes:
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            for k in members:
                at = np.arange(len(self.parts[k]) - 1)
                table[self.slot(range_hash(self.parts[k], at, at + 2, seed=1))] = True
            self.pairs.append(table)

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    @staticmethod
    def edits(n: int) -> int:
        return int(MAX_EDIT_SHARE * n + 1e-9)

    def shape(self, c: int) -> tuple[int, int, int, int]:
        """Of a class: window length, word pairs that a leak must share, shortest part, and what may lie around a part."""
        sizes = [len(self.parts[k]) for k in self.classes[c]]
        around = max(len(self.words[self.of[k]]) + self.edits(len(self.words[self.of[k]])) - len(self.parts[k]) for k in self.classes[c])
        return max(n + self.edits(n) for n in sizes), min(n - 1 - 2 * self.edits(n) for n in sizes), min(sizes), around


def embed(windows: np.ndarray, steps: int, repetition: int, sampled: np.ndarray) -> np.ndarray:
    """Signature of each row of padded words: hash of the words emitted at the sampled steps of one walk."""
    at = np.zeros(len(windows), dtype=np.int64)
    row = np.arange(len(windows))
    out = np.zeros(len(windows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(steps):
            word = windows[row, at]
            if sampled[j]:
                out = mix64(out ^ word)
            at += ((word * (mix64(np.uint64(repetition * 10_007 + j + 1)) | np.uint64(1))) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, windows.shape[1] - 1, out=at)
    return out


def _walks(shortest: int, repetition: int) -> tuple[int, np.ndarray]:
    """Number of steps, and which of them are sampled. 2n steps pass n words on average."""
    steps = 2 * shortest
    sampled = np.zeros(steps, dtype=bool)
    sampled[np.random.default_rng(repetition).choice(steps, min(BITS, steps), replace=False)] = True
    last = int(np.flatnonzero(sampled)[-1]) + 1
    return last, sampled[:last]


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(rows), width + 1), _PAD)
    for k, r in enumerate(rows):
        out[k, : min(len(r), width)] = r[:width]
    return out


def best_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of word edits between the item and any stretch of the text."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item.tolist()):
        equal[w] |= 1 << k
    plus, minus, score = full, 0, m
    best = m
    for w in text.tolist():
        eq = equal.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(horizontal | plus) & full), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(vertical | up) & full), up & vertical
        best = min(best, score)
    return best


class _Search:
    """Collects windows of a batch, then finds and verifies leaks: rows (row of the batch, item, edits)."""

    def __init__(self, items: Items):
        self.items = items
        self.signatures = []
        for c, members in enumerate(items.classes):
            width, _, shortest, _ = items.shape(c)
            rows = _padded([items.parts[k] for k in members], width)
            of_class = []
            for r in range(REPETITIONS):
                steps, sampled = _walks(shortest, r)
                signature = embed(rows, steps, r, sampled)
                order = np.argsort(signature, kind="stable")
                of_class.append((signature[order], members[order]))
            self.signatures.append(of_class)
        self.reset()

    def reset(self) -> None:
        self.windows = [[] for _ in self.items.classes]
        self.regions: list[tuple[int, np.ndarray]] = []
        self.single: set[tuple[int, int]] = set()
        self.waiting = 0

    def add(self, row: int, words: np.ndarray, offsets: np.ndarray) -> None:
        """Windows of a slice that share enough word pairs with any item; ``row`` is that of the first text."""
        n = len(words)
        if self.items.singles:
            for k in np.flatnonzero(np.isin(words, np.fromiter(self.items.singles, dtype=np.uint64))):
                doc = row + int(np.searchsorted(offsets, k, side="right")) - 1
                self.single.update((doc, m) for m in self.items.singles[int(words[k])])
        if n < 2:
            return
        at = np.arange(n - 1)
        slots = Items.slot(range_hash(words, at, at + 2, seed=1))
        ends = offsets[1:-1]
        ends = ends[(ends > 0) & (ends < n)] - 1
        for c, table in enumerate(self.items.pairs):
            hit = table[slots]
            hit[ends] = False
            total = np.concatenate([[0], np.cumsum(hit)])
            width, need, shortest, around = self.items.shape(c)
            stride = STRIDE if shortest >= STRIDE_WORDS else 1
            stop = np.minimum(at + width - 1, n - 1)
            start = np.flatnonzero(total[stop] - total[at] >= need)
            if not len(start):
                continue
            doc = np.searchsorted(offsets, start, side="right") - 1
            new = np.flatnonzero(np.concatenate([[True], (np.diff(start) > width) | (np.diff(doc) > 0)]))
            for a, b in zip(new, np.append(new[1:], len(start)), strict=True):
                end = offsets[doc[a] + 1]
                region = words[start[a] : min(start[b - 1] + width, end)]
                whole = words[max(start[a] - around, offsets[doc[a]]) : min(start[b - 1] + width + around, end)]
                self.regions.append((row + int(doc[a]), whole))
                padded = np.concatenate([region, np.full(width + 1, _PAD)])
                view = np.lib.stride_tricks.sliding_window_view(padded, width + 1)[start[a:b:stride] - start[a]]
                self.windows[c].append((len(self.regions) - 1, view))
                self.waiting += len(view)

    def found(self) -> dict[tuple[int, int], int]:
        """Verified leaks among the windows collected so far: (row, item) to least edits."""
        candidates: set[tuple[int, int]] = set()
        for c, blocks in enumerate(self.windows):
            if not blocks:
                continue
            region = np.repeat([k for k, _ in blocks], [len(v) for _, v in blocks])
            rows = np.concatenate([v for _, v in blocks])
            for r, (keys, members) in enumerate(self.signatures[c]):
                steps, sampled = _walks(self.items.shape(c)[2], r)
                signature = embed(rows, steps, r, sampled)
                low, high = np.searchsorted(keys, signature), np.searchsorted(keys, signature, side="right")
                for k in np.flatnonzero(high > low):
                    candidates.update((int(region[k]), int(m)) for m in members[low[k] : high[k]])
        out: dict[tuple[int, int], int] = dict.fromkeys(self.single, 0)
        for k, m in {(k, self.items.of[part]) for k, part in candidates}:
            row, words = self.regions[k]
            item = self.items.words[m]
            edits = best_edits(item, words)
            if edits <= Items.edits(len(item)):
                out[row, m] = min(edits, out.get((row, m), edits))
        self.reset()
        return out


def _scan(column: pa.Array, search: _Search) -> dict[tuple[int, int], int]:
    out: dict[tuple[int, int], int] = {}

    def flush():
        for key, edits in search.found().items():
            out[key] = min(edits, out.get(key, edits))

    for row, _, data, offsets in text_slices(column):
        words = split_words(data, offsets, lower=True)
        search.add(row, words.hashes, words.first)
        if search.waiting >= FLUSH_WINDOWS:
            flush()
    flush()
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    while block := list(islice(rows, BLOCK_ITEMS)):
        texts = pa.array([r[1] for r in block], pa.string())
        ids, words = [], []
        for row, stop, data, offsets in text_slices(texts):
            split = split_words(data, offsets, lower=True)
            for k in range(row, stop):
                own = split.hashes[split.first[k - row] : split.first[k - row + 1]]
                if len(own):
                    ids.append(block[k][0])
                    words.append(own)
        if ids:
            yield Items(ids, words)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits and item_words for every document that leaks an item."""
    schema = "doc_id long, item_id long, edits long, item_words long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = source.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            search = _Search(items)
            for batch in batches:
                found = sorted(_scan(batch.column(1), search).items())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row for (row, _), _ in found], pa.int64())),
                        pa.array([items.ids[m] for (_, m), _ in found], pa.int64()),
                        pa.array([e for _, e in found], pa.int64()),
                        pa.array([len(items.words[m]) for (_, m), _ in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "item_words"],
                )

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, unchanged in all columns."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            search = _Search(items)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, _ in _scan(batch.column("text"), search)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
