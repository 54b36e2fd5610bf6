"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction.

All decisions depend on lengths alone, and there are at most ``capacity`` different ones, so the
packing is computed on the histogram of lengths (at most 2048 numbers, whatever the input) and then
dealt out to the pieces by their rank within their length. Ranks come from a window per (length,
salt) plus the counts of the salts before; a length has a salt for every ``TASK_PIECES`` pieces (more
in a table of more than GROUPS times as many), so that one that many pieces share is no hot key.

Cases with a defined result: null or empty text is one piece that holds the end id alone; repeated
rows are packed each for itself; a very long text becomes as many pieces as it needs; pieces of equal
length are interchangeable and go by doc_id and piece; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut
from .wordcache import WordCache
from .wordhash import fold, range_hash, split_words, text_slices

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that one task numbers, if that makes no more than so many groups of pieces in all.
TASK_PIECES, GROUPS = 2_000, 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _CACHES[path] = WordCache(lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)])
    return _CACHES[path]


def _pieces_of_words(data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what is looked up: words, with one full stop or comma after an ASCII letter apart.

    Such a mark is a pre-token of its own, so words are the same with and without it.
    """
    starts, ends = words.starts, words.ends
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)] | 0x20
    apart = (ends - starts > 1) & ((last == 0x2E) | (last == 0x2C)) & (before >= 0x61) & (before <= 0x7A)
    at = np.flatnonzero(apart) + 1
    return np.insert(starts, at, ends[apart] - 1), np.insert(ends - apart, at, ends[apart])


def document_ids(column: pa.Array, tokenizer: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets) of slices of a text column: the ids of each text, then the end id.

    The tokenizer must fold case, drop white space and never join across it, as word_bpe_49k does.
    """
    cache = _cache(tokenizer)
    for row, stop, data, offsets in text_slices(column):
        words = split_words(data, offsets)
        if len(words.starts):
            starts, ends = _pieces_of_words(data, words)
            # Case folds before the look-up, but for words that could be a special token in one case only.
            folded = fold(data)
            for k in np.flatnonzero(data == 0x3C):
                w = np.searchsorted(starts, k, side="right") - 1
                folded[starts[w] : ends[w]] = data[starts[w] : ends[w]]
            raw = folded.tobytes()
            slots, _ = cache.lookup(range_hash(folded, starts, ends), lambda i: raw[starts[i] : ends[i]].decode())
            first = np.searchsorted(starts, offsets)
        else:
            slots, first = np.empty(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(cache.lengths(slots))])
        ends_of = before[first[1:]]
        ids = np.insert(cache.gather(slots), ends_of, END_ID)
        yield row, ids, np.concatenate([[0], ends_of + np.arange(1, stop - row + 1)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for row, ids, offsets in document_ids(batch.column(1), tokenizer):
                ids = ids.astype("<u4")
                count = -(-np.diff(offsets) // capacity)
                of = np.repeat(np.arange(len(count)), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(offsets)[of] - start)
                first = offsets[of] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(of + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _fullest(left: dict[int, int], room: int) -> int:
    """The greatest sum of items of ``left`` that is at most ``room``, each used as often as it is there: a bit set of sums."""
    sums, mask = 1, (1 << (room + 1)) - 1
    for n, count in left.items():
        count, step = min(count, room // n), 1
        while count > 0:
            step = min(step, count)
            sums |= (sums << n * step) & mask
            count, step = count - step, step * 2
    return sums.bit_length() - 1


def reduction(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int]]:
    """Patterns ([(length, times)], number of sequences) fixed for good, and the histogram of what is left.

    From the longest item j down, with k the longest other item that fits beside it: {j} is fixed if
    nothing fits beside j, and {j, k} if no set of other items that fits beside j is longer than k.
    In any packing what lies beside j can then change places with k, so some best packing holds the
    fixed set (Martello and Toth's dominance). Taking items away makes no sum greater, so all copies
    of j meet k as long as there is one.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    for j in sorted(left, reverse=True):
        while j in left:
            room = capacity - j
            rest = {n: c - (n == j) for n, c in left.items() if n <= room and c > (n == j)}
            k = max(rest, default=0)
            if k < room and _fullest(rest, room) > k:
                break
            need = {j: 1} if not k else {j: 2} if j == k else {j: 1, k: 1}
            times = min(left[n] // t for n, t in need.items())
            patterns.append((sorted(need.items(), reverse=True), times))
            for n, t in need.items():
                left[n] -= t * times
                if not left[n]:
                    del left[n]
    return patterns, left


def reduce_and_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns that hold every item of the histogram once: the fixed ones, and best-fit decreasing of what is left."""
    patterns, left = reduction(histogram, capacity)
    return patterns + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on a histogram: all open sequences with the same contents are one group."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        for room in [r for r in sorted(open_) if r >= n]:
            groups, open_[room] = open_[room], []
            per = room // n
            while groups and count:
                items, times = groups.pop()
                full = min(times, count // per)
                if full:
                    open_[room - per * n].append(([*items, (n, per)], full))
                    count -= full * per
                if full < times and count:
                    open_[room - count * n].append(([*items, (n, count)], 1))
                    full, count = full + 1, 0
                if full < times:
                    groups.append((items, times - full))
            open_[room] += groups
        if count:
            per = capacity // n
            if count // per:
                open_[capacity - per * n].append(([(n, per)], count // per))
            if count % per:
                open_[capacity - count % per * n].append(([(n, count % per)], 1))
    return [g for groups in open_.values() for g in groups]


def _slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first sequence, times, place) sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for items, times in patterns:
        place = 0
        for n, t in items:
            rows.append((n, rank[n], sequence, t, place))
            rank[n] += t * times
            place += n * t
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "times", "place"), columns, strict=True))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length."""
    parts = cut(parts)
    # At most `capacity` rows reach the driver, whatever the input.
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    slots = _slots(reduce_and_fit(histogram, capacity))
    most = max(TASK_PIECES, sum(histogram.values()) // GROUPS)
    hot = [F.lit(x) for n, c in histogram.items() if c > most for x in (n, c // most + 1)]
    salts = F.coalesce(F.element_at(F.create_map(*hot), F.col("length")), F.lit(1)) if hot else F.lit(1)
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts).cast("int"))
    counts = parts.groupBy("length", "_salt").count()
    # One row per group of pieces.
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("count")
    ranked = parts.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ).join(F.broadcast(before), ["length", "_salt"])
    ranked = ranked.select(
        *[c for c in parts.columns if c != "_salt"], (F.col("_rank") + F.col("_before")).cast("long").alias("_rank")
    )
    names = [c for c in ranked.columns if c != "_rank"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = int(slots["rank"].max(initial=0)) + 1
        keys = slots["length"] * step + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(slots["length"], length)
            key = length * step + np.minimum(rank, step - 1)
            at = np.maximum(np.searchsorted(keys, key, side="right") - 1, at)
            past = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + past // slots["times"][at]
            offset = slots["place"][at] + past % slots["times"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(deal, f"{schema}, sequence_id long, offset long")
