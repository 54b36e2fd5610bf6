"""Periodic runs of words: stretches that repeat with a period and cannot be extended.

Grouping as in the first phase of a linear suffix sorter gives the longest Lyndon word at every place,
once for the order of the words and once for its reverse. Every run holds such a word of its period's length for one of
the two orders (its Lyndon root); so each word found is extended to both sides as far as it goes on
with its length as period, and what reaches two periods is a run. Extensions are longest common extensions over exact names
of all blocks of 1, 2, 4, ... words.

A run of at least m words has more than half of them equal to those one period later, so all
its words lie in groups of ceil(m / 2) words that stand twice in the text. Stretches without such
groups are left out first; a run never crosses the border of a stretch.

Cases with a defined result: null, empty and blank texts have no runs and an empty collapsed text; a text may be one run as a
whole; runs of different periods may overlap and are all told; repeated rows are told alike; a very long text is one slice of its own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import words_of
from .wordhash import Words, gram_hashes, mix64, split_words, text_slices

MIN_WORDS = 12
#: Words of stretches searched at once; a longer stretch is searched alone.
BLOCK_WORDS = 1 << 16


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place, the end counting as least symbol.

    Places are grouped by a common prefix, at first their symbol. Groups are finished from the greatest
    down: each of its places extends the nearest unfinished place of a lesser group before it, and places that
    are extended equally often split off as a group just above their old one. A finished group's prefix is the Lyndon word.
    """
    alphabet = sorted(set(symbols))
    name = {s: g for g, s in enumerate(alphabet)}
    of = [name[s] for s in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(of):
        members[g].append(i)
    n, size = len(symbols), [1] * len(alphabet)
    below, above = list(range(-1, len(alphabet) - 1)), list(range(1, len(alphabet) + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out, g = [0] * n, len(alphabet) - 1
    while g >= 0:
        length, extended, last, times = size[g], [], -1, 0
        for i in members[g]:
            if of[i] != g:
                continue
            # Finished places leave the list, so the place before is lesser, or of this group and then left already.
            p, q = left[i], right[i]
            if p >= 0:
                right[p] = q
            if q < n:
                left[q] = p
            out[i] = length
            if p == last:
                times += 1
            else:
                if last >= 0:
                    extended.append((times, last))
                last, times = p, 1
        if last >= 0:
            extended.append((times, last))
        if len(extended) > 1:
            extended.sort(key=lambda e: -e[0])
        fresh, had = {}, 0
        for times, p in extended:
            if times != had:
                fresh, had = {}, times
            old = of[p]
            new = fresh.get(old)
            if new is None:
                new = fresh[old] = len(size)
                size.append(size[old] + times * length)
                members.append([])
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new  # a group that is being finished is above every unfinished one
            members[new].append(p)
            of[p] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions of a sequence of ids, by exact names of all blocks of 1, 2, 4, ... up to ``longest`` ids."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.names = [ids]
        while 2 << (len(self.names) - 1) <= longest:
            half, width = self.names[-1], 1 << (len(self.names) - 1)
            pair = half[:-width].astype(np.int64) * (int(half.max()) + 1) + half[width:]
            self.names.append(np.unique(pair, return_inverse=True)[1])

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ids that agree from i and j on; i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(j + done + (1 << k) <= len(self.names[0]))
            a, b = i[fits] + done[fits], j[fits] + done[fits]
            done[fits] += (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
        return done

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ids that agree up to those before i and j; i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(i - done - (1 << k) >= 0)
            a, b = i[fits] - done[fits] - (1 << k), j[fits] - done[fits] - (1 << k)
            done[fits] += (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
        return done


def runs(stretches: list[np.ndarray], least: int) -> np.ndarray:
    """(stretch, start, length, period) of all runs of ``least`` ids or more in sequences of small ids, by stretch, start and period."""
    parts, breaks = [], len(stretches)
    for k, ids in enumerate(stretches):
        # Each stretch ends with a symbol of its own, less than all words and than those before, so no Lyndon word or extension passes it.
        parts += [ids + breaks, [breaks - 1 - k]]
    joined = np.concatenate(parts).astype(np.int64)
    of = np.repeat(np.arange(breaks), [len(s) + 1 for s in stretches])
    begin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in stretches])])[:-1]
    common, words = Extensions(joined, max(len(s) for s in stretches)), np.flatnonzero(joined >= breaks)
    found = []
    for turned in (False, True):
        order = np.where(joined >= breaks, joined.max() + breaks - joined, joined) if turned else joined
        period = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)[words]
        back = common.before(words, words + period)
        length = back + period + common.after(words, words + period)
        good = length >= np.maximum(least, 2 * period)
        found.append(np.stack([words[good] - back[good], length[good], period[good]], axis=1))
    start, length, period = np.unique(np.concatenate(found), axis=0).T
    out = np.stack([of[start], start - begin[of[start]], length, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def stretches(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and words after the last of stretches of ``least`` words or more that may hold runs, none across texts.

    Equal hashes of different groups only make a stretch longer.
    """
    width = -(-least // 2)
    hashes, at = gram_hashes(words, width)
    doc = words.doc_of()
    keys = hashes ^ mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + width, -1)
    inside = np.cumsum(step)[:-1] > 0
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.append(True, doc[1:] != doc[:-1])
    first = np.flatnonzero(inside & (fresh | ~np.append(False, inside[:-1])))
    stop = np.flatnonzero(inside & (np.append(fresh[1:], True) | ~np.append(inside[1:], False))) + 1
    long = stop - first >= least
    return first[long], stop[long]


def _slice_runs(words: Words, raw: bytes, least: int) -> np.ndarray:
    """(first word of the slice, length, period) of the runs of all texts of a slice, by first word and period."""
    found, block, size = [], [], 0

    def search():
        names: dict[bytes, int] = {}
        ids = [np.fromiter((names.setdefault(raw[s:e], len(names)) for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)), np.int64, b - a) for a, b in block]
        out = runs(ids, least)
        found.append(np.stack([out[:, 1] + np.array([a for a, _ in block])[out[:, 0]], out[:, 2], out[:, 3]], axis=1))

    for a, b in zip(*(x.tolist() for x in stretches(words, least)), strict=True):
        if block and size + b - a > BLOCK_WORDS:
            search()
            block, size = [], 0
        block.append((a, b))
        size += b - a
    if block:
        search()
    return np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)


def _collapsed(words: Words, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    doc = words.doc_of()[kept]
    starts, ends = words.starts[kept], words.ends[kept]
    more = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, dtype=bool)
    # The byte after a word with another one to follow is white space of the same text.
    data = words.data.copy()
    data[ends[more]] = 0x20
    step = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, ends + more, -1)
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, runs, collapsed) of every row; nothing is shuffled.

    ``runs`` holds (start, length, period) in words, by start and period; ``collapsed`` is the text without those words
    that any run holds after its first period, the others joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets)
                start, length, period = _slice_runs(words, data.tobytes(), least).T
                step = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(step, start + period, 1)
                np.add.at(step, start + length, -1)
                kept = np.cumsum(step)[:-1] == 0
                doc = words.doc_of()[start]
                order = np.lexsort((period, start, doc))
                values = [pa.array(x[order]) for x in (start - words.first[doc], length, period)]
                rows = pa.StructArray.from_arrays(values, fields=list(_RUN))
                many = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=stop - row))]).astype(np.int32)
                told = pa.ListArray.from_arrays(pa.array(many), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], told, _collapsed(words, kept, offsets)], ["doc_id", "runs", "collapsed"])

    kind = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (then of least start and period) and checksums of ``periodic_runs``."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.floor(F.col("_b.length") * 1000 / -F.col("_b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def planted(docs: DataFrame, of: int = 10) -> DataFrame:
    """One of ``of`` texts, by the checksum of doc_id, with its words from a place on replaced by repetitions of the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / of), words_of(F.col("text"))
    rows = docs.withColumn("_w", F.when((h % of == 0) & (F.size(w) > 0), w)).withColumn("_n", F.when(F.col("_w").isNotNull(), F.size("_w"))).withColumn("_a", g % F.col("_n"))
    rest = F.col("_n") - F.col("_a")
    p: Column = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a").cast("int") + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest.cast("int"))
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_w", "_n", "_a")
