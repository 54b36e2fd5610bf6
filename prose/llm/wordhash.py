"""Vectorised word splitting and hashing over whole Arrow batches.

All helpers work on one contiguous UTF-8 buffer holding many texts, so a batch of
documents costs a fixed number of numpy calls and no per-word Python objects.
Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Upper bound of text bytes handled in one numpy call; a longer single text is one slice.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        top = out[done - 1] * base
        out[done : done + step] = out[:step] * top
        done += step
    return out


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, size), _powers(self.inv, size)
        return self.up, self.down


_TABLES = {i: _PowerTable(b) for i, b in enumerate(_MULT)}


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every ``values[s:e]`` (length included), from one prefix sum."""
    with np.errstate(over="ignore"):
        up, down = _TABLES[seed].get(len(values) + 1)
        prefix = np.empty(len(values) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=prefix[1:])
        raw = (prefix[ends] - prefix[starts]) * down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * _MULT[1 - seed])


def fold(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of a slice of texts; ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``lower`` folds A-Z only."""
    if lower:
        data = fold(data)
    n = len(data)
    word = np.zeros(n + 1, dtype=bool)
    word[:n] = ~_SPACE[data]
    begin = word[:n].copy()
    begin[1:] &= ~word[: n - 1]
    finish = word[:n] & ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = word[inner]
    finish[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first, range_hash(data, starts, ends))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, bytes, offsets) of pieces of a string column of about SLICE_BYTES; null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        piece = offsets[row : stop + 1]
        yield row, stop, data[piece[0] : piece[-1]], piece - piece[0]
        row = stop


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles inside one text, and the position of each one's first word."""
    count = len(words.starts)
    at = np.arange(max(count - k + 1, 0))
    if len(at):
        doc = words.doc_of()
        at = at[doc[at] == doc[at + k - 1]]
    return range_hash(words.hashes, at, at + k, seed=1), at


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out
