"""Fill-in-the-middle transformation: texts cut at two unit ends and rearranged.

A unit is a word with the white space before it, or white space that ends the text. Unit ends are
found eight bytes at a time: the UTF-8 of a batch is viewed as 64-bit words, arithmetic marks the top
bit of every byte that ends a unit, a bit count per word and its running sum give ranks, and the
byte of the k-th end is a search in that sum followed by a select inside one word.

Which texts are rearranged, where they are cut and in which order the parts stand depends on the
seed and doc_id alone, so a task that runs again writes the same text.

Cases with a defined result: null and empty texts are plain with no units; texts that hold a marker
are plain; a null doc_id is hashed as an empty one; a cut may fall before the first or after the
last unit, so any part may be empty; a very long text is one slice of its own; repeated rows are transformed alike; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import text_slices

#: The markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80

_U = np.uint64
_EACH = _U(0x0101010101010101)
_TOP = _EACH * _U(0x80)
_LOW = ~_TOP


def _spaces(x: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is \\x20 or from \\x09 to \\x0D; no carry crosses a byte."""
    low = x & _LOW
    blank = ((low ^ (_EACH * _U(0x20))) + _LOW) & _TOP ^ _TOP
    control = (low + _EACH * _U(0x80 - 0x09)) & ~(low + _EACH * _U(0x80 - 0x0E))
    return (blank | control) & ~x & _TOP


class Marks:
    """Marked bytes of 64-bit words, with ranks and selects by a running sum of their bit counts."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte position."""
        word, byte = at >> 3, at & 7
        inside = np.append(self.marks, _U(0))[word] & ((_U(1) << (byte.astype(_U) << _U(3))) - _U(1))
        return self.sums[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, k from 1: search the running sum, then clear lower marks of the word."""
        word = np.searchsorted(self.sums, k, side="left") - 1
        rest, left = self.marks[word], k - self.sums[word] - 1
        for step in range(7):
            rest = np.where(left > step, rest & (rest - _U(1)), rest)
        return (word << 3) + (np.bitwise_count((rest & (~rest + _U(1))) - _U(1)) >> 3)


def _words(data: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(data) // 8) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8").astype(_U, copy=False)


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> Marks:
    """The last byte of every unit of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    space = _spaces(_words(data))
    after = space >> _U(8)
    after[:-1] |= space[1:] << _U(56)
    marks = ~space & _TOP & after
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    np.bitwise_or.at(marks, last >> 3, _U(0x80) << ((last & 7).astype(_U) << _U(3)))
    return Marks(marks)


def continuations(data: np.ndarray) -> Marks:
    """Bytes that do not begin a code point."""
    x = _words(data)
    return Marks(x & ~(x << _U(1)) & _TOP)


def _draws(seed: int, doc_id) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def _transform(ids: list, data: np.ndarray, offsets: np.ndarray, seed: int, rate: int, spm_rate: int):
    raw, ends, inner = data.tobytes(), unit_ends(data, offsets), continuations(data)
    first = ends.rank(offsets)
    n, draws = np.diff(first), [_draws(seed, i) for i in ids]
    h = np.array(draws, dtype=np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(offsets[:-1, None], 2, axis=1)
    row, col = np.nonzero(cuts)
    at[row, col] = ends.select(first[row] + cuts[row, col]) + 1
    chars = lambda a, b: (b - a) - (inner.rank(b) - inner.rank(a))
    prefix_chars, middle_chars = chars(offsets[:-1], at[:, 0]), chars(at[:, 0], at[:, 1])
    markers, forms, outputs = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)], [], []
    for k, (_, _, h3, h4) in enumerate(draws):
        start, a, b, stop = int(offsets[k]), int(at[k, 0]), int(at[k, 1]), int(offsets[k + 1])
        text = raw[start:stop]
        if not text or h3 % 100 >= rate or any(m in text for m in markers):
            form, out = "plain", text
        else:
            prefix, suffix, middle = (m + raw[i:j] for m, i, j in zip(markers, (start, b, a), (a, stop, b), strict=True))
            form, out = ("spm", suffix + prefix + middle) if h4 % 100 < spm_rate else ("psm", prefix + suffix + middle)
        forms.append(form)
        outputs.append(out)
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).view(pa.string())]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; nothing is shuffled.

    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those with the suffix first.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, stop, data, offsets in text_slices(batch.column(1)):
                part = ids[row:stop]
                yield pa.RecordBatch.from_arrays([part, *_transform(part.to_pylist(), data, offsets, seed, rate, spm_rate)], names)

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. No part holds a marker, so the markers cut it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "spm", F.concat(part(2), part(3), part(1))).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(output)
