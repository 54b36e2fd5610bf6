"""Hierarchical Pitman-Yor language model, trained and applied as Spark jobs.

Restaurants: one for every token that was seen before another one (and one for the start of a text), all
sharing one parent, whose own parent is uniform over the vocabulary and one unknown word. The dishes are
the tokens that follow. Nothing is cut: every pair of neighbours that the training texts hold is an entry
(w, u, c), the customers of dish w in restaurant u, so what is learned grows with the input.

Seating is sampled by Gibbs sweeps of the Chinese-restaurant process. The state of an entry is its number of
tables. A sweep takes all customers of an entry out of their restaurant and seats them anew, jointly, given all
other entries as the sweep before left them: t tables have odds S(c, t) * a * (a + d P) ... (a + (t-1) d P), with
S the generalised Stirling numbers of the discount d, P the parent's probability of the dish and a = (strength + d *
tables of the other dishes) * P. Drawing t from this is exact up to ``EXACT`` customers; above, t - 1 is all but a
Poisson number, whose mean the saddle point of S gives. Tables are the parent's customers, which are seated in
the same way. Entries of one customer have one table. Random numbers are hashes of (w, u, sweep), so a task
that runs again draws the same.

Predictive probabilities are averaged over the last two sweeps. Discounts are estimated from the
entries with one and two customers.

How it is spread: tokens are coded, the ``LOCAL_WORDS`` most frequent ones by their rank, all others by a 64-bit
hash. What restaurants and dishes of ranked tokens know is two arrays of bounded size, handed to the tasks;
entries with any other token ask the buckets of tokens for theirs. Scoring looks the ``LOCAL_PAIRS`` most frequent
pairs up in the scan; all other pairs of the texts meet the model's in one shuffle by bucket of pairs, so neither a
frequent word nor a frequent context is a hot key. What is shuffled and written is not a row for each pair: a row
is a bucket's part of what a task has found, as sorted, delta-coded and compressed columns; the number of
buckets follows the number of tokens, so a bucket holds about ``BUCKET`` of them, whatever the input.

Cases with a defined result: null or empty text is one end token; a very long text is scored whole; a null doc_id
counts as held out; repeated rows are scored one by one and counted one by one in training; tokens of equal count
are ranked by hash; with no training rows every token is unknown; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut, discard
from .wordhash import mix64, split_words, text_slices

#: Sweeps in all; the last two are averaged.
SWEEPS, KEPT = 3, 2
STRENGTH = 1.0
#: Most customers of an entry for which the number of tables is drawn from its whole distribution.
EXACT = 512
LOCAL_WORDS = 500_000
LOCAL_PAIRS = 3_000_000
#: Tokens that are counted at once, rows that are merged at once, and numbers that one draw holds at once.
COUNTED_TOKENS, DRAWN = 2_000_000, 400_000
#: Tokens of a bucket of pairs and words of a bucket of tokens, on average; ranked tokens of one row of totals.
BUCKET, CHUNK = 1_000_000, 1 << 15
END = np.uint64(1)
#: Code of the start of a text as a context; ranked tokens follow, hashed ones are negative.
START = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HASHED = np.uint64(1 << 63)


def crc_remainder(doc_id) -> "F.Column":
    """crc32 of doc_id as text, modulo 10."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def token_stream(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, offsets) of slices of a text column; every text ends with END."""
    for row, stop, data, offsets in text_slices(column):
        words = split_words(data, offsets, lower=True)
        hashes = np.where(words.hashes == END, np.uint64(2), words.hashes)
        yield row, np.insert(hashes, words.first[1:], END), words.first + np.arange(stop - row + 1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first by differences, as compressed byte planes; read back by _unpack."""
    n, parts = len(columns[0]), []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x)
        if not k:
            x = np.diff(x.view(np.uint64), prepend=np.uint64(0))
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(n, x.itemsize).T).ravel() if n else np.empty(0, np.uint8))
    planes = np.concatenate(parts)
    return np.array([n, len(planes)], dtype=np.int64).tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if n else b"")


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    """The columns of _pack; their types are int64 where not given otherwise, the first is always."""
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    planes = np.frombuffer(pa.decompress(memoryview(data)[16:], size, codec="zstd"), np.uint8) if n else np.empty(0, np.uint8)
    out, at = [], 0
    for k, kind in enumerate(types):
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind)
        out.append(np.cumsum(x.view(np.uint64)).view(np.int64) if not k else x)
        at += n * width
    return out


_INT, _REAL, _SCORE = np.int64, np.float64, np.float32
#: Rows of a shuffle: where they go, in which order they are read there, and packed columns.
_ROW = "bucket long, part long, data binary"


def _rows(*rows: tuple[int, int, bytes]) -> pa.RecordBatch:
    bucket, part, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(part, pa.int64()), pa.array(data, pa.binary())], ["bucket", "part", "data"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Of rows sorted by bucket, each bucket and its (part, data)."""
    for bucket, rows in groupby(_read(batches), key=lambda r: r[0]):
        yield bucket, (r[1:] for r in rows)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, by part."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "part")


def _summed(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their values."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = _starts(*keys)
    return (*(k[first] for k in keys), *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def _merged(rows: Iterator[bytes], keys: int, columns: int) -> tuple[np.ndarray, ...]:
    """_summed over the rows of a bucket, some millions at once: what is held follows the number of different keys."""
    held, n, most = [], 0, COUNTED_TOKENS

    def folded() -> tuple[np.ndarray, ...]:
        own = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return _summed(tuple(own[:keys]), *own[keys:])

    for data in rows:
        held.append(_unpack(data, *[_INT] * columns))
        n += len(held[-1][0])
        if n >= most:
            held.append(folded())
            n = len(held[0][0])
            most = max(COUNTED_TOKENS, 2 * n)
    return folded()


def _token_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(keys.view(np.uint64)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _cut_up(bucket: np.ndarray, part: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; the columns keep their order."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        first = [*_starts(bucket).tolist(), len(bucket)]
        yield _rows(*[(int(bucket[i]), part, _pack(*[c[i:j] for c in columns])) for i, j in zip(first, first[1:], strict=False)])


def _grouped(slices: Iterator[tuple]) -> Iterator[tuple]:
    """The arrays of (tokens, array, ...) of slices, joined to groups of COUNTED_TOKENS or a little more."""
    held, n = [], 0

    def joined() -> tuple:
        out = tuple(pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return out

    for tokens, *arrays in slices:
        held.append(arrays)
        n += tokens
        if n >= COUNTED_TOKENS:
            yield joined()
            n = 0
    if n:
        yield joined()


def unigrams(train: DataFrame) -> DataFrame:
    """Buckets of (w, c): count of every training token. Counted per task, then shuffled; ``part`` is the bucket's number of tokens."""
    buckets = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tokens,) in _grouped((len(tokens), tokens) for batch in batches for _, tokens, _ in token_stream(batch.column(0))):
            w, c = np.unique(tokens, return_counts=True)
            yield from _cut_up(_token_bucket(w, buckets), 0, w.view(np.int64), c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            w, c = _merged((data for _, data in rows), 1, 2)
            yield _rows((bucket, int(c.sum()), _pack(w, c)))

    return _dealt(train.select("text").mapInArrow(run, _ROW)).mapInArrow(add, _ROW)


def _unrolled(rows: DataFrame, names: str, change=lambda *x: x, types=None) -> DataFrame:
    """The packed columns of rows as columns of a DataFrame."""
    names = names.split()
    types = types or [_INT] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in change(*_unpack(data, *types))], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the LOCAL_WORDS most frequent tokens; of equal counts, the least hashes."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _read(batches):
            c, n = np.unique(np.minimum(_unpack(data, _INT, _INT)[1], 1 << 16), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["c", "n"])

    limit, left = 1, LOCAL_WORDS
    for r in sorted(counts.mapInArrow(sizes, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.c):
        limit, left = r.c, left - r.n
        if left <= 0:
            break

    def frequent(w, c):
        keep = c >= limit
        return w[keep], c[keep]

    top = _unrolled(counts, "w c", frequent).orderBy(F.desc("c"), "w").limit(LOCAL_WORDS).toArrow()
    return top.column("w").to_numpy(), top.column("c").to_numpy()


@dataclass
class Codes:
    """The ranked tokens: their hashes in sorted order, and the code of each."""

    hashes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Codes:
        order = np.argsort(hashes)
        return cls(hashes[order], order.astype(np.int64) + 1)

    def encode(self, tokens: np.ndarray) -> np.ndarray:
        other = (tokens | _HASHED).view(np.int64)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.ranks[at], other)


def _pairs_of(tokens: np.ndarray, offsets: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(w, u): codes of every token and of the one before it."""
    w = codes.encode(tokens)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[offsets[:-1]] = START
    return w, u


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _shared(df: DataFrame, value) -> Broadcast:
    """Hands a value of bounded size to the tasks once, whatever the number of functions that use it."""
    return df.sparkSession.sparkContext.broadcast(value)


#: Bits that the key of a ranked pair leaves for the number of a text in its slice.
_ROOM = 24
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass
class Pairs:
    """Keys of pairs: one number of ``bits`` bits for a pair of ranked tokens, a one-to-one mixture of u * width + w, so
    that buckets are ranges of it and alike in size; (w, u) for others. ``buckets`` of pairs, ``words`` of hashed tokens."""

    width: int
    buckets: int
    words: int

    @property
    def bits(self) -> int:
        return max((self.width**2).bit_length(), 8)

    def mixed(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64((self.bits + 1) // 2)
        with np.errstate(over="ignore"):
            x = ((u * self.width + w).view(np.uint64) * np.uint64(_FIRST)) & mask
            x ^= x >> half
            return ((x * np.uint64(_SECOND)) & mask).view(np.int64)

    def unmixed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64((self.bits + 1) // 2)
        with np.errstate(over="ignore"):
            x = (key.view(np.uint64) * np.uint64(pow(_SECOND, -1, 1 << 64))) & mask
            x ^= x >> half
            x = (x * np.uint64(pow(_FIRST, -1, 1 << 64))) & mask
        return (x % np.uint64(self.width)).view(np.int64), (x // np.uint64(self.width)).view(np.int64)

    def ranges(self, keys: np.ndarray) -> list[int]:
        """Where the buckets begin in sorted keys of ranked pairs."""
        edges = [(k << self.bits) // self.buckets for k in range(self.buckets)]
        return [*np.searchsorted(keys, np.array(edges, dtype=np.int64)).tolist(), len(keys)]

    def bucket(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Of pairs with a hashed token."""
        return _token_bucket(_keys(w, u, 0).view(np.int64), self.buckets)


def entries(train: DataFrame, codes: Broadcast, pairs: Pairs) -> DataFrame:
    """Two rows a bucket: (key, c) of ranked pairs (part 0), (w, u, c) of others (part 1). Counted per task, added up per bucket."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, tokens, offsets in token_stream(batch.column(0)):
                w, u = _pairs_of(tokens, offsets, codes.value)
                ranked = (w >= 0) & (u >= 0)
                yield len(w), pairs.mixed(w[ranked], u[ranked]), w[~ranked], u[~ranked]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, w, u in _grouped(slices(batches)):
            key.sort()
            first = _starts(key)
            c = np.diff(np.append(first, len(key)))
            key = key[first]
            at = pairs.ranges(key)
            if len(key):
                yield _rows(*[(k, 0, _pack(key[i:j], c[i:j])) for k, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j])
            w, u, c = _summed((w, u), np.ones(len(w), dtype=np.int64))
            yield from _cut_up(pairs.bucket(w, u), 1, w, u, c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            for part, own in groupby(rows, key=lambda r: r[0]):
                yield _rows((bucket, part, _pack(*_merged((data for _, data in own), 1 + part, 2 + part))))

    return _dealt(train.select("text").mapInArrow(count, _ROW)).mapInArrow(add, _ROW)


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix64(keys + np.uint64(step + 1) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(maxsize=4)
def _log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers for c, t <= size; S(c, t) = S(c-1, t-1) + (c-1 - d t) S(c-1, t)."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, size + 1)
    for c in range(2, size + 1):
        more = np.full(size, -np.inf)
        more[: c - 1] = out[c - 1, 1:c] + np.log(c - 1 - discount * t[: c - 1])
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], more)
    return out


def _poisson(keys: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers from hashed uniforms: inverse transform, or the normal limit for large means."""
    u = _uniform(keys, 0)
    out = np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(keys, 1)))
    small = np.flatnonzero(mean <= 50)
    k, mass = np.zeros(len(small)), np.exp(-mean[small])
    total, live = mass.copy(), np.arange(len(small))
    while len(live := live[u[small[live]] > total[live]]):
        k[live] += 1
        mass[live] *= mean[small[live]] / k[live]
        total[live] += mass[live]
        live = live[mass[live] > 1e-300]
    out[small] = k
    return np.maximum(out, 0)


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, keys: np.ndarray) -> np.ndarray:
    """Tables of entries, drawn given the parent's probability of the dish and the tables of the restaurant's other dishes."""
    tables = np.minimum(customers, 1)
    weight = (strength + discount * others) * parent
    rise = discount * parent
    log_s = _log_stirling(discount)
    u = _uniform(keys, 2)
    exact = np.flatnonzero((customers > 1) & (customers <= EXACT))
    exact = exact[np.argsort(customers[exact], kind="stable")]
    edges = [*_starts(customers[exact]).tolist(), len(exact)] if len(exact) else []
    for a, b in zip(edges, edges[1:], strict=False):
        c = int(customers[exact[a]])
        step = max(1, DRAWN // c)
        for k in range(a, b, step):
            at = exact[k : min(k + step, b)]
            odds = log_s[c, 1 : c + 1] + np.cumsum(np.log(weight[at, None] + rise[at, None] * np.arange(c)), axis=1)
            odds = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
            tables[at] = np.minimum((odds < u[at, None] * odds[:, -1:]).sum(axis=1), c - 1) + 1
    large = np.flatnonzero(customers > EXACT)
    if len(large):
        c, w = customers[large].astype(np.float64), weight[large] / np.maximum(1 - parent[large], 0.1)
        empty = np.minimum((w / c) ** (1 / (1 - discount)), 1 - 1e-9)
        mean = w * (1 - empty**discount) / discount
        tables[large] = np.minimum(1 + _poisson(keys[large], mean), customers[large]).astype(tables.dtype)
    return tables


def _keys(w: np.ndarray, u: np.ndarray | int, sweep: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(w.view(np.uint64) ^ mix64(np.asarray(u, dtype=np.int64).view(np.uint64) * _STEP + np.uint64(sweep + 3)))


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate of a discount, kept within (0, 1) where counts are few."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


@dataclass
class State:
    """What a sweep left: tables of ranked contexts, the parent's probability of ranked words, and all totals.

    ``blocks`` has buckets of hashed tokens with FACTS: of the token as a context customers (cn) and tables (cm), as a word
    training count (wn), customers in the parent (wm) and tables there (wr); cg, wg and wq are cm, wm and wr of the sweep before.
    """

    blocks: DataFrame | None
    context: np.ndarray
    tables: np.ndarray
    customers: np.ndarray
    seated: np.ndarray
    root_customers: int
    root_tables: int

    @property
    def rows(self) -> DataFrame:
        """(kind, key, n, m, g, r, q): the hashed tokens as contexts (kind 0) and as words (kind 1)."""

        def kinds(key, cn, cm, cg, wn, wm, wg, wr, wq):
            a, b, none = np.flatnonzero(cn), np.flatnonzero(wn), np.zeros_like(key)
            both = lambda x, y: np.concatenate([x[a], y[b]])
            return both(none, none + 1), both(key, key), both(cn, wn), both(cm, wm), both(cg, wg), both(none, wr), both(none, wq)

        return _unrolled(self.blocks, "kind key n m g r q", kinds, [_INT] * len(FACTS))


FACTS = ("key", "cn", "cm", "cg", "wn", "wm", "wg", "wr", "wq")


@dataclass
class Model:
    """Totals of the training texts, the codes of ranked tokens, and the states of the kept sweeps."""

    tokens: int
    words: int
    codes: Codes
    discount: float = 0.5
    root_discount: float = 0.5
    strength: float = STRENGTH
    states: list[State] = field(default_factory=list)
    counts: np.ndarray | None = None
    pairs: Pairs | None = None

    @property
    def share(self) -> float:
        return self.tokens + 0.1 * (self.words + 1)

    @property
    def totals(self) -> list[State]:
        """The kept states' totals alone, for tasks."""
        return [State(None, *(np.empty(0),) * 4, s.root_customers, s.root_tables) for s in self.states]

    def slim(self) -> Model:
        """The numbers alone, for tasks."""
        return Model(self.tokens, self.words, Codes(np.empty(0, np.uint64), np.empty(0, np.int64)), self.discount, self.root_discount, self.strength)

    def parent(self, customers, tables, state: State):
        """The parent's probability of words with so many customers and tables there; numpy or columns."""
        low = self.strength + state.root_customers
        back = (self.strength + self.root_discount * state.root_tables) / low / (self.words + 1)
        return (customers - self.root_discount * tables) / low + back

    def back(self, customers, tables):
        """Weight of the parent in contexts with so many customers and tables."""
        return (self.strength + self.discount * tables) / (self.strength + customers)

    def unseen(self) -> np.ndarray:
        """The parent's probability of an unknown word, by kept sweep."""
        return np.array([self.parent(0.0, 0.0, s) for s in self.states])

    @cached_property
    def local(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of ranked tokens: back-off weights as contexts and probabilities as words, by kept sweep, training counts, and customers as contexts."""
        backs = np.stack([self.back(s.context, s.tables) for s in self.states], axis=1)
        parents = np.stack([np.maximum(self.parent(s.customers, s.seated, s), 1e-300) for s in self.states], axis=1)
        return backs.astype(np.float32), parents, self.counts, self.states[-1].context


def _own(pairs: Pairs, part: int, data: bytes, more: int = 1) -> list[np.ndarray]:
    """w, u, c and what else a row of entries holds; part 0: ranked pairs."""
    if part == 0:
        key, *rest = _unpack(data, *[_INT] * (1 + more))
        return [*pairs.unmixed(key), *rest]
    return _unpack(data, *[_INT] * (2 + more))


def _lone(pairs: Pairs, part: int, data: bytes) -> list[np.ndarray]:
    """w, u, c, t and t before of the entries of one customer."""
    w, u, c = _own(pairs, part, data)
    one = c == 1
    return [w[one], u[one], *[c[one]] * 3]


def _several(pairs: Pairs, part: int, data: bytes) -> list[np.ndarray]:
    """w, u, c, t and t before of seated entries."""
    return _own(pairs, part, data, 3)


def _changed(rows: DataFrame, change) -> DataFrame:
    """Rows with other columns: change(part, data) gives them, or nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, part, data in _read(batches):
            columns = change(part, data)
            if len(columns[0]):
                yield _rows((bucket, part, _pack(*columns)))

    return rows.mapInArrow(run, _ROW)


def _seated(data: bytes, part: int) -> list[np.ndarray]:
    """Columns of entries of several customers. First seating: the square root of the customers, so that the first sweep meets a plausible state."""
    *keys, c = _unpack(data, *[_INT] * (2 + part))
    many = c > 1
    tables = np.ceil(np.sqrt(c[many])).astype(np.int64)
    return [*(k[many] for k in keys), c[many], tables, tables]


def _totals(rows: DataFrame, pairs: Pairs, take) -> DataFrame:
    """By token, sums of customers, tables and tables before as a context and as a word, over entries that ``take`` reads.

    Ranked tokens are summed in an array per task, others per some millions of rows. Buckets below 0 hold ranked tokens.
    """
    size = pairs.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, held, n = np.zeros((6, size)), [], 0

        def hashed() -> Iterator[pa.RecordBatch]:
            keys, *sums = _summed((np.concatenate([x[0] for x in held]),), *[np.concatenate([x[k] for x in held]) for k in range(1, 7)])
            yield from _cut_up(_token_bucket(keys, pairs.words), 0, keys, *sums)

        for _, part, data in _read(batches):
            w, u, *values = take(pairs, part, data)
            for kind, key in ((0, u), (3, w)):
                ranked = slice(None) if part == 0 else key >= 0
                for k, x in enumerate(values):
                    dense[kind + k] += np.bincount(key[ranked], weights=x[ranked], minlength=size)
                if part:
                    rest = key < 0
                    none = [np.zeros(rest.sum(), dtype=np.int64)] * 3
                    own = [x[rest] for x in values]
                    held.append([key[rest], *(own if kind == 0 else none), *(none if kind == 0 else own)])
                    n += len(none[0])
            if n >= COUNTED_TOKENS:
                yield from hashed()
                held, n = [], 0
        if n:
            yield from hashed()
        for k in range(0, size, CHUNK):
            part = dense[:, k : k + CHUNK].astype(np.int64)
            some = np.flatnonzero(part.any(axis=0))
            if len(some):
                yield _rows((-1 - k // CHUNK, 0, _pack(some + k, *part[:, some])))

    return rows.mapInArrow(run, _ROW)


def _added(totals: DataFrame, change=lambda *x: x) -> DataFrame:
    """One row of sums for each bucket of totals; ``change`` adds columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            yield _rows((bucket, -1, _pack(*change(*_merged((data for _, data in rows), 1, 7)))))

    return _dealt(totals).mapInArrow(run, _ROW)


def _sums(rows: DataFrame, columns: int, value, names: str) -> list[int]:
    """Sums over all rows of the numbers that ``value`` makes of a row's columns."""
    names = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in value(*_unpack(data, *[_INT] * columns))], names)

    return list(rows.mapInArrow(run, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first())


def _state(model: Model, totals: DataFrame, sweep: int, before: int, earlier: int) -> State:
    """Seats the parent's customers, given its tables before (``earlier``: those before the sweep before), and reads the ranked rows off."""
    opening, discount, strength = 1.0 / (model.words + 1), model.root_discount, model.strength

    def seated(key, cn, cm, cg, wn, wm, wg):
        out = [key, cn, cm, cg, wn, wm, wg]
        for customers, others, of in ((wm, before, sweep), (wg, earlier, sweep - 1)):
            out.append(seat(customers, np.full(len(key), opening), np.full(len(key), float(others)), discount, strength, _keys(key, -1, of)))
        return out

    rows = cut(_added(totals, seated))
    sums = _sums(rows, len(FACTS), lambda *x: (x[5].sum(), x[7].sum()), "m r")
    # Ranked tokens alone: LOCAL_WORDS + 1 of them at most.
    arrays = np.zeros((4, len(model.codes.hashes) + 1))
    for data in rows.filter("bucket < 0").select("data").toArrow().column("data"):
        key, *x = _unpack(data.as_py(), *[_INT] * len(FACTS))
        for k, of in enumerate((0, 1, 4, 6)):
            arrays[k, key] = x[of]
    hashed = rows.filter("bucket >= 0")
    hashed.cut_path = rows.cut_path
    return State(hashed, *arrays, *sums)


class Facts:
    """What the hashed tokens of a block know; tokens that are unknown have zeros."""

    def __init__(self, answers: list[bytes]):
        parts = [_unpack(data, *[_INT] * len(FACTS)) for data in answers]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(FACTS)
        order = np.argsort(columns[0])
        self.keys = columns[0][order]
        self.columns = {n: np.append(x[order], 0).astype(np.float64) for n, x in zip(FACTS[1:], columns[1:], strict=True)}

    def of(self, tokens: np.ndarray):
        """A function from a fact and an array by code to values of the tokens."""
        at = np.searchsorted(self.keys, tokens)
        at = np.where(np.append(self.keys, 0)[at] == tokens, at, len(self.keys))
        hashed, code = tokens < 0, np.maximum(tokens, 0)
        return lambda name, ranked: np.where(hashed, self.columns[name][at], ranked[code])


def _asked(blocks: DataFrame, state: State, words: int) -> DataFrame:
    """Blocks of pairs with hashed tokens (w, u first), each after rows (part -1) of its tokens' facts.

    A block asks every bucket of tokens that it needs once; answers go to the block.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, n_data in _read(batches):
            w, u = _unpack_two(n_data)
            keys = np.unique(np.concatenate([w[w < 0], u[u < 0]]))
            yield from _cut_up(_token_bucket(keys, words), block, keys)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            known = None
            for block, data in rows:
                if block < 0:
                    known = _unpack(data, *[_INT] * len(FACTS))
                elif known is not None:
                    (keys,) = _unpack(data, _INT)
                    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
                    at = at[known[0][at] == keys]
                    yield _rows((block, -1, _pack(*[x[at] for x in known])))

    return _dealt(_dealt(blocks.mapInArrow(ask, _ROW).unionByName(state.blocks)).mapInArrow(answer, _ROW).unionByName(blocks))


def _with_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, Facts]]:
    """Rows of blocks that have asked, and the facts that came."""
    for bucket, rows in _by_bucket(batches):
        answers = []
        for part, data in rows:
            if part < 0:
                answers.append(data)
            else:
                yield bucket, part, data, Facts(answers)


def _unpack_two(data: bytes) -> list[np.ndarray]:
    return _unpack(data, _INT, _INT)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, Facts]]:
    """Rows of ranked pairs, which ask for nothing."""
    none = Facts([])
    for row in _read(batches):
        yield *row, none


def _both(rows: DataFrame, state: State, pairs: Pairs, run, kind: str = _ROW) -> DataFrame:
    """run over rows with their tokens' facts: of ranked pairs (part 0) as they are, of others after asking."""
    ranked = rows.filter("part = 0").mapInArrow(lambda batches: run(_without(batches)), kind)
    return ranked.unionByName(_asked(rows.filter("part = 1"), state, pairs.words).mapInArrow(lambda batches: run(_with_facts(batches)), kind))


def _sweep(model: Model, multi: DataFrame, state: State, shared: Broadcast, sweep: int) -> DataFrame:
    """Entries with several customers (c, t, t before), seated anew given the state, whose arrays are ``shared``."""
    discount, strength, light, pairs = model.discount, model.strength, model.slim(), model.pairs

    def run(rows) -> Iterator[pa.RecordBatch]:
        slim: State = shared.value
        for bucket, part, data, facts in rows:
            w, u, c, t, _ = _several(pairs, part, data)
            keys = _unpack(data, *[_INT] * (4 + part))[: 1 + part]
            context, word = facts.of(u), facts.of(w)
            tables, customers, seated = context("cm", slim.tables), word("wm", slim.customers), word("wr", slim.seated)
            # The entry's own tables are no customers of the parent while it is seated anew.
            left = np.maximum(customers - t, 0)
            share = np.divide(left, customers, out=np.zeros_like(left), where=customers > 0)
            parent = np.maximum(light.parent(left, np.minimum(seated, np.ceil(seated * share)), slim), 1e-300)
            new = seat(c, parent, np.maximum(tables - t, 0), discount, strength, _keys(w, u, sweep))
            yield _rows((bucket, part, _pack(*keys, c, new, t)))

    return _both(multi, state, pairs, run)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (w, u, c, t0, t1, ...) of its entries: tables after every kept sweep."""
    counts = cut(unigrams(docs))
    n, v = _sums(counts, 2, lambda w, c: (c.sum(), len(w)), "n v")
    top, frequency = _most_frequent(counts)
    codes = Codes.of(top.view(np.uint64))
    # Ranks go by place in the sorted hashes' order of frequency: code k is the k-th most frequent token.
    size = len(codes.hashes) + 1
    pairs = Pairs(size, max(1, -(-n // BUCKET)), max(1, -(-(v - size) // BUCKET)))
    ranked_counts = np.zeros(size)
    ranked_counts[1:] = frequency
    discard(counts)
    shared = _shared(docs, codes)
    found = cut(entries(docs, shared, pairs))
    shared.destroy()
    by_size = _by_size(found)
    ones, twos = (sum(x for (_, c), x in by_size.items() if c == k) for k in (1, 2))
    model = Model(n, v, codes, discount_of(ones, twos), counts=ranked_counts, pairs=pairs)
    single = cut(_added(_totals(found, pairs, _lone)).withColumn("part", F.lit(0).cast("long")))
    multi = cut(_changed(found, lambda part, data: _seated(data, part)))

    def totals(rows: DataFrame) -> DataFrame:
        return single.unionByName(_totals(rows, pairs, _several))

    first = cut(_added(totals(multi)))
    m1, m2 = _sums(first, 7, lambda *x: ((x[5] == 1).sum(), (x[5] == 2).sum()), "ones twos")
    model.root_discount = discount_of(m1, m2)
    before = earlier = v
    state = _state(model, first, -1, before, earlier)
    discard(first)
    for sweep in range(SWEEPS):
        shared = _shared(docs, State(None, *(x.astype(np.float32) for x in (state.context, state.tables, state.customers, state.seated)), state.root_customers, state.root_tables))
        seated = cut(_sweep(model, multi, state, shared, sweep))
        shared.destroy()
        before, earlier = state.root_tables, before
        after = _state(model, totals(seated), sweep, before, earlier)
        discard(multi)
        discard(state.blocks)
        multi, state = seated, after
        model.states = [*model.states, state][-KEPT:]
    discard(single)

    def shown(take):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array(x) for x in (w, u, c, h, t)], ["w", "u", "c", "t0", "t1"]) for _, part, data in _read(batches) for w, u, c, t, h in (take(pairs, part, data),))

    kind = "w long, u long, c long, t0 long, t1 long"
    table = found.mapInArrow(shown(_lone), kind).unionByName(multi.mapInArrow(shown(_several), kind))
    table.cuts, table.by_size = [found, multi], by_size
    return model, table


def _by_size(found: DataFrame) -> dict[tuple[int, int], int]:
    """Number of entries by part and count, counts above 3 rounded down to a power of 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, data in _read(batches):
            c = _unpack(data, *[_INT] * (2 + part))[-1]
            c, n = np.unique(np.where(c <= 3, c, 1 << np.floor(np.log2(c)).astype(np.int64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part)), pa.array(c), pa.array(n)], ["part", "c", "n"])

    return {(r.part, r.c): r.n for r in found.mapInArrow(run, "part long, c long, n long").groupBy("part", "c").agg(F.sum("n").alias("n")).collect()}


def _mean(light: Model, totals: list[State], local, w, u, c, tables, facts: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of words, and the averaged probabilities of pairs; c and tables are 0 where the model lacks the pair."""
    backs, parents, counts, contexts = local
    context, word, ranked = facts.of(u), facts.of(w), not len(w) or min(w.min(), u.min()) >= 0
    size, mean = context("cn", contexts), np.zeros(len(w))
    for k, s in enumerate(totals):
        back, parent = backs[np.maximum(u, 0), k], parents[np.maximum(w, 0), k]
        if not ranked:
            back = np.where(u < 0, light.back(size, context(("cg", "cm")[k], contexts)), back)
            parent = np.where(w < 0, light.parent(word(("wg", "wm")[k], counts), word(("wq", "wr")[k], counts), s), parent)
        mean += (np.maximum(c - light.discount * tables[k], 0) / (light.strength + size) + back * parent) / len(totals)
    return word("wn", counts), mean


def predictive(model: Model, table: DataFrame) -> DataFrame:
    """(w, u, c, cw, p): log10 of the averaged probability of every entry, and the training count of its word."""
    shared, pairs, light, totals = _shared(table, model.local), model.pairs, model.slim(), model.totals

    def of(take):
        def run(rows) -> Iterator[pa.RecordBatch]:
            for _, part, data, facts in rows:
                w, u, c, t, h = take(pairs, part, data)
                cw, mean = _mean(light, totals, shared.value, w, u, c, (h, t), facts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, u, c, cw.astype(np.int64), np.log10(mean).astype(np.float32))], ["w", "u", "c", "cw", "p"])

        return run

    kind = "w long, u long, c long, cw long, p float"
    found, multi = table.cuts
    return _both(found, model.states[-1], pairs, of(_lone), kind).unionByName(_both(multi, model.states[-1], pairs, of(_several), kind))


def _local_limit(by_size: dict[tuple[int, int], int]) -> int:
    """Least count of the ranked pairs that are looked up in the scan: LOCAL_PAIRS at most."""
    left, limit = LOCAL_PAIRS, 62
    ranked = {}
    for (part, c), n in by_size.items():
        if part == 0:
            ranked[c.bit_length() - 1] = ranked.get(c.bit_length() - 1, 0) + n
    for b in sorted(ranked, reverse=True):
        left -= ranked[b]
        if left < 0:
            break
        limit = b
    return 1 << limit


def _local_pairs(model: Model, table: DataFrame, facts: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the most frequent ranked pairs, in order, and log10 of their probabilities."""
    limit, pairs, light, totals = _local_limit(table.by_size), model.pairs, model.slim(), model.totals

    def of(take):
        def columns(part, data):
            w, u, c, t, h = take(pairs, part, data)
            keep = c >= limit
            w, u, c, t, h = (x[keep] for x in (w, u, c, t, h))
            return pairs.mixed(w, u), np.log10(_mean(light, totals, facts.value, w, u, c, (h, t), Facts([]))[1]).astype(_SCORE)

        return columns

    found, multi = (x.filter("part = 0") for x in table.cuts)
    rows = _changed(multi, of(_several))
    if limit == 1:
        rows = rows.unionByName(_changed(found, of(_lone)))
    parts = [_unpack(x.as_py(), _INT, _SCORE) for x in rows.select("data").toArrow().column("data")]
    keys, values = (np.concatenate([np.empty(0, kind), *(x[k] for x in parts)]) for k, kind in enumerate((_INT, _SCORE)))
    order = np.argsort(keys)
    return keys[order], values[order]


#: Parts of a bucket of pairs while texts meet the model; those of texts are 2 * (first row of their group), and one more for hashed pairs.
_OWN, _FOUND, _MULTI = -10, -4, -2
#: Columns of a group of texts' own numbers, and of sums of some of its texts.
_OWN_TYPES = (_INT, _INT, _INT, _INT, _INT, _REAL, _REAL)
_SUM_TYPES = (_INT, _INT, _REAL, _SCORE)


def _scanned(docs: DataFrame, model: Model, shared: Broadcast) -> DataFrame:
    """Of every group of texts their own numbers and sums over local pairs, and the other pairs for their buckets.

    Counts and base scores of ranked words are known here; for hashed ones they come with the tokens' facts.
    """
    pairs, share = model.pairs, model.share
    room = _ROOM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, keys, values = shared.value
        worth = np.log10((counts + 0.1) / share)

        def slices() -> Iterator[tuple]:
            """Sums of every text of a slice, and its pairs that are not local; texts of different slices share no pair."""
            for batch in batches:
                ids, doc_id, held = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, tokens, offsets in token_stream(batch.column(3)):
                    size = np.diff(offsets)
                    texts, end = len(size), at + len(size)
                    w, u = _pairs_of(tokens, offsets, codes)
                    of = np.repeat(np.arange(texts), size)
                    ranked = w >= 0
                    known = np.bincount(of[ranked], minlength=texts)
                    base = np.bincount(of[ranked], weights=worth[w[ranked]], minlength=texts)
                    ranked &= u >= 0
                    both = np.sort((pairs.mixed(w[ranked], u[ranked]) << room) | of[ranked])
                    first = _starts(both)
                    n = np.diff(np.append(first, len(both))).astype(np.int32)
                    key, text = both[first] >> room, both[first] & ((1 << room) - 1)
                    score = np.zeros(texts)
                    if len(keys) and len(key):
                        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        hit = keys[place] == key
                        score = np.bincount(text[hit], weights=n[hit] * values[place[hit]].astype(np.float64), minlength=texts)
                        key, text, n = key[~hit], text[~hit], n[~hit]
                    other = np.flatnonzero(~ranked)
                    x, y, of, many = _summed((w[other], u[other], of[other]), np.ones(len(other), dtype=np.int32))
                    yield len(w), ids[at:end], doc_id[at:end], held[at:end], size, known, base, score, key, ids[at] + text, n, x, y, ids[at] + of, many

        for ids, doc_id, held, size, known, base, score, key, text, n, x, y, of, many in _grouped(slices()):
            first = int(ids[0])
            order = np.argsort(key, kind="stable")
            key, text, n = key[order], (text[order] - first).astype(np.int32), n[order]
            at = pairs.ranges(key)
            if len(key):
                yield _rows(*[(k, 2 * first, _pack(key[i:j], text[i:j], n[i:j])) for k, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j])
            order = np.lexsort((y, x))
            x, y, of, many = x[order], y[order], (of[order] - first).astype(np.int32), many[order]
            yield from _cut_up(pairs.bucket(x, y), 2 * first + 1, x, y, of, many)
            missing = np.asarray(doc_id.is_null()).astype(np.int64)
            own = _pack(doc_id.fill_null(0).to_numpy(), missing, held, size, known.astype(np.int64), base, score)
            yield _rows((first % pairs.buckets, _OWN, np.int64(first).tobytes() + own))

    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_remainder(F.col("doc_id")) == 0).alias("held_out"),
        "text",
    )
    return source.mapInArrow(run, _ROW)


def _met(parts: DataFrame, model: Model, facts: Broadcast) -> DataFrame:
    """By group of texts, their own numbers (part 0) and sums over ranked pairs (part 1); and, by bucket, their pairs with
    hashed tokens and what the model's entries have for them (part 2): w, u, group, text, n, c, tables after both sweeps."""
    pairs, light, totals = model.pairs, model.slim(), model.totals
    none, most = Facts([]), BUCKET

    def looked_up(block: int, asked: list, own: list) -> pa.RecordBatch:
        asked = [np.concatenate(x) for x in zip(*asked, strict=True)]
        w, u, c, t, h = (np.concatenate(x) for x in zip(*own, strict=True)) if own else [np.empty(0, np.int64)] * 5
        # The model's pair, if there is one, comes before those of the texts.
        first = np.concatenate([np.zeros(len(w), dtype=bool), np.ones(len(asked[0]), dtype=bool)])
        x, y = np.concatenate([w, asked[0]]), np.concatenate([u, asked[1]])
        order = np.lexsort((first, y, x))
        x, y, first = x[order], y[order], first[order]
        at = np.flatnonzero(first)
        place = np.maximum.accumulate(np.where(first, -1, np.arange(len(x))))[at]
        hit = (place >= 0) & (x[place] == x[at]) & (y[place] == y[at])
        entry = np.where(hit, order[place], len(w))
        request = order[at] - len(w)
        return _rows((block, 2, _pack(x[at], y[at], *[v[request] for v in asked[2:]], *[np.append(v, 0)[entry] for v in (c, h, t)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            own: list[list[list[np.ndarray]]] = [[], []]
            asked, n_asked, blocks, keys, values = [], 0, 0, None, None
            for part, data in rows:
                if part == _OWN:
                    yield _rows((int(np.frombuffer(data, np.int64, 1)[0]), 0, data[8:]))
                elif part < 0:
                    take, kind = (_lone, part - _FOUND) if part < _MULTI else (_several, part - _MULTI)
                    own[kind].append(take(pairs, kind, data))
                elif part % 2:
                    w, u, text, n = _unpack(data, _INT, _INT, np.int32, np.int32)
                    asked.append([w, u, np.full(len(w), part // 2), text.astype(np.int64), n.astype(np.int64)])
                    n_asked += len(w)
                    if n_asked >= most:
                        yield looked_up(bucket + blocks * pairs.buckets, asked, own[1])
                        asked, n_asked, blocks = [], 0, blocks + 1
                else:
                    if keys is None:
                        w, u, c, t, h = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*own[0], strict=True) if own[0] else [[]] * 5))
                        keys = pairs.mixed(w, u)
                        order = np.argsort(keys, kind="stable")
                        values = np.log10(_mean(light, totals, facts.value, w, u, c, (h, t), none)[1])[order]
                        keys = keys[order]
                    key, text, n = _unpack(data, _INT, np.int32, np.int32)
                    at = np.searchsorted(keys, key)
                    hit = np.append(keys, -1)[at] == key
                    x = np.append(values, 0.0)[np.where(hit, at, len(keys))]
                    miss = np.flatnonzero(~hit)
                    if len(miss):
                        w, u = pairs.unmixed(key[miss])
                        zero = np.zeros(len(miss))
                        x[miss] = np.log10(_mean(light, totals, facts.value, w, u, zero, (zero, zero), none)[1])
                    some = np.flatnonzero(np.bincount(text))
                    yield _rows((part // 2, 1, _pack(some, np.bincount(text, weights=n * x)[some].astype(_SCORE))))
            if asked:
                yield looked_up(bucket + blocks * pairs.buckets, asked, own[1])

    return _dealt(parts).mapInArrow(run, _ROW)


def _resolved(asked: DataFrame, model: Model, facts: Broadcast) -> DataFrame:
    """By group of texts, sums over pairs with hashed tokens (part 2): tokens known, base score, score."""
    pairs, light, totals, share = model.pairs, model.slim(), model.totals, model.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data, answers in _with_facts(batches):
            w, u, group, text, n, c, h, t = _unpack(data, *[_INT] * 8)
            cw, mean = _mean(light, totals, facts.value, w, u, c, (h, t), answers)
            hashed = w < 0
            sums = [n * (hashed & (cw > 0)), np.where(hashed, n * np.log10((cw + 0.1) / share), 0.0), n * np.log10(mean)]
            group, text, known, base, score = _summed((group, text), *sums)
            edges = [*_starts(group).tolist(), len(group)]
            for i, j in zip(edges, edges[1:], strict=False):
                yield _rows((int(group[i]), 2, _pack(text[i:j], known[i:j], base[i:j], score[i:j].astype(_SCORE))))

    return _asked(asked, model.states[-1], pairs.words).mapInArrow(run, _ROW)


def _gathered(parts: DataFrame) -> DataFrame:
    """One row for each text: its own numbers and all sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            for part, data in rows:
                if part == 0:
                    doc_id, missing, held, size, *sums = _unpack(data, *_OWN_TYPES)
                    known, base, score = (x.copy() for x in sums)
                elif part == 1:
                    text, x = _unpack(data, _INT, _SCORE)
                    score[text] += x
                else:
                    text, *more = _unpack(data, *_SUM_TYPES)
                    for out, x in zip((known, base, score), more, strict=True):
                        out[text] += x
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=missing > 0), pa.array(held > 0), pa.array(size), pa.array(known), pa.array(base), pa.array(score)], names)

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [x.split()[0] for x in kind.split(", ")]
    return _dealt(parts).mapInArrow(run, kind)


def score(docs: DataFrame, model: Model, table: DataFrame, spent: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; ``spent``: the table is not needed again."""
    facts = _shared(docs, model.local)
    shared = _shared(docs, (model.codes, model.counts, *_local_pairs(model, table, facts)))
    found, multi = (x.withColumn("part", F.col("part") + k) for x, k in zip(table.cuts, (_FOUND, _MULTI), strict=True))
    merged = cut(_met(_scanned(docs, model, shared).unionByName(found).unionByName(multi), model, facts))
    shared.destroy()
    for done in table.cuts if spent else ():
        discard(done)
    sums = merged.filter("part < 2").unionByName(_resolved(merged.filter("part = 2"), model, facts))
    return _gathered(sums).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Trains on the rows whose crc remainder is not 0 and scores all rows."""
    model, table = train(docs.filter(crc_remainder(F.col("doc_id")) != 0))
    return score(docs, model, table, spent=True)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of held-out and training texts by the model and by the base score."""
    value = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(value("score").alias("perplexity"), value("base_score").alias("base_perplexity"))
