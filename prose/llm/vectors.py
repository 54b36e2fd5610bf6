"""Links and groups of vectors of one label whose cosine reaches a threshold.

Cross-polytope hashing: a vector is turned by random signs and fast Hadamard transforms, three times,
and hashes to the axis it then lies nearest to. A table's key is several such axes; besides its own bucket, a
vector probes those next to it, in which one or two axes are replaced by the ones that follow. Two vectors meet in a table
if one lies in a bucket that the other lies in or probes. Every pair that meets is verified by its
cosine in double precision and counted in the first table in which it meets.

At cosine 0.93 in 64 dimensions a pair meets in one table with probability 0.7, so six tables lose one in 1400;
above 0.98 none in a million. More tables or probes are parameters.

Equal vectors are folded first. Shuffled are bucket numbers and keys; vectors follow only into buckets that hold
something to compare. A bucket of more than BUCKET members, such as a large group of near copies, elects a
leader: all vectors within half the threshold's angle of it link with each other, which is counted, not compared. The others of
such a bucket meet its members in blocks. No task holds more than two blocks, and a group of copies or near copies never
becomes a list of pairs.

Cases with a defined result: vectors that are null, empty, zero or hold null or infinite components, and rows without label or
vec_id, link with nothing and are their own component; vectors of different lengths do not link; rows that repeat a vector
link with each other, also under one vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .support import cut, discard
from .wordhash import mix64

THRESHOLD = 0.93
TABLES, AXES, PROBES, SEED = 6, 2, 3, 1
#: Members of a bucket that are compared in one block.
BUCKET = 2_000
#: Verified pairs whose tables are looked up at once.
_PAIRS = 1 << 16


class CrossPolytope:
    """Keys of vectors of one length: (vector, table, own bucket and probes)."""

    def __init__(self, length: int, tables: int, axes: int, probes: int, seed: int):
        self.length, self.width = length, max(4, 1 << (length - 1).bit_length())
        self.probes, self.axes = probes, axes
        self.signs = np.random.default_rng([seed, self.width]).choice(np.array([-1, 1], dtype=np.float32), size=(tables, axes, 3, self.width))

    def _turned(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Three rounds of signs and a Hadamard transform, by sums of halves. Element by element, so equal for any batch."""
        for sign in signs:
            x, half = x * sign, 1
            while half < self.width:
                pair = x.reshape(len(x), -1, 2, half)
                x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), self.width)
                half *= 2
            x = x * np.float32(1 / math.sqrt(self.width))
        return x

    def keys(self, unit: np.ndarray) -> np.ndarray:
        x = np.zeros((len(unit), self.width), dtype=np.float32)
        x[:, : self.length] = unit
        out = np.empty((len(x), len(self.signs), 1 + self.probes), dtype=np.int64)
        for t, table in enumerate(self.signs):
            code, loss = [], []
            for signs in table:
                turned = self._turned(x, signs)
                near = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :4]
                value = np.take_along_axis(turned, near, axis=1)
                code.append(2 * near + (value < 0))
                loss.append(np.abs(value[:, :1]) - np.abs(value))
            scale = (2 * self.width) ** np.arange(self.axes, dtype=np.int64)
            own = sum(c[:, 0] * s for c, s in zip(code, scale, strict=True))
            # What a probe changes in the key and how far it lies off: one axis replaced by one of its next three, or two by their next.
            change = [[(c[:, r] - c[:, 0]) * s for r in (1, 2, 3)] for c, s in zip(code, scale, strict=True)]
            moves = [(loss[k][:, r], change[k][r - 1]) for k in range(self.axes) for r in (1, 2, 3)]
            moves += [(loss[k][:, 1] + loss[j][:, 1], change[k][0] + change[j][0]) for k in range(self.axes) for j in range(k)]
            far, step = (np.stack(m, axis=1) for m in zip(*moves, strict=True))
            best = np.argsort(far, axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + np.take_along_axis(step, best, axis=1)
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by the greatest component first, so that nothing overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a column of vectors, for every length in it."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(flat[first[rows][:, None] + np.arange(size)])


def _met_first(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table in which i and j meet (-1: none), and whether each of the two probes the other's own bucket there."""
    first, both = np.empty(len(i), dtype=np.int64), np.empty(len(i), dtype=bool)
    for at in range(0, len(i), _PAIRS):
        a, b = keys[i[at : at + _PAIRS]], keys[j[at : at + _PAIRS]]
        by_a, by_b = (a == b[:, :, :1]).any(axis=2), (b == a[:, :, :1]).any(axis=2)
        meet = by_a | by_b
        t = meet.argmax(axis=1)
        row = np.arange(len(t))
        first[at : at + _PAIRS] = np.where(meet[row, t], t, -1)
        both[at : at + _PAIRS] = by_a[row, t] & by_b[row, t]
    return first, both


def _least(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least id that every row reaches by pairs (i, j)."""
    least = ids.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        if (least == before).all():
            return least


def _near(unit: np.ndarray, group: np.ndarray, two: np.ndarray, right: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one group, verified, of which one lies in its own bucket; where a group has two sides, pairs of different sides."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    small = sizes <= 32
    # All small groups at once: each row with the rows after it.
    rows = np.flatnonzero(np.repeat(small, sizes))
    after = np.repeat((starts + sizes)[small], sizes[small]) - rows - 1
    i = np.repeat(rows, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    keep = (own[i] | own[j]) & (~two[i] | (right[i] != right[j]))
    i, j = i[keep], j[keep]
    for at in range(0, len(i), _PAIRS):
        x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
        hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        yield x[hit], y[hit]
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        rows = np.arange(start, start + size)
        sides = (rows[~right[rows]], rows[right[rows]]) if two[start] else (rows, rows)
        for at in range(0, len(sides[0]), 256):
            x, y = sides[0][at : at + 256], sides[1]
            hit = (unit[x] @ unit[y].T >= threshold) & (own[x][:, None] | own[y])
            if not two[start]:
                hit &= x[:, None] < y
            a, b = np.nonzero(hit)
            yield x[a], y[b]


def _compare(batch: pa.RecordBatch, threshold: float, hasher) -> pa.RecordBatch:
    """Links of every row with others of its group that are counted here, and the least id it reaches by them."""
    col = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    ids, k1, k2, copies, own, right, table = (col(c) for c in ("id", "k1", "k2", "copies", "own", "right", "table"))
    ball = batch.column(batch.schema.get_field_index("ball")).fill_null(0).to_numpy(zero_copy_only=False)
    balled = batch.column(batch.schema.get_field_index("ball")).is_valid().to_numpy(zero_copy_only=False)
    label = np.unique(col("label").astype(str), return_inverse=True)[1]
    places = np.stack([col(c).astype(np.int64) for c in _GROUP], axis=1)
    group = np.cumsum(np.append(True, (places[1:] != places[:-1]).any(axis=1)))
    links, far = np.zeros(len(ids), dtype=np.int64), ids.copy()
    two = places[:, 1].astype(bool) | (places[:, 2] != places[:, 3])
    for rows, unit in _by_length(batch.column(batch.schema.get_field_index("embedding"))):
        keys, pairs = hasher(unit.shape[1]), [(np.empty(0, np.int64),) * 2]
        for i, j in _near(unit, group[rows], two[rows], right[rows], own[rows], threshold):
            a, b = rows[i], rows[j]
            apart = (label[a] == label[b]) & ~(balled[a] & balled[b] & (ball[a] == ball[b]))
            pairs.append((i[apart], j[apart]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if len(i):
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            x, y = at[: len(i)], at[len(i) :]
            first, both = _met_first(keys.keys(unit[used]), x, y)
            i, j = rows[i], rows[j]
            # Two that probe each other's own buckets meet in both; the bucket of the one with the lesser key counts.
            lesser = (k1[i] < k1[j]) | ((k1[i] == k1[j]) & (k2[i] < k2[j]))
            counted = (first == table[i]) & (~both | (own[i] & own[j]) | np.where(lesser, own[i], own[j]))
            i, j = i[counted], j[counted]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            far = _least(far, i, j)
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(x[hit], pa.int64()) for x in (ids, k1, k2, links, far)], ["id", "k1", "k2", "links", "far"])


_GROUP = ["bucket", "mixed", "a", "b"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut between groups; a group is bounded by two blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in _GROUP], axis=1)
        last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held:
            # Rows that go on with the group held, unless the batch begins another.
            one = np.array([int(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py()) for c in _GROUP])
            if last == 0 and (keys[0] == one).all():
                held.append(batch)
                continue
        if last or held:
            whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            yield from whole
        held = [batch.slice(last)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: components, all of them finite numbers, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, axes: int = AXES, probes: int = PROBES, seed: int = SEED, bucket: int = BUCKET
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    The key space of a table is (2 x length) ^ axes for each label; choose ``axes`` so that vectors of a label by that are few.
    """
    hashers: dict[int, CrossPolytope] = {}

    def hasher(length: int) -> CrossPolytope:
        if length not in hashers:
            hashers[length] = CrossPolytope(length, tables, axes, probes, seed)
        return hashers[length]

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))
    # 128 bits stand for a label and a vector.
    keyed = named.withColumns({f"k{k}": F.when(usable, F.xxhash64(F.lit(k), "label", "embedding")) for k in (1, 2)})
    folded = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = cut(folded)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in _by_length(batch.column(3)):
                keys = hasher(unit.shape[1]).keys(unit)
                kind = batch.column(2).to_numpy()[rows].astype(np.uint64)
                with np.errstate(over="ignore"):
                    where = mix64(mix64(kind + np.uint64(unit.shape[1]))[:, None, None] + (np.arange(tables, dtype=np.uint64) << np.uint64(56))[None, :, None] + keys.astype(np.uint64))
                each = tables * (1 + probes)
                known = [pa.array(np.repeat(batch.column(c).to_numpy()[rows], each)) for c in range(2)]
                table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(rows))
                own = np.tile(np.arange(1 + probes) == 0, len(rows) * tables)
                yield pa.RecordBatch.from_arrays([pa.array(where.reshape(-1).astype(np.int64)), pa.array(table), *known, pa.array(own)], ["bucket", "table", "k1", "k2", "own"])

    hashed = distinct.select("k1", "k2", F.xxhash64("label").alias("kind"), "embedding").mapInArrow(places, "bucket long, table int, k1 long, k2 long, own boolean")
    met = hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("home")).filter("n > 1 and home").drop("home")
    placed = cut(hashed.join(met, "bucket"))

    # Full buckets: who lies within half the angle of a leader links with all others that do. Leaders are four members taken at
    # random: those least by their key among a quarter of the bucket.
    full = placed.filter(F.col("n") > bucket).select("bucket", "k1", "k2")
    some = F.array_compact(F.array(*(F.min(F.when(F.pmod("k2", F.lit(4)) == k, F.struct("k1", "k2"))) for k in range(4))))
    leading = full.groupBy("bucket").agg(some.alias("leaders"))
    asked = full.join(leading, "bucket").select("k1", "k2", F.explode("leaders").alias("leader")).distinct()
    centers = asked.select("leader").distinct().select("leader", F.col("leader.k1").alias("k1"), F.col("leader.k2").alias("k2"))
    centers = centers.join(distinct.select("k1", "k2", F.col("id").alias("center_id"), F.col("label").alias("of"), F.col("embedding").alias("center")), ["k1", "k2"]).drop("k1", "k2")
    near = asked.join(distinct.select("k1", "k2", "id", "copies", "label", "embedding"), ["k1", "k2"]).join(centers, "leader")
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    close = (F.col("label") == F.col("of")) & (F.size("embedding") == F.size("center"))
    near = near.filter(close & (_cosine(F.col("embedding"), F.col("center")) >= half))
    balls = cut(near.groupBy("id", "k1", "k2", "copies").agg(F.min(F.struct("leader.*", "center_id")).alias("leader")))

    # Blocks of a full bucket: members of its greatest ball ("inner") need not meet each other.
    rows = placed.join(balls.select("k1", "k2", F.col("leader.k1").alias("ball")), ["k1", "k2"], "left")
    greatest = rows.filter((F.col("n") > bucket) & F.col("ball").isNotNull()).groupBy("bucket", "ball").count()
    greatest = greatest.groupBy("bucket").agg(F.max_by("ball", F.struct("count", "ball")).alias("main"))
    rows = rows.join(greatest, "bucket", "left").withColumn("inner", F.coalesce(F.col("ball") == F.col("main"), F.lit(False)))
    blocks = lambda cond: F.ceil(F.count_if(cond) / bucket).cast("int")
    sizes = rows.filter(F.col("n") > bucket).groupBy("bucket").agg(blocks(F.col("inner")).alias("ins"), blocks(~F.col("inner")).alias("outs"))
    rows = rows.join(sizes, "bucket", "left").na.fill({"ins": 0, "outs": 1})
    block = F.pmod(F.xxhash64("k2"), F.greatest(F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs")), F.lit(1))).cast("int")
    at = lambda mixed, a, b, right: F.struct(F.lit(mixed).alias("mixed"), a.alias("a"), b.alias("b"), right.alias("right"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("block")
    with_ins = F.transform(count("ins"), lambda i: at(True, i, mine, F.lit(True)))
    with_outs = F.transform(count("outs"), lambda j: at(False, F.least(j, mine), F.greatest(j, mine), mine > j))
    met_by_inner = F.transform(count("outs"), lambda j: at(True, mine, j, F.lit(False)))
    dealt = rows.withColumn("block", block).withColumn("g", F.explode(F.when(F.col("inner"), met_by_inner).otherwise(F.concat(with_ins, with_outs))))
    dealt = dealt.select("bucket", "g.*", "table", "k1", "k2", "own", "ball")
    joined = dealt.join(distinct.select("k1", "k2", "id", "copies", "label", "embedding"), ["k1", "k2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            yield _compare(batch, threshold, hasher)

    grouped = joined.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = cut(grouped.mapInArrow(compare, "id long, k1 long, k2 long, links long, far long"))

    edges = found.select(F.col("id").alias("a"), F.col("far").alias("b")).unionByName(balls.select(F.col("id").alias("a"), F.col("leader.center_id").alias("b"))).filter("a <> b")
    labels = components(edges)
    weight = balls.groupBy("leader").agg(F.sum("copies").alias("weight"))
    inside = balls.join(weight, "leader").select("k1", "k2", (F.col("weight") - F.col("copies")).alias("inside"))
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    told = distinct.select("k1", "k2", "id", "copies").join(links, ["k1", "k2"], "left").join(inside, ["k1", "k2"], "left").join(labels, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = cut(told.select("k1", "k2", (F.col("copies") - 1 + zero("links") + zero("inside")).alias("n_links"), F.coalesce("label", "id").alias("component_id")))
    for part in (distinct, placed, balls, found):
        discard(part)
    out = keyed.select("vec_id", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
