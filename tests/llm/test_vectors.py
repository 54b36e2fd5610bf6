import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prose.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """All pairs in double precision, and components by repeated minima."""
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(np.array(v, dtype=np.float32), dtype=np.float64)
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                near[a, b] = near[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    least = {k: rows[k][0] for k in range(n)}
    while True:
        new = {k: min([least[k], *(least[j] for j in np.flatnonzero(near[k]))]) if k in good else least[k] for k in range(n)}
        if new == least:
            break
        least = new
    return sorted(((i, int(near[k].sum()), least[k], i is not None and i == least[k]) for k, (i, _, _) in enumerate(rows)), key=str)


def told(spark, rows, **how):
    return sorted((tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def cluster(rng, size, spread, dim=64):
    center = rng.normal(size=dim)
    center /= np.linalg.norm(center)
    out = []
    for _ in range(size):
        v = center + spread * rng.normal(size=dim) / np.sqrt(dim)
        out.append((rng.uniform(0.1, 9) * v).tolist())
    return out


def test_groups_of_all_kinds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [v for size, spread in ((1, 0), (40, 0.1), (25, 0.2), (30, 0.25), (60, 0.02), (9, 0.3)) for v in cluster(rng, size, spread)]
    vecs += [rng.normal(size=64).tolist() for _ in range(100)] + [vecs[5]] * 7 + [[-x for x in vecs[5]]]
    rows = [(k * 7 % 1009, v, int(k) % 2 if k > 200 else 1) for k, v in enumerate(vecs)]
    assert told(spark, rows) == brute(rows)


@pytest.mark.parametrize("bucket", [3, 20, 64])
def test_full_buckets_count_balls_and_meet_in_blocks(spark, bucket):
    rng = np.random.default_rng(bucket)
    vecs = cluster(rng, 90, 0.05) + cluster(rng, 50, 0.24) + [v for _ in range(4) for v in cluster(rng, 8, 0.1)]
    # A second group at an angle at which only some of the pairs link.
    turned = np.array(vecs[0]) / np.linalg.norm(vecs[0]) + 0.36 * rng.normal(size=64) / 8
    vecs += [(turned + 0.05 * rng.normal(size=64) / 8).tolist() for _ in range(40)] + [vecs[3]] * 5
    rows = [(k, v, 4) for k, v in enumerate(vecs)]
    random.Random(1).shuffle(rows)
    assert told(spark, rows, bucket=bucket, tables=8, probes=5) == brute(rows)


def test_edges(spark):
    v, w = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(1, v, 0), (2, w, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 2.0], 0),
            (9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (11, [1.0, 2.0], 0), (12, v, 0), (12, v, 0), (None, v, 0), (13, [5.0], 0), (14, [2.5], 0), (15, [3e38] * 3, 0), (16, [1e-44] * 3, 0)]
    assert told(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("id", "k1", "bucket", "label_", "ball", "copies", "component_id", "n_links")})
    assert sorted((tuple(r) for r in vectors.near_duplicates(more).collect()), key=str) == brute(rows)
    assert vectors.near_duplicates(df.filter("vec_id < 0")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just above it: at least 0.995 are found, none below it."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3_000):
        x, z = rng.normal(size=64), rng.normal(size=64)
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        c = 0.931 if k % 3 else 0.929
        rows += [(2 * k, x.tolist(), k % 2), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist(), k % 2)]
    linked = {r[0] for r in told(spark, rows) if r[1]}
    assert all((i // 2) % 3 for i in linked)
    assert len(linked) >= 0.995 * 4_000


def test_transforms_keep_lengths_and_keys_do_not_depend_on_the_batch():
    x = np.random.default_rng(1).normal(size=(50, 48)).astype(np.float32)
    h = vectors.CrossPolytope(48, 3, 2, 3, 1)
    padded = np.zeros((50, 64), dtype=np.float32)
    padded[:, :48] = x
    assert np.allclose(np.linalg.norm(h._turned(padded, h.signs[0, 0]), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    keys = h.keys(x)
    assert (np.concatenate([h.keys(x[k : k + 1]) for k in range(50)]) == keys).all()
    assert all(len(set(row)) == 4 for row in keys.reshape(-1, 4).tolist())
