import hashlib
import random
import zlib

import numpy as np
import pytest

from prose.llm import periods

from .conftest import words


def brute_lyndon(s):
    """By definition: the longest prefix of each suffix that is less than all its own proper suffixes."""
    less = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(k for k in range(1, len(s) - i + 1) if less(s[i : i + k])) for i in range(len(s))]


def brute_runs(w, least=12):
    """Every period in turn: maximal stretches whose words equal those one period later, of no smaller period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and not any((i, j + q - i) == k and q % p == 0 for k, p in found.items()):
                found[(i, j + q - i)] = q
            i = j
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q))


def brute_row(doc_id, text, plant=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and h % 10 == 0 and w:
        n, a = len(w), g % len(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found, gone = brute_runs(w), set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_lyndon_lengths_of_all_short_and_of_random_words():
    rng = random.Random(1)
    cases = [[(k // 3**i) % 3 for i in range(7)] for k in range(3**7)]
    cases += [[rng.randrange(s) for _ in range(rng.randint(1, 60))] for s in (1, 2, 3, 9) for _ in range(60)]
    for s in cases:
        assert periods.lyndon_lengths(s) == brute_lyndon(s), s


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))]
            parts.append(w * rng.randint(1, 5) + w[: rng.randint(0, len(w))])
        many = [np.array(p, dtype=np.int64) for p in parts]
        want = [(k, *r) for k, p in enumerate(parts) for r in brute_runs(p, least)]
        assert [tuple(r) for r in periods.runs(many, least).tolist()] == want


def test_query_equals_brute_force(spark, make_docs, corpus):
    rng = random.Random(2)
    texts = dict(corpus)
    for k in range(200, 320):
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices("abc", k=rng.randint(1, 8))
            at = rng.randint(0, len(w))
            w[at:at] = unit * rng.randint(2, 6)
        texts[k] = rng.choice([" ", "\n", " \t "]).join(w)
    # Copied far apart, a square exactly, one word short of the least length, one run as a whole.
    block = [f"x{k}" for k in range(30)]
    texts |= {400: " ".join(block + ["m"] + block), 401: " ".join(block * 2), 402: "z " * 11, 403: "z " * 12, 404: "é b " * 3_000}
    out = periods.digest(periods.periodic_runs(periods.planted(make_docs(texts))))
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {i: brute_row(i, t) for i, t in texts.items()}
    assert sum(r[1] > 0 for r in got.values()) > 40


def test_planted_texts_are_runs(make_docs):
    texts = {i: " ".join(f"w{k}" for k in range(60 + i)) for i in range(200)}
    got = {r[0]: tuple(r) for r in periods.digest(periods.periodic_runs(periods.planted(make_docs(texts)))).collect()}
    assert got == {i: brute_row(i, t) for i, t in texts.items()}
    assert sum(r[1] == 1 for r in got.values()) >= 8


def test_edges(make_docs, spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "same words " * 40, 5: " ".join(f"w{k}x{k % 13}" for k in range(30_000)), 6: "y" * 60_000}
    plain = sorted(map(str, periods.periodic_runs(make_docs(texts)).collect()))
    assert sorted(map(str, periods.periodic_runs(make_docs(texts, extra=True)).collect())) == plain
    rows = periods.periodic_runs(make_docs({4: texts[4]}).unionByName(make_docs({4: texts[4]}))).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].collapsed == "same words"
    assert periods.periodic_runs(make_docs([])).count() == 0
    alone = periods.digest(periods.periodic_runs(periods.planted(spark.createDataFrame([(None, "a b " * 9)], "doc_id long, text string")))).first()
    assert (alone.n_runs, alone.period, alone.exponent_milli) == (1, 2, 9000)
