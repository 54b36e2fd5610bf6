import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prose.llm import pitman_yor as py

from .conftest import FOLD, words


def tokens(text):
    return [*words((text or "").translate(FOLD)), None]


def test_base_columns_and_both_look_ups_agree(make_docs, corpus, monkeypatch):
    df = make_docs(corpus, extra=True)
    got = {r.doc_id: r for r in py.score_held_out(df).collect()}
    train = Counter(t for i, x in corpus.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    for i, x in corpus.items():
        r, own = got[i], tokens(x)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(train[t] > 0 for t in own))
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
    monkeypatch.setattr(py, "LOCAL_PAIRS", 100)
    joined = {r.doc_id: r for r in py.score_held_out(df).collect()}
    for i in corpus:
        assert joined[i].score == pytest.approx(got[i].score, rel=1e-5) and joined[i].n_known == got[i].n_known


def facts(model):
    """Per kept sweep: context -> (customers, tables) and word -> (count, customers, tables), as codes."""
    out = []
    hashed = model.states[-1].rows.collect()
    for k, state in enumerate(model.states):
        contexts = {r.key: (r.n, (r.g, r.m)[k]) for r in hashed if r.kind == 0}
        words_ = {r.key: (r.n, (r.g, r.m)[k], (r.q, r.r)[k]) for r in hashed if r.kind == 1}
        contexts |= {i: (n, t) for i, (n, t) in enumerate(zip(state.context, state.tables, strict=True)) if n}
        words_ |= {i: (model.counts[i], m, r) for i, (m, r) in enumerate(zip(state.customers, state.seated, strict=True)) if i and m}
        out.append((contexts, words_))
    return out


@pytest.mark.parametrize("local", [200_000, 20])
def test_probabilities_sum_to_one_and_totals_agree(make_docs, corpus, monkeypatch, local):
    monkeypatch.setattr(py, "LOCAL_WORDS", local)
    model, table = py.train(make_docs(corpus))
    rows = table.collect()
    pairs = Counter((t, u) for x in corpus.values() for u, t in zip(["start", *tokens(x)], tokens(x), strict=False))
    assert sorted(r.c for r in rows) == sorted(pairs.values())
    assert all(1 <= r[f"t{k}"] <= r.c for r in rows for k in range(py.KEPT))
    mean = Counter()
    for k, (contexts, words_) in enumerate(facts(model)):
        state = model.states[k]
        assert state.root_customers == sum(r[f"t{k}"] for r in rows) == sum(m for _, m in contexts.values())
        assert sum(r for _, _, r in words_.values()) == state.root_tables
        assert all(1 <= r <= m for _, m, r in words_.values())
        parent = {w: model.parent(m, r, state) for w, (_, m, r) in words_.items()}
        assert sum(parent.values()) + model.unseen()[k] == pytest.approx(1)
        total = {u: model.back(n, t) for u, (n, t) in contexts.items()}
        for r in rows:
            n = contexts[r.u][0]
            own = (r.c - model.discount * r[f"t{k}"]) / (model.strength + n)
            total[r.u] += own
            mean[r.w, r.u] += (own + model.back(*contexts[r.u]) * parent[r.w]) / py.KEPT
        assert all(x == pytest.approx(1) for x in total.values())
    got = {(r.w, r.u): r.p for r in py.predictive(model, table).collect()}
    assert got.keys() == mean.keys() and all(10.0 ** got[k] == pytest.approx(mean[k], rel=1e-4) for k in mean)


def test_score_against_brute_force(make_docs, corpus, monkeypatch):
    """Every token's averaged probability, from the tables of the model's entries."""
    monkeypatch.setattr(py, "LOCAL_WORDS", 50)
    monkeypatch.setattr(py, "LOCAL_PAIRS", 40)
    df = make_docs(corpus)
    model, table = py.train(df.filter(py.crc_remainder(F.col("doc_id")) != 0))
    entry = {(r.w, r.u): r for r in table.collect()}
    known = facts(model)
    got = {r.doc_id: r.score for r in py.score(df, model, table).collect()}
    for i, text in corpus.items():
        _, hashes, offsets = next(py.token_stream(pa.array([text], pa.string())))
        want = 0.0
        for w, u in zip(*(x.tolist() for x in py._pairs_of(hashes, offsets, model.codes)), strict=True):
            p = 0.0
            for k, (contexts, words_) in enumerate(known):
                n, t = contexts.get(u, (0, 0))
                parent = model.parent(*words_[w][1:], model.states[k]) if w in words_ else model.unseen()[k]
                own = max(entry[w, u].c - model.discount * entry[w, u][f"t{k}"], 0) / (model.strength + n) if (w, u) in entry else 0.0
                p += (own + model.back(n, t) * parent) / py.KEPT
            want += math.log10(p)
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_packed_rows_hold_all_pairs_in_few_bytes(make_docs, monkeypatch):
    """What is written for pairs: a row or two a bucket, and not 24 bytes a pair."""
    rng = random.Random(9)
    docs = make_docs({i: " ".join(f"w{rng.randrange(2_000)}" for _ in range(400)) for i in range(100)})
    monkeypatch.setattr(py, "BUCKET", 10_000)
    model, table = py.train(docs)
    n = table.count()
    assert table.agg(F.sum("c")).first()[0] == 40_100 and n > 30_000
    assert model.pairs.buckets == 5
    found = [len(r.data) for r in table.cuts[0].collect()]
    assert len(found) <= 2 * model.pairs.buckets and sum(found) < 6 * n


def test_groups_and_buckets_do_not_change_scores(make_docs, corpus, monkeypatch):
    """Rows that repeat, ids that are null, tokens that are hashed and unknown, over several tasks, buckets and groups."""
    monkeypatch.setattr(py, "LOCAL_WORDS", 50)
    monkeypatch.setattr(py, "LOCAL_PAIRS", 40)
    df = make_docs(corpus)
    df = df.unionByName(df.filter("doc_id < 9")).unionByName(df.filter("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = sorted(py.score_held_out(df.coalesce(1)).collect(), key=key)
    monkeypatch.setattr(py, "BUCKET", 40)
    got = sorted(py.score_held_out(df.repartition(5)).collect(), key=key)
    assert len(got) == len(want) == df.count() and got[-1].doc_id is None and got[-1].held_out
    for a, b in zip(got, want, strict=True):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens)
        assert a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score, rel=1e-6)


def test_sums_of_a_bucket_are_folded(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(-50, 50, 30)), k) for k in range(40)]
    rows = [(w, np.full(len(w), k + 1)) for w, k in rows]
    monkeypatch.setattr(py, "COUNTED_TOKENS", 60)
    w, c = py._merged((py._pack(*x) for x in rows), 1, 2)
    want = Counter()
    for x, y in rows:
        want.update(dict(zip(x.tolist(), y.tolist(), strict=True)))
    assert dict(zip(w.tolist(), c.tolist(), strict=True)) == want and (np.diff(w) > 0).all()


def exact_odds(c, others, parent, d, strength):
    """Probability of each number of tables, by walking through all seatings of c customers."""
    weight = {(0, 0): 1.0}  # customers seated, tables
    for n in range(c):
        new = Counter()
        for (_, t), x in weight.items():
            new[n + 1, t + 1] += x * (strength + d * (others + t)) * parent
            if t:
                new[n + 1, t] += x * (n - d * t)
        top = max(new.values())
        weight = {k: x / top for k, x in new.items()}
    total = sum(weight.values())
    return np.array([weight[c, t] / total for t in range(1, c + 1)])


@pytest.mark.parametrize("c, others, parent", [(2, 5, 0.1), (7, 30, 0.05), (40, 3, 0.3), (300, 100, 0.01)])
def test_tables_have_the_odds_of_the_process(c, others, parent):
    runs, d, strength = 20_000, 0.6, 1.0
    keys = np.arange(runs, dtype=np.uint64) * np.uint64(977)
    got = py.seat(np.full(runs, c), np.full(runs, parent), np.full(runs, float(others)), d, strength, keys)
    want = exact_odds(c, others, parent, d, strength)
    share = np.bincount(got, minlength=c + 1)[1 : c + 1] / runs
    assert np.abs(share - want).max() < 0.02 and got.mean() == pytest.approx(want @ np.arange(1, c + 1), rel=0.02)


@pytest.mark.parametrize("others, parent", [(10, 0.001), (200, 0.001), (2000, 0.002), (20_000, 0.002)])
def test_many_customers_have_nearly_the_odds_of_the_process(others, parent, monkeypatch):
    runs, d, c = 4_000, 0.6, py.EXACT
    keys = np.arange(runs, dtype=np.uint64) * np.uint64(31)
    args = np.full(runs, c), np.full(runs, parent), np.full(runs, float(others)), d, 1.0, keys
    want = py.seat(*args)
    monkeypatch.setattr(py, "EXACT", c)
    log_s = py._log_stirling(d)
    monkeypatch.setattr(py, "_log_stirling", lambda _: log_s)
    monkeypatch.setattr(py, "EXACT", c - 1)
    got = py.seat(*args)
    assert got.mean() == pytest.approx(want.mean(), rel=0.12)


def test_sweeps_keep_the_law_of_a_small_restaurant():
    """Gibbs sweeps over two dishes of one restaurant have the joint law of their tables."""
    d, strength, parent, c = 0.5, 1.0, np.array([0.2, 0.3]), np.array([4, 6])
    rng = np.random.default_rng(2)
    t, seen = np.array([1, 1]), Counter()
    for _ in range(6_000):
        for k in (0, 1):
            key = rng.integers(0, 1 << 63, 1).astype(np.uint64)
            t[k] = py.seat(c[k : k + 1], parent[k : k + 1], np.array([float(t[1 - k])]), d, strength, key)[0]
        seen[tuple(t.tolist())] += 1
    log_s = py._log_stirling(d)
    law = {
        (a, b): math.exp(log_s[4, a] + log_s[6, b]) * math.prod(strength + d * k for k in range(a + b)) * parent[0] ** a * parent[1] ** b
        for a in range(1, 5) for b in range(1, 7)
    }
    total = sum(law.values())
    assert max(abs(seen[k] / 6_000 - v / total) for k, v in law.items()) < 0.03


def test_context_helps_and_held_out_beats_the_base(make_docs):
    rng = random.Random(3)
    follow = {f"w{k}": [f"w{(7 * k + j) % 40}" for j in range(2)] for k in range(40)}
    texts = {}
    for i in range(300):
        w = [f"w{rng.randrange(40)}"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        texts[i] = " ".join(w)
    rows = {r.held_out: r for r in py.perplexity(py.score_held_out(make_docs(texts))).collect()}
    assert rows[True].perplexity < 0.2 * rows[True].base_perplexity


def test_no_training_rows_and_empty_table(make_docs):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = py.score_held_out(make_docs({held: "a b"})).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and r.score == pytest.approx(0.0)
    assert py.score_held_out(make_docs([])).count() == 0
