import pytest

from prose.llm import repeats

from .conftest import words


def brute(texts):
    docs = {i: words(t) for i, t in texts.items()}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][k : k + 50]), i)
    out = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("pieces, windows, shard", [(20_000, 10_000, 20_000), (20_000, 7, 20_000), (3, 10_000, 20_000), (2, 5, 20_000), (2, 10_000, 3), (0.5, 4, 1)])
def test_against_brute_force(make_docs, corpus, monkeypatch, pieces, windows, shard):
    monkeypatch.setattr(repeats, "TASK_PIECES", pieces)
    monkeypatch.setattr(repeats, "TASK_WINDOWS", shard)
    monkeypatch.setattr(repeats, "AUTOMATON_WINDOWS", windows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(make_docs(corpus, extra=True)).collect()}
    assert got == brute(corpus)
    assert sum(r[1] for r in got.values()) > 500


def test_windows_of_a_wide_anchor_are_dealt_out(make_docs, monkeypatch):
    """One phrase in 1500 texts, each with windows of its own that a later text repeats: both pieces and windows go to many tasks."""
    monkeypatch.setattr(repeats, "TASK_PIECES", 200)
    monkeypatch.setattr(repeats, "TASK_WINDOWS", 500)
    phrase = [f"c{k}" for k in range(30)]
    side = lambda k, s: [f"{s}{k}x{j}" for j in range(25)]
    texts = {k: " ".join(side(k % 750, "a") + phrase + side(k % 750, "b") + [f"e{k}"]) for k in range(1_500)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(make_docs(texts)).collect()}
    assert got == brute(texts) and sum(r[1] for r in got.values()) == 750 * 80


def test_only_recurring_windows_are_compiled():
    passage = [f"p{k}" for k in range(60)]
    pieces = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + passage + [f"b{i}x{k}" for k in range(30)])) for i in range(5)]
    found = repeats.confirmed(pieces)
    assert sorted(at for _, _, at in found) == list(range(30, 41)) and {o for o, _, _ in found} == {0}


def test_very_long_texts(make_docs):
    tale = " ".join(f"w{k}" for k in range(30_000))
    texts = {1: tale, 2: "x " + tale[: len(tale) // 2], 3: "y " * 5000 + tale[-5000:], 4: "z " * 20_000}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(make_docs(texts)).collect()}
    assert got == brute(texts)


def test_repeated_rows_null_ids_and_empty_table(make_docs, spark):
    long = " ".join(f"w{k}" for k in range(60))
    df = make_docs({1: long}).union(make_docs({1: long})).union(make_docs({2: long})).union(make_docs({None: long}))
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert repeats.remove_repeats(make_docs([])).count() == 0
