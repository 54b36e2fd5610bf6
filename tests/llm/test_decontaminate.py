import random

import numpy as np
import pytest

from prose.llm import decontaminate as d

ITEM_SCHEMA = "item_id long, text string, doc_id long"


def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != w)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert d.best_edits(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64)) == edit_distance_inside(item, text)


def planted(rng, n, share):
    words = [f"w{rng.randrange(4000)}" for _ in range(n)]
    out = list(words)
    for _ in range(int(share * n)):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        out[k : k + 1] = [[], [f"x{rng.randrange(99)}"], [out[k], f"y{rng.randrange(99)}"]][kind]
    return words, out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_of_planted_leaks(make_docs, spark, share):
    rng = random.Random(int(share * 100))
    items, docs = [], {}
    for i in range(120):
        item, leak = planted(rng, rng.randint(10, 70), share)
        items.append((i, " ".join(item), i))
        fill = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(0, 300)))
        docs[i] = f"{fill()} {' '.join(leak).upper()}\n{fill()}"
        docs[1000 + i] = fill()
    got = {(r.doc_id, r.item_id): r.edits for r in d.leaks(make_docs(docs, extra=True), spark.createDataFrame(items, ITEM_SCHEMA)).collect()}
    words = {i: t.split() for i, t, _ in items}
    want = {i for i in range(120) if edit_distance_inside(words[i], docs[i].lower().split()) <= int(0.2 * len(words[i]))}
    assert len(want & {i for i, j in got if i == j}) >= 0.98 * len(want)
    for (i, j), edits in got.items():
        assert edits == edit_distance_inside(words[j], docs[i].lower().split()) <= int(0.2 * len(words[j]))


@pytest.mark.parametrize("low, high, many", [(2, 9, 150), (80, 130, 60), (250, 400, 40), (900, 1000, 12)])
def test_recall_at_every_length(make_docs, spark, low, high, many):
    rng = random.Random(low)
    items, docs = [], {}
    for i in range(many):
        item, leak = planted(rng, rng.randint(low, high), 0.2)
        items.append((i, " ".join(item), i))
        fill = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(0, 200)))
        docs[i] = f"{fill()} {' '.join(leak)} {fill()}"
    got = {(r.doc_id, r.item_id): r.edits for r in d.leaks(make_docs(docs), spark.createDataFrame(items, ITEM_SCHEMA)).collect()}
    words = {i: t.split() for i, t, _ in items}
    least = {i: edit_distance_inside(words[i], docs[i].split()) for i in range(many)}
    want = {i for i in range(many) if least[i] <= int(0.2 * len(words[i]))}
    assert len(want) > many / 2 and len(want & {i for i, j in got if i == j}) >= 0.95 * len(want)
    assert all(got[i, i] == least[i] for i in want if (i, i) in got)


def test_clean_blocks_and_edge_cases(make_docs, spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h", 0), (1, "a b c d e f g h", 0), (2, None, 0), (3, "a b", 0), (None, "k l m n o p", 0), (4, "Alone", 0)], ITEM_SCHEMA)
    docs = make_docs({1: "x a b c d e f g h y", 2: "a b", 3: None, 4: "", 5: "k l m n o p", 6: "so alone", None: "clean"})
    for size in (10_000, 1):
        monkeypatch.setattr(d, "BLOCK_ITEMS", size)
        assert sorted((r.doc_id, r.item_id or -1) for r in d.leaks(docs, items).collect()) == [(1, 1), (1, 1), (1, 3), (2, 3), (5, -1), (6, 4)]
        kept = d.clean(docs, items)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "None"]
    assert d.leaks(make_docs([]), items).count() == 0
    assert d.leaks(docs, items.limit(0)).count() == 0 and d.clean(docs, items.limit(0)).count() == 7
