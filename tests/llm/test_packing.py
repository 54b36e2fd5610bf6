import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prose.llm import packing
from prose.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8))
def test_reduction_and_fit_hold_every_item_once(histogram):
    patterns = packing.reduce_and_fit(histogram, 20)
    got = Counter()
    for items, times in patterns:
        assert 0 < sum(n * t for n, t in items) <= 20 and times > 0
        for n, t in items:
            got[n] += t * times
    assert got == Counter(histogram)
    bins = sum(t for _, t in patterns)
    plain = sum(t for _, t in packing.best_fit(histogram, 20))
    bound = -(-sum(n * c for n, c in histogram.items()) // 20)
    assert bound <= bins <= plain + 1


def fewest(items, capacity):
    """Exact number of sequences, by trying every open sequence for the next longest item."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= items[k]}:
            at = rooms.index(r)
            place(k + 1, [*rooms[:at], r - items[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(20, 40))
def test_fixed_sets_cost_no_sequence(items, capacity):
    items = [min(n, capacity) for n in items]
    patterns, left = packing.reduction(Counter(items), capacity)
    assert sum(t for _, t in patterns) + fewest(list(Counter(left).elements()), capacity) == fewest(items, capacity)


def test_three_short_items_that_beat_the_longest_partner_stop_the_reduction():
    assert packing.reduction({120: 1, 114: 1, 60: 1, 26: 4}, 200) == ([], {120: 1, 114: 1, 60: 1, 26: 4})
    assert packing.reduction({150: 3, 50: 1, 40: 2}, 200)[1] == {}


def test_hot_lengths_are_numbered_by_several_tasks(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "TASK_PIECES", 7)
    rows = packing.pack(packing.pieces(make_docs(["a b"] * 60 + ["word " * 2100] * 20), PATH)).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 100
    assert all((s, o) in places or o == 0 for s, o in places)


def test_pieces_and_places(make_docs, corpus):
    texts = corpus | {300: "word " * 5000, 301: "<|startoftext|> Don't <|END|> é.,x", 302: "A.", 303: ".", 304: "x," * 3000}
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    df = make_docs(texts, extra=True)
    rows = packing.pack(packing.pieces(df.union(df.filter("doc_id = 303")), PATH)).collect()
    assert len(rows) == sum(-(-len(x) // 2048) for x in ids.values()) + 1
    filled = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 2048 and len(own) == r.length == min(2048, len(ids[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(map(len, ids.values())) + 2
    assert len(filled) <= -(-total // 2048) + 1


def test_empty_table(make_docs):
    assert packing.pack(packing.pieces(make_docs([]), PATH)).count() == 0


@pytest.mark.parametrize("size", [1, 5])
def test_cache_that_starts_anew_gives_the_same(make_docs, monkeypatch, size):
    from prose.llm import wordcache

    monkeypatch.setattr(wordcache, "MAX_WORDS", size)
    cache = wordcache.WordCache(lambda words: [[len(w)] * len(w) for w in words])
    import numpy as np

    for names in (["a", "bb", "a"], ["ccc", "bb"], ["a", "dddd", "ccc"]):
        slots, _ = cache.lookup(np.array([hash(n) & (2**63 - 1) for n in names], dtype=np.uint64), names.__getitem__)
        assert cache.gather(slots).tolist() == [len(n) for n in names for _ in n]
