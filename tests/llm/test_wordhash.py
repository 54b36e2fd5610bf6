import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from prose.llm.wordhash import gram_hashes, sliding_min, split_words, text_slices

from .conftest import FOLD, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n\té\x0b\xa0.", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        split = split_words(data, offsets, lower=True)
        for k in range(len(offsets) - 1):
            a, b = split.first[k], split.first[k + 1]
            got.append([split.data[s:e].tobytes().decode() for s, e in zip(split.starts[a:b], split.ends[a:b])])
    assert got == [words((t or "").translate(FOLD)) for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_equal_grams_have_equal_hashes(texts):
    seen = {}
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        split = split_words(data, offsets)
        hashes, at = gram_hashes(split, 2)
        names = [split.data[s:e].tobytes() for s, e in zip(split.starts, split.ends)]
        for h, k in zip(hashes.tolist(), at.tolist()):
            assert seen.setdefault((names[k], names[k + 1]), h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 99), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(values, width):
    got = sliding_min(np.array(values), width) if len(values) >= width else []
    assert list(got) == [min(values[k : k + width]) for k in range(len(values) - width + 1)]
