import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from prose.llm import tokens
from prose.llm.queries import tokenizer_path
from prose.llm.wordhash import text_slices

PATH = tokenizer_path("byte_bpe_50k.json")
ALPHABET = "ab'st1 \n\t\x0b\r.,é漢😀\xa0 <|>"


def counted(texts):
    counter, out = tokens._counter(PATH), []
    column = pa.array(texts, pa.string())
    for row, stop, data, offsets in text_slices(column):
        n = counter.count(data, offsets)
        out += [len(counter.library.encode(column[k].as_py()).ids) if counter.odd(column[k].as_py() or "") else int(n[k - row]) for k in range(row, stop)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=25), max_size=5))
def test_counts_are_the_library_s(texts):
    library = tokens._counter(PATH).library
    assert counted(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_whole_tokens_are_proven():
    counter = tokens._counter(PATH)
    assert len(counter.whole) > 40_000
    assert all(len(counter.library.encode(t).ids) == 1 for t in sorted(counter.whole)[::500])


def test_rows(make_docs, corpus):
    texts = corpus | {400: "<|endoftext|> x", 401: "a b", 402: "y" * 3000, 403: "hello " * 2000}
    library = tokens._counter(PATH).library
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(make_docs(texts, extra=True), PATH).collect()}
    n = {i: len(library.encode(t or "").ids) for i, t in texts.items()}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts.items()}
    assert tokens.count_tokens(make_docs([]), PATH).count() == 0
