"""Cases that every operator defines: clashing columns, repeated rows, empty and null texts, very long texts."""

import pytest
from pyspark.sql import functions as F

from prose.llm import chat, decontaminate, jaccard, packing, pages, pii, pitman_yor, quality, repeats, tokens
from prose.llm.queries import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ITEM = " ".join(f"item{k}" for k in range(12))


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")


#: Operators that return a result per row or finding, and those that return rows of the input.
RESULTS = {
    "repeats": lambda d: repeats.remove_repeats(d),
    "quality": lambda d: quality.judge(d),
    "decontaminate": lambda d: decontaminate.leaks(d, items(d.sparkSession)),
    "pii": lambda d: pii.digest(pii.find(d)),
    "packing": lambda d: packing.pieces(d, WORDS),
    "jaccard": lambda d: jaccard.link_components(d),
    "tokens": lambda d: tokens.count_tokens(d, BYTES),
    "pitman_yor": lambda d: pitman_yor.score_held_out(d),
}
ROWS = {
    "quality": lambda d: quality.kept_rows(d),
    "jaccard": lambda d: jaccard.representatives(d),
    "decontaminate": lambda d: decontaminate.clean(d, items(d.sparkSession)),
    "pii": lambda d: pii.mask(d),
}


def told(df):
    return sorted(str(tuple(round(x, 3) if isinstance(x, float) else x for x in r)) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    long = " ".join(f"w{k % 7001}x{k % 13}" for k in range(20_000))
    return {1: long, 2: None, 3: "", 4: " \n\t", 5: f"start {ITEM} mail a@b.co end", 6: "x" * 60_000, 7: "same words " * 40, 8: "same words " * 40, 9: "\n".join(["line"] * 1_000)}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_results_ignore_other_columns_and_take_any_text(make_docs, texts, name):
    plain = told(RESULTS[name](make_docs(texts)))
    assert plain and told(RESULTS[name](make_docs(texts, extra=True))) == plain


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_keep_other_columns_and_take_any_text(make_docs, texts, name):
    plain, more = ROWS[name](make_docs(texts)), ROWS[name](make_docs(texts, extra=True))
    assert more.columns == make_docs(texts, extra=True).columns
    assert told(more.select("doc_id", "text", "lang", "source", "n_chars")) == told(plain)
    assert more.filter("host <> 'x' or id <> 'x' or spans <> 'x'").count() == 0


@pytest.mark.parametrize("name", sorted(set(RESULTS) - {"pitman_yor"}))
def test_repeated_rows_have_repeated_results(make_docs, texts, name):
    some = {i: texts[i] for i in (2, 3, 5, 7)}
    df = make_docs(some)
    once, twice = told(RESULTS[name](df)), told(RESULTS[name](df.unionByName(df)))
    assert twice == sorted(once * 2)


def test_repeated_rows_are_scored_alike(make_docs, texts):
    df = make_docs({i: texts[i] for i in (3, 5, 7)})
    rows = [tuple(r) for r in pitman_yor.score_held_out(df.unionByName(df)).collect()]
    assert len(rows) == 6 and len(set(rows)) == 3


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_empty_tables(make_docs, name):
    assert RESULTS[name](make_docs([])).count() == 0


def test_long_conversation_and_page(spark):
    kind = "conv_id long, turn long, role string, text string, k1 long, start long, tree string"
    turns = [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (2_000 if k == 3 else 1), 0, 0, "x") for k in range(60)]
    nodes, last = chat.format_tree(spark.createDataFrame(turns, kind), BYTES)
    got = chat.read_back(nodes, last, BYTES).first()
    assert got.n_turns == 60 and got.loss_chars == sum(len(t[3]) for t in turns if t[2] == "assistant")
    assert nodes.agg(F.count("*")).first()[0] == 60
    html = "<article>" + "".join(f"<p>line {k}</p>" for k in range(6_000)) + "</article>"
    rows = [(1, "http://h/a", html, "x"), (2, "http://h/b", html, "x")]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, lines string")).collect()
    assert all(r.text.count("\n\n") == 5_999 for r in out)
