import re
from collections import Counter

from prose.llm import quality

from .conftest import words


def base(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_columns(make_docs, corpus):
    texts = corpus | {200: "a b c a b c d", 201: "# x\n# x\n\n $%&|<>* y", 202: "a b c " * 400, 203: "x y x y x y"}
    got = {r.doc_id: tuple(r)[1:7] for r in quality.base_features(make_docs(texts, extra=True)).collect()}
    assert got == {i: base(t) for i, t in texts.items()}


def test_hash_clashes_and_long_texts_take_the_plain_sort(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(quality, "_PLACE_BITS", 5)
    got = {r.doc_id: r.n_repeat_words for r in quality.base_features(make_docs(corpus)).collect()}
    assert got == {i: base(t)[4] for i, t in corpus.items()}


def name(k):
    return "".join(chr(97 + int(c)) for c in str(abs(k) * 7 + (k < 0)))


def own(i, n):
    return " ".join(f"w{name(i)}x{name(k)}" for k in range(n))


def judged(texts, limit=20):
    """Brute force: a line is frequent in more than ``limit`` different texts; kept unless it takes over half of the characters."""
    normal = lambda x: re.sub("[0-9]+", "0", x.lower()).strip(" ")
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    count = Counter(n for t in set(texts.values()) for n in {normal(x) for x in lines(t)})
    out = {}
    for i, t in texts.items():
        gone = sum(len("".join(words(x))) for x in lines(t) if count[normal(x)] > limit)
        out[i] = (gone, not base(t)[5] and gone <= 0.5 * base(t)[1])
    return out


def test_frequent_lines_reject_depleted_documents(make_docs):
    banner = " ".join(f"banner{name(k)}" for k in range(60))
    second = " ".join(f"second{name(k)}" for k in range(60))
    texts = {i: own(i, 20) + "\n" + banner.upper() + f" {i}\n{own(-i, 10)}" for i in range(1, 40)}
    texts[50] = own(50, 190) + "\n" + banner + " 7"
    texts |= {60 + i: own(60, 60) + "\n" + own(61, 5) for i in range(60)}  # exact copies are one document
    texts |= {200 + i: f"{own(200 + i, 30)}\nlead\n{second}" for i in range(30)}  # two lines of template in a row
    texts |= {300 + i: f"{own(300 + i, 60)}\njust twenty" for i in range(20)}  # at the limit: not frequent
    want = judged(texts)
    got = {r.doc_id: (r.n_frequent_chars, r.kept) for r in quality.judge(make_docs(texts, extra=True)).collect()}
    assert got == want
    assert not any(got[i][1] for i in [*range(1, 40), *range(200, 230)])
    assert got[50][1] and all(got[60 + i] == (0, True) for i in range(60)) and got[300] == (0, True)
    kept = {r.doc_id: r for r in quality.kept_rows(make_docs(texts, extra=True)).collect()}
    assert kept.keys() == {i for i, (_, k) in got.items() if k}
    assert kept[50].text == own(50, 190) and kept[50].n_chars == len(kept[50].text) and kept[50].host == "x"
    assert kept[60].text == texts[60]
    other_hosts = make_docs(texts).selectExpr("doc_id", "text", "lang", "concat('h', doc_id) as source", "n_chars")
    assert all(r.kept for r in quality.judge(other_hosts).collect())


def test_repeated_rows_are_judged_alike(make_docs, corpus):
    texts = corpus | {200 + i: f"{own(i, 60)}\nshared {i} line" for i in range(25)}
    once = {r.doc_id: tuple(r) for r in quality.judge(make_docs(texts)).collect()}
    df = make_docs(texts)
    for _ in range(6):
        df = df.unionByName(make_docs({200: texts[200]}))
    rows = [tuple(r) for r in quality.judge(df).collect()]
    assert len(rows) == len(texts) + 6 and set(rows) == set(once.values())
    assert quality.kept_rows(df).filter("doc_id = 200").count() == 7


def test_nulls_and_empty_table(make_docs, spark):
    df = make_docs({None: "a b", 3: None}, source=None)
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judge(df).collect()) == [(0, 2, False), (3, 0, False)]
    assert quality.judge(make_docs([])).count() == 0 and quality.kept_rows(make_docs([])).count() == 0
