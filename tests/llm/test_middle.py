import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prose.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def told(doc_id, text, seed=42, rate=50, spm=80):
    """The transformation by a regular expression, unit by unit."""
    units = UNIT.findall(text or "")
    assert "".join(units) == (text or "")
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text or ""
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["a", "é", "語", "🙂", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1f", "\x0e", "\x08", "\x80", "\xa0", "　", "<P", "S>", "<", ">", "M>"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100)])
def test_equals_the_regular_expression(make_docs, corpus, rate, spm):
    texts = random_texts(400, rate + spm) + [t for t in corpus.values()] + ["x <M> y", "word " * 60_000, "🙂" * 30_000, " " * 9_001]
    got = {r.doc_id: tuple(r)[1:] for r in middle.transform(make_docs(texts), 42, rate, spm).collect()}
    assert got == {i: told(i, t, 42, rate, spm) for i, t in enumerate(texts)}
    assert {f for _, f, *_ in got.values()} >= ({"spm"} if spm else {"psm"})


def test_restores_every_text(make_docs):
    texts = random_texts(600, 3)
    out = middle.transform(make_docs(texts), rate=100).select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate(texts))


def test_marks_ranks_and_selects():
    data = np.frombuffer("ab  c\té 語\n\n".encode() + b"tail ", dtype=np.uint8)
    ends = middle.unit_ends(data, np.array([0, 0, 14, 19]))
    positions = [1, 4, 7, 11, 13, 17, 18]
    assert ends.select(np.arange(1, 8)).tolist() == positions
    assert ends.rank(np.arange(20)).tolist() == [sum(p < k for p in positions) for k in range(20)]


def test_seed_changes_cuts_and_rows_repeat(make_docs, spark):
    df = make_docs({5: "one two three four five " * 20, 7: None})
    rows = [tuple(r) for r in middle.transform(df.unionByName(df), rate=100).collect()]
    assert len(rows) == 4 and len(set(rows)) == 2
    assert middle.transform(df, seed=7, rate=100).first().output != middle.transform(df, rate=100).first().output
    nothing = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [r.n for r in middle.transform(nothing).collect()] == [2, 0]
