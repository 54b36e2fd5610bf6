"""Both legs of retrieval against exhaustive scoring, with readers of every kind."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prose.operators import lexical, retrieve

SCHEMA = "chunk long, text string, embedding array<double>, speakers array<string>, novel_uuid string, series_key string, novel_number int, chapter_index int"
READERS = "query long, text string, series_key string, novel_uuid string, novel_number_now int, current_chapter int, include_series boolean, speaker string, query_embedding array<double>"


def sample(books, chapters, per, words, seed):
    """Passages of two series of ``books`` books: common words in all of them, rare ones of their own chapter."""
    rng = random.Random(seed)
    rows = []
    for series in "ab":
        for book in range(1, books + 1):
            for chapter in range(chapters):
                for _ in range(per):
                    text = [f"c{min(int(rng.expovariate(0.25)), 30)}" for _ in range(words)] + [f"r{rng.randrange(400)}" for _ in range(words // 4)] + [f"own{series}{rng.randrange(40)}"]
                    rng.shuffle(text)
                    vector = [rng.gauss(0, 1) for _ in range(8)] if rng.random() < 0.8 else None
                    said = rng.choice([None, [], ["Mina"], ["Mina", "Lucy"], ["Lucy"]])
                    rows.append((len(rows), " ".join(text), vector, said, f"{series}{book}", series, book, chapter))
    readers = []
    for k in range(12):
        at = rng.choice(rows)
        near = [f"r{rng.randrange(400)}" for _ in range(3)] + ["c0", "c1", "c2", "none"] + at[1].split()[:6]
        wide = [True, None, False][k % 3]
        readers.append((k, " ".join(near), None if k % 5 == 4 else at[5], at[4], at[6], rng.randrange(chapters), wide, "Mina" if k % 4 == 3 else None, [rng.gauss(0, 1) for _ in range(8)] if k else None))
    return rows, readers


def visible(p, r):
    same = p[5] == r[2] if r[2] is not None and r[6] is not False else p[4] == r[3]
    return same and (p[6] < r[4] or (p[6] == r[4] and p[7] <= r[5])) and (r[7] is None or r[7] in (p[3] or []))


def best(scores, k):
    return [(c, s) for c, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


def exhaustive(rows, readers, k):
    terms = {p[0]: Counter(p[1].split()) for p in rows}
    df = Counter(t for c in terms.values() for t in c)
    mean = sum(sum(c.values()) for c in terms.values()) / len(terms)
    idf = {t: math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weight = {c: {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean)) for t, n in w.items()} for c, w in terms.items()}
    out = {}
    for r in readers:
        asked = set(r[1].split())
        scores = {p[0]: round(sum(w for t, w in weight[p[0]].items() if t in asked), 6) for p in rows if visible(p, r) and asked & weight[p[0]].keys()}
        out[r[0]] = best(scores, k)
    return out, sum(len(asked_terms(r) & weight[p[0]].keys()) for r in readers for p in rows if visible(p, r))


def asked_terms(r):
    return set(r[1].split())


def told(hits):
    out = {}
    for r in hits.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.chunk, r.score))
    return out


def same(got, want):
    assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items() if v}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("block,seeds,lists", [(128, 48, 50_000), (4, 3, 20)])
def test_lexical_leg_equals_exhaustive_scoring(spark, tmp_path, monkeypatch, block, seeds, lists):
    for name, value in {"BLOCK": block, "SEEDS": seeds, "LIST": lists}.items():
        monkeypatch.setattr(lexical, name, value)
    rows, readers = sample(3, 6, 10, 20, 1)
    lexical.write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"))
    steps = lexical.search_steps(spark.createDataFrame(readers, READERS), lexical.read_index(spark, str(tmp_path / "index")), 10)
    want, _ = exhaustive(rows, readers, 10)
    same(told(steps["hits"]), want)


def test_most_postings_are_not_scored(spark, tmp_path, monkeypatch):
    """Of long lists only the blocks that can matter are read: at most a third here, and few passages are scored in full."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rows, readers = sample(2, 10, 60, 30, 2)
    readers = [(*r[:2], *r[2:4], 2, 9, True, None, None) for r in readers if r[2]]
    lexical.write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"))
    steps = lexical.search_steps(spark.createDataFrame(readers, READERS), lexical.read_index(spark, str(tmp_path / "index")), 5)
    want, postings = exhaustive(rows, readers, 5)
    same(told(steps["hits"]), want)
    assert steps["threshold"].count() == len(readers)
    assert steps["read"].count() < postings / 3
    assert steps["candidates"].count() < len(rows) * len(readers) / 20


def test_dense_leg_equals_exhaustive_scoring(spark, monkeypatch):
    rows, readers = sample(3, 6, 8, 4, 3)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {
        r[0]: best({p[0]: round(float(unit(p[2]) @ unit(r[8])), 6) for p in rows if p[2] and visible(p, r)}, 7) for r in readers if r[8]
    }
    run = lambda: told(retrieve.dense(spark.createDataFrame(readers, READERS), spark.createDataFrame(rows, SCHEMA), 7))
    same(run(), want)
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(retrieve, "BLOCK_CHUNKS", 5)
    same(run(), want)


def test_fused_hits_pass_the_gate(spark, tmp_path):
    rows, readers = sample(3, 6, 10, 20, 4)
    passages, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(readers, READERS)
    lexical.write_index(passages, str(tmp_path / "index"))
    legs = [retrieve.dense(asked, passages), lexical.bm25(asked, lexical.read_index(spark, str(tmp_path / "index")))]
    hits = retrieve.fused(legs).collect()
    by_id = {p[0]: p for p in rows}
    assert len(hits) > 100 and all(visible(by_id[h.chunk], readers[h.query]) for h in hits)


def test_edges_of_the_index(spark, tmp_path):
    empty, nothing = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], READERS)
    rows = [(1, None, None, None, "u", None, 1, 0), (2, "", None, None, "u", None, 1, 0), (3, "Word word", [0.0] * 8, None, "u", None, 1, 0), (3, "Word word", [0.0] * 8, None, "u", None, 1, 0)]
    readers = [(1, "WORD", None, "u", 1, 0, None, None, [0.0] * 8), (2, None, "x", "u", 1, 0, True, None, None)]
    lexical.write_index(spark.createDataFrame(rows[:3], SCHEMA), str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    assert [(r.query, r.chunk) for r in lexical.bm25(spark.createDataFrame(readers, READERS), index).collect()] == [(1, 3)]
    assert lexical.bm25(nothing, index).count() == 0
    assert retrieve.dense(nothing, spark.createDataFrame(rows, SCHEMA)).count() == 0 and retrieve.dense(spark.createDataFrame(readers, READERS), empty).count() == 0
    assert [(r.chunk, r.score) for r in retrieve.dense(spark.createDataFrame(readers, READERS), spark.createDataFrame(rows, SCHEMA)).collect()] == [(3, 0.0), (3, 0.0)]
    lexical.write_index(empty, str(tmp_path / "e"))
    assert lexical.bm25(spark.createDataFrame(readers, READERS), {n: spark.read.schema(df.schema).parquet(str(tmp_path / "e" / n)) for n, df in index.items()}).count() == 0


def test_reranker_that_scores_no_hit(spark):
    """A query whose reranking came back without a score of its hits loses its fusion scores; one that failed keeps them."""
    hits = spark.createDataFrame([(q, c, 1.0 / (1 + c), 1 + c) for q in (1, 2, 3) for c in range(3)], "query long, chunk long, score double, rank int")
    given = spark.createDataFrame([(3, 2, 0.5)], "query long, chunk long, rerank double")
    answered = spark.createDataFrame([(1,), (3,)], "query long")
    got = {(r.query, r["rank"]): (r.chunk, r.score) for r in retrieve.reranked(hits, given, answered=answered).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert [got[2, k][1] for k in (1, 2, 3)] == [1.0, 0.5, 1 / 3]
    assert [got[3, k] for k in (1, 2, 3)] == [(2, 0.5), (0, 0.0), (1, 0.0)]


def test_small_books_are_scored_where_they_lie(spark, tmp_path, monkeypatch):
    """Books of no more passages than a block holds have no blocks; searched beside large ones, they give the same as scoring everything."""
    monkeypatch.setattr(lexical, "PART_QUERIES", 2)
    rows, readers = sample(2, 6, 10, 20, 5)
    rows = [p for p in rows if p[5] == "a" or p[0] % 2]
    want, _ = exhaustive(rows, readers, 10)
    for block, large in ((128, set()), (40, {"a1", "a2"})):
        monkeypatch.setattr(lexical, "BLOCK", block)
        folder = str(tmp_path / f"index{block}")
        lexical.write_index(spark.createDataFrame(rows, SCHEMA), folder)
        index = lexical.read_index(spark, folder)
        assert {r.novel_uuid for r in index["blocks"].select("novel_uuid").distinct().collect()} == large
        same(told(lexical.bm25(spark.createDataFrame(readers, READERS), index, 10)), want)
