"""Spoiler-safe retrieval: gate, dense leg, fusion, reading-position boost; the lexical leg is in ``lexical``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVE_K, RERANK_K, TOP_K = 40, 20, 8
ALPHA, DECAY, BOOK_DISTANCE = 0.15, 5.0, 1000
RRF_K = 60


def top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group. Spark keeps k rows per group and task before it shuffles them."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Queries and chunks of a book that meet in one matrix product.
BLOCK_QUERIES, BLOCK_CHUNKS = 2_000, 4_096


def with_speaker(df: DataFrame) -> DataFrame:
    """The speakers that a query asks for; a query without the column asks for none."""
    return df if "speaker" in df.columns else df.withColumn("speaker", F.lit(None).cast("string"))


def books_of(chunks: DataFrame) -> DataFrame:
    """(series_key, novel_uuid, novel_number, chunks): one row per book."""
    return chunks.groupBy("series_key", "novel_uuid", "novel_number").agg(F.count("*").alias("chunks"))


def scopes(readers: DataFrame, books: DataFrame) -> DataFrame:
    """(query, novel_uuid, up_to, chunks): the books that each reader may see, of its own no later chapter than ``up_to``.

    readers (query, series_key, novel_uuid, novel_number_now, current_chapter): a reader sees the books of its
    series up to its own; one without a series, or with ``include_series`` false, its own book alone. This gate stands before
    every leg of a search, so nothing that a reader may not see is scored or ranked.
    """
    wide = F.col("series_key").isNotNull()
    if "include_series" in readers.columns:
        wide &= F.coalesce("include_series", F.lit(True))
    asked = readers.select("query", "series_key", F.col("novel_uuid").alias("_own"), "novel_number_now", "current_chapter", wide.alias("_wide"))
    series = asked.filter("_wide").join(books, "series_key")
    alone = asked.filter("not _wide").drop("series_key").join(books, F.col("_own") == F.col("novel_uuid"))
    columns = ["query", "novel_uuid", "novel_number", "novel_number_now", "current_chapter", "chunks"]
    seen = series.select(*columns).unionByName(alone.select(*columns)).filter("novel_number <= novel_number_now")
    up_to = F.when(F.col("novel_number") == F.col("novel_number_now"), F.col("current_chapter"))
    return seen.select("query", "novel_uuid", up_to.alias("up_to"), "chunks")


def _spread(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - F.lit(1)))


def dense(queries: DataFrame, chunks: DataFrame, k: int = RETRIEVE_K) -> DataFrame:
    """(query, chunk, novel_number_now, current_chapter, novel_number, chapter_index, score, rank): cosine similarity.

    Queries are dealt out to the books that they may see, chunks to blocks of their book; a block of queries
    and a block of chunks meet in one task and one matrix product, and each query's k best of it are shuffled. A query with a
    ``speaker`` sees the chunks alone whose ``speakers`` name it. One scan of the chunks answers any number of queries.
    """
    schema = "query long, chunk long, novel_number_now int, current_chapter int, novel_number int, chapter_index int, score double"
    queries = with_speaker(queries)
    source = chunks if "speakers" in chunks.columns else chunks.withColumn("speakers", F.lit(None).cast("array<string>"))
    seen = scopes(queries, books_of(chunks))
    met = seen.groupBy("novel_uuid").agg(F.ceil(F.max("chunks") / BLOCK_CHUNKS).cast("int").alias("blocks"), F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    key = ["book", "block", "part"]
    left = seen.join(met, "novel_uuid").join(queries.filter("query_embedding is not null").select("query", "novel_number_now", "current_chapter", "speaker", "query_embedding"), "query")
    left = left.withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int")).select(
        F.col("novel_uuid").alias("book"), _spread("blocks").alias("block"), "part", "query", "novel_number_now", "current_chapter", "up_to", "speaker", "query_embedding"
    )
    right = source.filter("embedding is not null").join(met, "novel_uuid").withColumn("block", F.pmod(F.xxhash64("chunk"), "blocks").cast("int"))
    right = right.select(F.col("novel_uuid").alias("book"), "block", _spread("parts").alias("part"), "chunk", "novel_number", "chapter_index", "speakers", "embedding")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _FOUND.empty_table()
        number = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        rows = lambda t, c: _unit_rows(np.stack(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64))
        up_to = np.array([np.inf if x is None else x for x in asked.column("up_to").to_pylist()])
        gate = number(held, "chapter_index") <= up_to[:, None]
        speakers = asked.column("speaker").to_pylist()
        names = [set(x or ()) for x in held.column("speakers").to_pylist()] if any(s is not None for s in speakers) else []
        for speaker in {s for s in speakers if s is not None}:
            gate[[s == speaker for s in speakers]] &= np.array([speaker in n for n in names])
        score = np.where(gate, np.round(rows(asked, "query_embedding") @ rows(held, "embedding").T, 6), -np.inf)
        # Everything that equals the k-th best goes on, so that ties are settled where all blocks meet.
        least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
        row, col = np.nonzero((score >= least) & gate)
        taken = lambda t, c, at: t.column(c).combine_chunks().take(pa.array(at))
        found = [taken(asked, "query", row), taken(held, "chunk", col), taken(asked, "novel_number_now", row), taken(asked, "current_chapter", row),
                 taken(held, "novel_number", col), taken(held, "chapter_index", col), pa.array(score[row, col])]
        return pa.Table.from_arrays(found, schema=_FOUND)

    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)
    return top(hits, "query", "score", "chunk", k)


_FOUND = pa.schema(
    [("query", pa.int64()), ("chunk", pa.int64()), ("novel_number_now", pa.int32()), ("current_chapter", pa.int32()),
     ("novel_number", pa.int32()), ("chapter_index", pa.int32()), ("score", pa.float64())]
)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def reranked(hits: DataFrame, reranks: DataFrame, k: int = RERANK_K, answered: DataFrame | None = None) -> DataFrame:
    """The k best hits by a supplied score (query, chunk, rerank); a query whose reranking failed keeps its fusion scores.

    answered (query): queries whose reranking came back, with or without scores of hits; left out, those that have a score.
    """
    came = reranks.filter("rerank is not null") if answered is None else answered
    answered = came.select("query").distinct().withColumn("_ok", F.lit(True))
    joined = hits.join(reranks.select("query", "chunk", "rerank"), ["query", "chunk"], "left").join(answered, "query", "left")
    score = F.when(F.col("_ok"), F.coalesce("rerank", F.lit(0.0))).otherwise(F.col("score"))
    return top(joined.withColumn("score", score).drop("rerank", "_ok", "rank"), "query", "score", "chunk", k)


def featured(hits: DataFrame, names: DataFrame, k: int = 6) -> DataFrame:
    """(query, chunk, place): passages that feature the asked character first, then by score.

    hits (query, chunk, score, name), names (chunk, names): its speakers and associated characters.
    """
    joined = hits.join(names, "chunk", "left")
    away = ~F.coalesce(F.exists("names", lambda n: F.lower(n) == F.lower("name")), F.lit(False))
    order = Window.partitionBy("query").orderBy(away, F.desc("score"), "chunk")
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query", "chunk", "place")


def boosted(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """Final ranking: score times 1 + alpha * exp(-distance / decay) by distance in the story."""
    distance = F.greatest(
        F.lit(0),
        (F.col("novel_number_now") - F.col("novel_number")) * BOOK_DISTANCE + (F.col("current_chapter") - F.col("chapter_index")),
    )
    score = F.round(F.col("score") * (1 + ALPHA * F.exp(-distance / DECAY)), 6)
    return top(hits.withColumn("score", score).drop("rank"), "query", "score", "chunk", k)


def fused(legs: list[DataFrame], k: int = RETRIEVE_K) -> DataFrame:
    """Reciprocal-rank fusion of (query, chunk, rank) legs."""
    both = legs[0].select("query", "chunk", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query", "chunk", "rank"))
    return top(both.groupBy("query", "chunk").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("score")), "query", "score", "chunk", k)
