"""Requests of the second pass in rounds, where a chunk's request shows what the answers before it said.

Chunks of a section depend on each other, sections do not. A round asks for the next chunk of every section at once,
reads the answers, and moves each section's cursor; so there are as many rounds as the longest section has chunks that a model must read. Every
round leaves its requests, answers and cursors in its own folder, cursors last; a job that was killed goes on with the
first round that has no cursors, and does not ask again what was answered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import answers as A
from . import segment

#: Lines of history, characters of the chunk before and after, and what stands for none.
HISTORY, BEFORE_CHARS = 8, 800
NO_BEFORE, NO_HISTORY, NO_AHEAD = "(start of section)", "(start of novel)", "(end of section)"


def written(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """What stands under a path, written there first if it does not."""
    if not written(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _first_cursor(chunks: DataFrame) -> DataFrame:
    """(novel, section_index, cursor, history, previous): the first chunk to ask for, and the text before it."""
    first = chunks.filter("spoken").groupBy(*A.SECTION).agg(F.min("chunk").alias("cursor"))
    at = chunks.join(first, A.SECTION).filter("chunk = cursor")
    return at.select(*A.SECTION, "cursor", F.expr("cast(array() as array<string>)").alias("history"), F.col("text_before").alias("previous"))


def _requests(cursors: DataFrame, chunks: DataFrame) -> DataFrame:
    near = lambda x, n, none: F.coalesce(F.nullif(F.substring(x, 1, n), F.lit("")), F.lit(none))
    at = cursors.withColumnRenamed("cursor", "chunk").join(chunks, [*A.SECTION, "chunk"])
    return at.select(
        *A.SECTION, "chunk", near("previous", BEFORE_CHARS, NO_BEFORE).alias("before"), F.coalesce(F.nullif(F.array_join("history", "\n"), F.lit("")), F.lit(NO_HISTORY)).alias("history"),
        "text", near("ahead", A.AHEAD_CHARS, NO_AHEAD).alias("ahead"),
    )


def _moved(cursors: DataFrame, chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Cursors after a round. lines (novel, section_index, chunk, said, failed) are what its answers matched, in order.

    The text before the next chunk is that of the chunk before it; a chunk that failed is passed over, so the one before it stays.
    """
    met = cursors.join(lines.withColumnRenamed("chunk", "cursor"), [*A.SECTION, "cursor"], "left")
    told = F.concat("history", F.coalesce("said", F.expr("cast(array() as array<string>)")))
    met = met.select(*A.SECTION, "cursor", F.slice(told, F.greatest(F.size(told) - (HISTORY - 1), F.lit(1)), HISTORY).alias("history"), "previous", F.coalesce("failed", F.lit(True)).alias("failed"))
    after = chunks.select(*A.SECTION, "chunk", "spoken", "text_before").join(met, A.SECTION).filter("chunk > cursor and spoken")
    following = after.groupBy(*A.SECTION).agg(F.min_by(F.struct("chunk", "text_before"), "chunk").alias("x"), F.first("history").alias("history"), F.first("previous").alias("previous"), F.first("failed").alias("failed"), F.first("cursor").alias("cursor"))
    passed = F.col("failed") & (F.col("x.chunk") == F.col("cursor") + 1)
    return following.select(*A.SECTION, F.col("x.chunk").alias("cursor"), "history", F.when(passed, F.col("previous")).otherwise(F.col("x.text_before")).alias("previous"))


def run(parsed: DataFrame, lookup: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(novel, section_index, chunk, raw): all answers of ``ask``, which answers requests (novel, section_index, chunk, before, history, text, ahead).

    parsed is ``answers.parsed_sections``; sections apart from the story are not asked for. All state is in ``folder``, which driver and
    executors share; run again with the same folder to go on.
    """
    spark = parsed.sparkSession
    kept = _kept(parsed, f"{folder}/parsed")
    beside = A.placed_sections(kept)
    rows = kept.filter("not apart").join(beside, A.SECTION).select("*", F.posexplode("chunks").alias("chunk", "c"))
    shown = lambda c: F.when(c.isNotNull(), segment.rendered(A._blocks_of(c)))
    chunks = rows.select(
        *A.SECTION, "chunk", shown(F.col("c")).alias("text"), F.coalesce(shown(F.get("chunks", F.col("chunk") - 1)), F.col("last_chunk")).alias("text_before"),
        F.coalesce(shown(F.get("chunks", F.col("chunk") + 1)), F.col("next_head")).alias("ahead"), F.exists(A._blocks_of(F.col("c")), lambda b: b["block_type"] == "dialogue").alias("spoken"),
    )
    chunks = _kept(chunks, f"{folder}/chunks")
    cursors = _kept(_first_cursor(chunks), f"{folder}/cursors=0")
    k, answered = 0, None
    while not cursors.isEmpty():
        asked = _kept(_requests(cursors, chunks), f"{folder}/requests={k}")
        path = f"{folder}/answers={k}"
        raw = spark.read.parquet(path) if written(spark, path) else _kept(ask(asked).select(*A.SECTION, "chunk", "raw"), path)
        # Entries of these chunks alone; their numbers do not matter here.
        read = A.chunk_rows(kept, raw, lookup).join(cursors.select(*A.SECTION, F.col("cursor").alias("chunk")), [*A.SECTION, "chunk"], "left_semi")
        said = A.entry_rows(read).groupBy(*A.SECTION, "chunk").agg(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("branch") == "matched", F.struct("sequence_number", A.T.history_line(F.col("speaker_name"), F.col("emotion"), F.col("emotion_intensity"), F.col("raw_text")).alias("line"))))), lambda x: x["line"]).alias("said"),
            F.bool_or(F.col("branch") == "failed").alias("failed"),
        )
        answered = raw if answered is None else answered.unionByName(raw)
        k += 1
        cursors = _kept(_moved(cursors, chunks, said), f"{folder}/cursors={k}")
    if answered is None:
        return spark.createDataFrame([], "novel int, section_index int, chunk int, raw string")
    return answered
