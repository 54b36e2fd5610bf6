"""Logical tables of a library of prose, derived from the driver's tables, and its writers.

Every adapter takes (spark, dir) and returns a DataFrame. Text stays out of shuffles: rows are
numbered on ids and joined back to their text once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import library


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a single machine without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def novel_of(doc_id: Column) -> Column:
    """Fifty documents make a novel, so there are more novels, not longer ones, in a larger table."""
    return F.floor(doc_id / 50).cast("int")


def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(novel, section_index, doc_id, title): documents in a row are the sections of a novel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", novel_of(F.col("doc_id")).alias("novel"))
    index = (F.row_number().over(Window.partitionBy("novel").orderBy("doc_id")) - 1).alias("section_index")
    title = (
        F.when(F.col("doc_id") % 17 == 0, "Author's Note")
        .when(F.col("doc_id") % 23 == 0, "Preface")
        .otherwise(F.concat(F.lit("Chapter "), (F.col("section_index") + 1).cast("string")))
    )
    return docs.select("novel", index, "doc_id").withColumn("title", title)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_keys(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def novels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(novel, uuid, title, series_id, book_order): every seventh novel stands alone, others come in fives."""
    n = table(spark, sf_dir, "documents").select(novel_of(F.col("doc_id")).alias("novel")).distinct()
    alone = F.col("novel") % 7 == 0
    return n.select(
        "novel",
        F.concat(F.lit("uuid-"), F.col("novel").cast("string")).alias("uuid"),
        F.concat(F.lit("Novel "), F.col("novel").cast("string")).alias("title"),
        F.when(~alone, F.floor(F.col("novel") / 5)).cast("int").alias("series_id"),
        F.when(~alone, F.col("novel") % 5 + 1).cast("int").alias("book_order"),
    )


def dialogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn of a conversation; roles speak, emotions go by the turn's number."""
    emotions = ["happy", "angry", "sad", "fearful", "warm", "serious", "whisper", "mysterious", "bogus"]
    intensities = ["low", "med", "high"]
    turns = table(spark, sf_dir, "conversations")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("turn") % k + 1).cast("int"))
    order = Window.partitionBy("novel").orderBy("conv_id", "turn")
    return turns.select(
        F.floor(F.col("conv_id") / 20).cast("int").alias("novel"),
        (F.col("conv_id") % 20).cast("int").alias("section_index"),
        "conv_id",
        "turn",
        F.col("role").alias("speaker_name"),
        pick(emotions, 9).alias("emotion"),
        pick(intensities, 3).alias("intensity"),
        F.col("text").alias("original_text"),
    ).withColumn("sequence_number", (F.row_number().over(order) - 1).cast("int"))


def _k(props: str = "props") -> Column:
    return F.coalesce(F.get_json_object(props, "$.k").cast("int"), F.lit(0))


def novel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'error'")
        .select(
            "event_id",
            (F.col("user_id") % 20).cast("int").alias("novel"),
            (k % 5).cast("int").alias("section_index"),
            (F.col("event_id") % 100).cast("int").alias("sequence_number"),
            (k % 11).cast("int").alias("spoiler_level"),
        )
    )


def character_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("character_id"),
        (F.col("user_id") % 20).cast("int").alias("novel"),
        _k().alias("section_index"),
        F.col("event_type").alias("status"),
    )


def reader_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("reader_id"),
        (F.col("event_id") % 20).cast("int").alias("novel"),
        _k().alias("section_index"),
        "event_type",
        "ts",
    )


def progress(events: DataFrame) -> DataFrame:
    """Latest section per (reader, novel): the last view wins, by time and then id."""
    return (
        events.filter("event_type = 'view'")
        .groupBy("reader_id", "novel")
        .agg(F.max_by("section_index", F.struct("ts", "event_id")).alias("section_index"), F.max("ts").alias("updated_at"))
    )


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = ["child", "teen", "young", "young_adult", "adult", "middle_aged", "elderly", "unknown"]
    roles = ["protagonist", "deuteragonist", "antagonist", "major", "minor", "minor"]
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % k + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("character_id"),
        F.floor(F.col("c_custkey") / 50).cast("int").alias("novel"),
        F.col("c_name").alias("name"),
        F.array(F.lower("c_name"), F.col("c_mktsegment")).alias("aliases"),
        pick(["male", "female", "unknown"], 3).alias("gender"),
        pick(ages, 8).alias("age_range"),
        pick(roles, 6).alias("role"),
    )


def large_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``characters``, with narrators, catch-all voices, unlisted roles and a gender that no actor has."""
    genders = ["male", "female", "unknown", "other", "male"]
    roles = ["protagonist", "narrator", "antagonist", "misc_voice", "minor", "deuteragonist", "extra", "major", "minor"]
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("character_id") % k + 1).cast("int"))
    return characters(spark, sf_dir).withColumns({"gender": pick(genders, 5), "role": pick(roles, 9)})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk"),
        F.col("label").cast("int").alias("chapter_index"),
        (F.col("vec_id") % 3 + 1).cast("int").alias("novel_number"),
        (F.col("vec_id") % 5).cast("int").alias("series_key"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat_ws("-", F.col("vec_id") % 5, F.col("vec_id") % 3 + 1).alias("novel_uuid"),
    )


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks, as a reader at its own chapter of book 2."""
    return chunks(spark, sf_dir).filter("chunk % 50 = 0").select(
        F.col("chunk").alias("query"),
        F.col("chapter_index").alias("current_chapter"),
        F.lit(2).alias("novel_number_now"),
        "series_key",
        F.concat_ws("-", "series_key", F.lit(2)).alias("novel_uuid"),
        F.col("embedding").alias("query_embedding"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, text, embedding, speakers, novel_uuid, series_key, novel_number, chapter_index): every document is a passage.

    Its place is that of its section, its speakers those of the section's lines; not every passage has a vector.
    """
    places = section_keys(spark, sf_dir).join(
        library.series_resolution(novels(spark, sf_dir)).join(novels(spark, sf_dir).select("novel", F.col("uuid").alias("novel_uuid")), "novel"), "novel"
    )
    names = dialogue_entries(spark, sf_dir).groupBy("novel", "section_index").agg(F.collect_set("speaker_name").alias("speakers"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = places.join(names, ["novel", "section_index"], "left").join(vectors, "doc_id", "left").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("chunk"), "text", "embedding", "speakers", "novel_uuid", "series_key", "novel_number", F.col("section_index").alias("chapter_index")
    )


def passage_readers(passages: DataFrame) -> DataFrame:
    """Every fiftieth passage asks, as a reader in the middle of its book: (query, text, gate, query_embedding)."""
    at = F.col("chunk") / 50
    return passages.filter("chunk % 50 = 0").select(
        F.col("chunk").alias("query"), "text", "series_key", "novel_uuid", F.col("novel_number").alias("novel_number_now"),
        F.pmod(F.floor(at) * 7, F.lit(50)).cast("int").alias("current_chapter"), F.col("embedding").alias("query_embedding"),
    )


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, text) of whole text files; bad bytes become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).alias("suffix"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def supported_books(files: DataFrame, suffixes: tuple[str, ...] = (".txt", ".epub", ".pdf", ".html")) -> tuple[DataFrame, DataFrame]:
    """Files of a known format, and the rejected rest."""
    known = F.col("suffix").isin(*suffixes)
    return files.filter(known), files.filter(~known)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df so that only the partitions it holds are replaced; runs again with the same result."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def rewrite_index(chunks: DataFrame, path: str) -> None:
    """Index write: the chunks of each novel of ``chunks`` replace those stored, in order of their serials."""
    replace_partitions(chunks.repartition("novel_uuid").sortWithinPartitions("novel_uuid", "chunk_serial"), path, "novel_uuid")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``write_together``: rows of all runs whose marker was written, with their ``run``."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/run=*/{name}").withColumn("run", F.col("run").cast("string"))
    runs = spark.read.schema("run_id string").json(f"{folder}/run=*/_published/").select(F.col("run_id").alias("run")).distinct()
    return rows.join(runs, "run", "left_semi")


def write_together(frames: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Writes several tables under one run; the marker that publishes the run comes last."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/run={run_id}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").json(f"{folder}/run={run_id}/_published")
