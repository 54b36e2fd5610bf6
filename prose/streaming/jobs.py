"""Structured Streaming forms of the library's updates; each ends in the state of its batch operator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators import segment


def feed(spark: SparkSession, sf_dir: str, table: str, files: int = 16) -> DataFrame:
    """A file stream over a table: the folder of its files as they arrive, or a table's single file alone."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # A source is a folder, so a single file is picked out of its folder by its whole name.
    return source.parquet(path) if folder else source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def finished(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there and returns its rows, written to ``folder``, which driver and executors share.

    In append mode the file sink takes them. In update mode every batch writes the rows of the keys that it changed, and no others,
    under its number: what it writes does not grow with the state, a batch that runs twice leaves one result, and ``last_states``
    takes each key's last row. In complete mode a batch holds all keys, and the last batch is the state; no job here needs it.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/rows")
    else:
        query = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")).start()
    query.awaitTermination()
    spark = df.sparkSession
    schema = df.schema if mode == "append" else df.schema.add("batch", "long")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema if mode == "update" else df.schema)
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("_last"))
        return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")
    return rows


def last_states(rows: DataFrame, *keys: str) -> DataFrame:
    """The state of every key after the last batch that changed it."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def folded_states(spark: SparkSession, folder: str, keys: list[str], schema: str, parts: int = 16) -> DataFrame:
    """The state of an update-mode stream as a table that is kept up: (schema) without ``batch``.

    A separate job beside the stream. Batches that came since it last ran are folded into the partitions of the state table that their keys
    fall into; partitions that no key touches stay as they are. The table carries the number of the last batch folded into each row,
    so a run that was killed while it wrote partitions can run again: a row is never replaced by an older one.
    """
    from ..sources.tables import replace_partitions

    table, done = f"{folder}/state", f"{folder}/folded"
    exists = lambda path: (t := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(t)
    upto = spark.read.schema("upto long").parquet(done).agg(F.max("upto")).first()[0] if exists(done) else -1
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    new = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows").filter(F.col("batch") > upto)
    last = new.agg(F.max("batch")).first()[0]
    if last is not None:
        new = new.select("*", part)
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
        old = spark.read.schema(f"{schema}, batch long, part int").parquet(table).filter(F.col("part").isin(touched)) if exists(table) else new.limit(0)
        rest = [c for c in new.columns if c not in (*keys, "part")]
        best = old.unionByName(new).groupBy(*keys, "part").agg(F.max_by(F.struct(*rest), "batch").alias("_x"))
        merged = best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest], "part")
        # Partitions are read and replaced, so what replaces them is written beside them first.
        merged.write.mode("overwrite").parquet(f"{folder}/next")
        replace_partitions(spark.read.schema(merged.schema).parquet(f"{folder}/next").repartition("part"), table, "part")
        spark.createDataFrame([(last,)], "upto long").write.mode("append").parquet(done)
    return spark.read.schema(f"{schema}, batch long, part int").parquet(table).drop("batch", "part")


def _k():
    return F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))


def latest_progress(events: DataFrame) -> DataFrame:
    """(reader_id, novel, section_index): the last view wins."""
    views = events.filter("event_type = 'view'").select(
        F.col("user_id").alias("reader_id"), (F.col("event_id") % 20).cast("int").alias("novel"), _k().alias("section_index"), "ts", "event_id"
    )
    return views.groupBy("reader_id", "novel").agg(F.max_by("section_index", F.struct("ts", "event_id")).alias("section_index"))


def toggles(events: DataFrame) -> DataFrame:
    """(novel, starred, archived, completed_at): parities of toggles; completed at the last one if archived."""
    rows = events.filter("event_type in ('purchase', 'signup')").withColumn("novel", (F.col("event_id") % 20).cast("int"))
    archive = F.count_if(F.col("event_type") == "signup")
    return rows.groupBy("novel").agg(
        (F.count_if(F.col("event_type") == "purchase") % 2 == 1).alias("starred"),
        (archive % 2 == 1).alias("archived"),
        F.when(archive % 2 == 1, F.max(F.when(F.col("event_type") == "signup", F.col("ts")))).alias("completed_at"),
    )


def chat_state(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, tokens, due): two sums per session, kept as the state of a streaming aggregate."""
    return messages_with_summary_due(messages)


def blocks(sections: DataFrame) -> DataFrame:
    """New sections to block counts; stateless, so any sink takes it in append mode."""
    return sections.select("doc_id", F.size(segment.text_blocks(F.coalesce("text", F.lit("")))).cast("long").alias("blocks"))


def finished_sections(events: DataFrame) -> DataFrame:
    """(novel, finished): different finished sections, in any order of arrival; the state is one row per section."""
    rows = events.filter("event_type = 'click'").select((F.col("event_id") % 20).cast("int").alias("novel"), _k().alias("section_index"))
    once = rows.dropDuplicates(["novel", "section_index"])
    return once.groupBy("novel").agg(F.count("*").alias("finished"))


def seen_sections(events: DataFrame) -> DataFrame:
    """(novel, section_index) once each, as the first event of a section arrives; counts of them are a batch aggregate of few rows."""
    rows = events.filter("event_type = 'click'").select((F.col("event_id") % 20).cast("int").alias("novel"), _k().alias("section_index"))
    return rows.dropDuplicates(["novel", "section_index"])


def windowed_activity(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by day and type. In update or append mode a window's state goes once the watermark has passed it, and events that come later
    than ``delay`` are left out; over files in any order ``delay`` is the span of the files."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def messages_with_summary_due(messages: DataFrame) -> DataFrame:
    """Batch form of ``chat_state``."""
    tokens = F.sum(T.est_tokens(F.coalesce("text", F.lit(""))))
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), tokens.alias("tokens"), ((tokens > 2500) & (F.count("*") > 8)).alias("due"))


class Compaction(StatefulProcessor):
    """A session's open messages and the last id folded away; a session that is silent for ``silence`` is forgotten.

    After every message, open messages over the budget of tokens, all but the last ``keep``, are folded into a transcript.
    """

    def __init__(self, budget: int, keep: int, silence_ms: int):
        self.budget, self.keep, self.silence_ms = budget, keep, silence_ms

    def init(self, handle) -> None:
        ttl = {"ttlDurationMs": self.silence_ms} if self.silence_ms else {}
        self.open = handle.getListState("open", "id long, line string, tokens long", **ttl)
        self.mark = handle.getValueState("mark", "id long", **ttl)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        mark = self.mark.get()[0] if self.mark.exists() else None
        total, folds = sum(t for _, _, t in held), []
        for r in sorted(rows, key=lambda r: r.id):
            upto = mark if mark is not None else r.summary_upto
            if upto is not None and r.id <= upto:
                continue
            held.append((r.id, r.line, r.tokens))
            total += r.tokens
            if total > self.budget and len(held) > self.keep:
                fold, held = held[: -self.keep], held[-self.keep :]
                mark, total = fold[-1][0], sum(t for _, _, t in held)
                folds.append(Row(session=key[0], watermark=mark, folded=len(fold), transcript="\n".join(line for _, line, _ in fold)))
        self.open.put([tuple(x) for x in held]) if held else self.open.clear()
        if mark is not None:
            self.mark.update((mark,))
        yield from folds

    def close(self) -> None:
        pass


def compactions(messages: DataFrame, budget: int = 2500, keep: int = 8, silence_ms: int = 0) -> DataFrame:
    """(session, watermark, folded, transcript): every fold of a stream of messages (session, id, role, content, summary_upto), as it falls due.

    Messages of a session come in order of their ids from batch to batch; within a batch in any order. The result is that of one message
    after another, however they are split into batches. Needs the RocksDB state store.
    """
    line = F.concat(F.when(F.col("role") == "character", "You").otherwise("User"), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = messages.select("session", F.col("id").cast("long").alias("id"), line.alias("line"), T.est_tokens(F.coalesce("content", F.lit(""))).cast("long").alias("tokens"), F.col("summary_upto").cast("long").alias("summary_upto"))
    return rows.groupBy("session").transformWithState(
        statefulProcessor=Compaction(budget, keep, silence_ms), outputStructType="session long, watermark long, folded long, transcript string",
        outputMode="Append",
        # Times to live need a clock, with which a stream that takes what is available never ends by itself.
        timeMode="ProcessingTime" if silence_ms else "None",
    )


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which lists and times to live need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, own)
