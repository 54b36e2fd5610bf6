"""Joins of text coordinates: range join, as-of join, enrichment of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Characters of a bin of positions.
BIN = 4096


def chunk_of_position(entries: DataFrame, chunks: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Adds ``chunk`` to entries (keys, entry, pos): the first chunk [char_start, char_end) that holds it, else the nearest start, the first of equals.

    A position meets the chunks of its bin alone. The nearest starts on both sides come from a running window over starts and
    positions in order, so a chapter of any length makes no pairs. Entries of a chapter without chunks go.
    """
    bins = F.sequence(F.floor(F.col("char_start") / width), F.floor(F.greatest(F.col("char_end") - 1, F.col("char_start")) / width))
    spans = chunks.select(*keys, F.col("chunk").alias("_c"), "char_start", "char_end", F.explode(bins).alias("_bin"))
    at = entries.select(*keys, "entry", "pos").withColumn("_bin", F.floor(F.col("pos") / width))
    held = at.join(spans, [*keys, "_bin"]).filter("pos >= char_start and pos < char_end").groupBy(*keys, "entry", "pos").agg(F.min("_c").alias("_in"))
    starts = chunks.groupBy(*keys, F.col("char_start").alias("pos")).agg(F.min("chunk").alias("_c"))
    both = starts.select(*keys, "pos", F.struct(F.col("pos").alias("at"), F.col("_c").alias("chunk")).alias("_s")).unionByName(
        entries.select(*keys, "entry", "pos"), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.last("_s", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_before": before, "_after": after}).filter("_s is null")
    away = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("pos") - F.col(f"{s}.at")).alias("far"), F.col(f"{s}.chunk").alias("chunk")))
    near = near.select(*keys, "entry", "pos", F.least(away("_before"), away("_after")).alias("_near"))
    out = near.join(held, [*keys, "entry", "pos"], "left").withColumn("chunk", F.coalesce("_in", "_near.chunk")).filter("chunk is not null")
    return out.groupBy(*keys, "entry", "pos").agg(F.first("chunk").alias("chunk"))


def as_of(events: DataFrame, entries: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds to events the ``value`` of the last entry at or before them, by a union and one running window; no pairs."""
    last = entries.groupBy(*keys, at).agg(F.max(value).alias(value))
    both = last.withColumn("_event", F.lit(None).cast("long")).unionByName(
        events.select(*keys, at, F.col("event_id").alias("_event")).withColumn(value, F.lit(None).cast(entries.schema[value].dataType))
    )
    order = Window.partitionBy(*keys).orderBy(at, F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(order)).filter("_event is not null")
    return filled.withColumnRenamed("_event", "event_id")


def events_of_chunks(events: DataFrame, placed: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, event_ids, max_spoiler_level): events in the chunk of the last entry at or before them, else in the first chunk.

    placed (keys, sequence_number, chunk) are the entries with their chunk, events (keys, event_id,
    sequence_number, spoiler_level); chunks without events have none and level 0.
    """
    at = as_of(events, placed, keys, "sequence_number", "chunk").select("event_id", F.col("chunk").alias("_chunk"))
    first = chunks.groupBy(*keys).agg(F.min("chunk").alias("_first"))
    owned = events.join(at, "event_id").join(first, keys).withColumn("chunk", F.coalesce("_chunk", "_first"))
    per = owned.groupBy(*keys, "chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sequence_number", "event_id"))), lambda x: x["event_id"]).alias("event_ids"),
        F.max(F.coalesce("spoiler_level", F.lit(0))).alias("max_spoiler_level"),
    )
    return chunks.select(*keys, "chunk").distinct().join(per, [*keys, "chunk"], "left").select(
        *keys, "chunk", F.coalesce("event_ids", F.expr("cast(array() as array<bigint>)")).alias("event_ids"), F.coalesce("max_spoiler_level", F.lit(0)).alias("max_spoiler_level")
    )


def associated_names(placed: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, names): distinct names of associated characters in first-seen order, from placed (keys, chunk, sequence_number, ids)."""
    seen = placed.select(*keys, "chunk", "sequence_number", F.posexplode("ids").alias("at", "character_id")).join(names, "character_id")
    first = seen.groupBy(*keys, "chunk", "name").agg(F.min(F.struct("sequence_number", "at")).alias("s"))
    return first.groupBy(*keys, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "name"))), lambda x: x["name"]).alias("names"))


def enriched(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct speakers per chunk in the order of their first line, from (keys, chunk, sequence_number, speaker_name)."""
    first = placed.groupBy(*keys, "chunk", "speaker_name").agg(F.min("sequence_number").alias("s"))
    return first.groupBy(*keys, "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "speaker_name"))), lambda x: x["speaker_name"]), ",").alias("speakers")
    )
