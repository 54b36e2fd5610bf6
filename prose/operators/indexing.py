"""The index of a library in one job: chunks with their attribution, ids and order, from sections and a parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import enrich, requests, segment

KEYS = ["novel", "section_index"]
#: Fixed value: the namespace of chunk ids.
NAMESPACE = "b6f1e3a20c4d4e6f8a1b2c3d4e5f6a7b"


def chunk_table(sections: DataFrame, size: int = segment.CHUNK_WORDS, overlap: int = segment.OVERLAP_WORDS, measure: segment.Measure = segment._words) -> DataFrame:
    """(novel, section_index, title, chunk, chunk_serial, char_start, char_end, text) of sections (novel, section_index, title, text)."""
    named = sections.select(*KEYS, "title", "text", (F.col("novel").cast("long") * (1 << 32) + F.col("section_index")).alias("_key"))
    spans = segment.retrieval_spans(named.select("_key", "text"), "_key", size, overlap, measure)
    rows = named.join(spans.filter(F.size("chunks") > 0), "_key").drop("_key")
    starts = segment.sequence_starts(rows.select(*KEYS, F.size("chunks").cast("long").alias("n"))).select(*KEYS, "start")
    placed = rows.join(starts, KEYS).select(*KEYS, "title", "text", "start", F.posexplode("chunks").alias("chunk", "c"))
    body = F.substring(F.col("text"), F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start"))
    return placed.select(
        *KEYS, "title", "chunk", (F.col("start") + F.col("chunk")).alias("chunk_serial"), F.col("c.char_start").cast("int").alias("char_start"), F.col("c.char_end").cast("int").alias("char_end"), body.alias("text")
    )


def placed_entries(sections: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries (novel, section_index, sequence_number, original_text, raw_text, ...) with the ``chunk`` that holds their text, or is nearest to where it should be."""
    said = F.coalesce(F.nullif("original_text", F.lit("")), F.col("raw_text"))
    lists = entries.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("sequence_number", said.alias("said")))).alias("x"))
    chapters = lists.join(sections.select(*KEYS, "text"), KEYS).select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), F.col("x.said").alias("needles"), F.col("x.sequence_number").alias("numbers"))
    found = requests.located(chapters).select(*KEYS, F.explode(F.arrays_zip("numbers", "positions")).alias("p"))
    at = found.select(*KEYS, F.col("p.numbers").alias("entry"), F.col("p.positions").alias("pos"))
    held = enrich.chunk_of_position(at, chunks.select(*KEYS, "chunk", "char_start", "char_end"), KEYS)
    return entries.join(held.select(*KEYS, F.col("entry").alias("sequence_number"), "chunk"), [*KEYS, "sequence_number"])


def index_rows(sections: DataFrame, entries: DataFrame, events: DataFrame, characters: DataFrame, books: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per chunk of ``chunk_table``, ready for ``sources.tables.rewrite_index``.

    entries (novel, section_index, sequence_number, original_text, raw_text, speaker_name, associated), events (novel,
    section_index, event_id, sequence_number, spoiler_level), characters (character_id, name), books (novel, novel_uuid, series_key,
    novel_number). Speakers and associated characters stand in the order in which a chunk first names them; events belong to the chunk
    of the last entry at or before them, else to the chapter's first. A chapter without entries has empty lists.
    """
    placed = placed_entries(sections, entries, chunks)
    speaks = placed.filter("speaker_name <> ''").groupBy(*KEYS, "chunk", "speaker_name").agg(F.min("sequence_number").alias("s"))
    speakers = speaks.groupBy(*KEYS, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "speaker_name"))), lambda x: x["speaker_name"]).alias("speakers"))
    names = enrich.associated_names(placed.select(*KEYS, "chunk", "sequence_number", F.col("associated").alias("ids")), characters.select("character_id", "name"), KEYS)
    told = enrich.events_of_chunks(events, placed.select(*KEYS, "sequence_number", "chunk"), chunks, KEYS)
    out = chunks.join(speakers, [*KEYS, "chunk"], "left").join(names, [*KEYS, "chunk"], "left").join(told, [*KEYS, "chunk"]).join(books, "novel")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        "novel_uuid", "series_key", "novel_number", F.col("section_index").alias("chapter_index"), F.col("title").alias("chapter_title"), "chunk_serial",
        F.col("chunk").alias("chunk_index_in_chapter"), "char_start", "char_end", "text", F.coalesce("speakers", none).alias("speakers"), F.coalesce("names", none).alias("associated_characters"),
        "event_ids", "max_spoiler_level", T.uuid5(NAMESPACE, F.concat_ws(":", "novel_uuid", "chunk_serial")).alias("id"),
    )
