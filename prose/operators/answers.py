"""From sections and a model's answers to stored rows: entries, profiles, events and progress of a novel in one job.

Sections, their answers and their novel's names meet in one exchange by (novel, section_index). Everything after it is
row-local or a window or an aggregate on that partitioning, so nothing is shuffled again. Only small rows are exchanged by novel before:
counts of blocks, first blocks of the next section, and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import entries, segment

SECTION = ["novel", "section_index"]
#: Characters of context before a line's section or chunk, and after it.
AHEAD_CHARS, AFTER_CHARS, FIRST_BLOCKS = 500, 200, 3


def parsed_sections(sections: DataFrame, non_story: DataFrame | None = None) -> DataFrame:
    """(novel, section_index, apart, blocks, chunks) of sections (novel, section_index, title, text).

    A section is apart from the story by its title, or if ``non_story`` (novel, section_index) lists it. A null text has no blocks.
    """
    rows = sections.select(*SECTION, T.is_front_matter(F.col("title")).alias("apart"), segment.text_blocks(F.coalesce("text", F.lit(""))).alias("blocks"))
    rows = rows.withColumn("chunks", segment.request_chunks(F.col("blocks")))
    if non_story is None:
        return rows
    told = non_story.select(*SECTION).distinct().withColumn("_told", F.lit(True))
    return rows.join(told, SECTION, "left").withColumn("apart", F.col("apart") | F.col("_told").isNotNull()).drop("_told")


def placed_sections(parsed: DataFrame) -> DataFrame:
    """(novel, section_index, start, next_head, last_chunk): the first number of a section's blocks, the next section's first blocks and the last chunk before it, as requests show them."""
    novel = Window.partitionBy("novel").orderBy("section_index")
    head = F.substring(segment.rendered(F.slice("blocks", 1, FIRST_BLOCKS)), 1, AHEAD_CHARS)
    tail = segment.rendered(_blocks_of(F.element_at("chunks", -1)))
    small = parsed.select(*SECTION, F.size("blocks").cast("long").alias("n"), head.alias("_head"), F.when(F.size("chunks") > 0, tail).alias("_tail"))
    start = F.coalesce(F.sum("n").over(novel.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.lit("")
    return small.select(*SECTION, start.alias("start"), F.coalesce(F.lead("_head").over(novel), none).alias("next_head"), F.coalesce(F.lag("_tail").over(novel), none).alias("last_chunk"))


def _blocks_of(chunk: Column) -> Column:
    return F.slice("blocks", chunk["first"] + 1, chunk["blocks"])


def names_of(lookup: DataFrame) -> DataFrame:
    """(novel, names): a novel's map from label to (id, name), of ``cast.label_lookup``."""
    pair = F.struct("key", F.struct(F.col("character_id").alias("id"), F.col("speaker").alias("name")).alias("who"))
    return lookup.groupBy("novel").agg(F.map_from_entries(F.collect_list(pair)).alias("names"))


def _known(label: Column) -> Column:
    clean = F.trim(label)
    return F.coalesce(F.try_element_at("names", clean), F.try_element_at("names", F.lower(clean)))


def _ids(labels: Column) -> Column:
    found = F.transform(F.coalesce(labels, F.expr("cast(array() as array<string>)")), lambda x: _known(x)["id"])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def picked(blocks: Column, lines: Column) -> Column:
    """For every block the place of its line: the best above 0.3 that no block before took, the first of equals."""
    said = lambda x: T.strip(F.coalesce(F.nullif(x["original_text"], F.lit("")), x["raw_text"], F.lit("")))

    def step(done: Column, block: Column) -> Column:
        scored = F.transform(lines, lambda x, k: F.struct(F.round(T.overlap_score(block["text"], said(x)), 6).alias("score"), (-k).alias("k")))
        best = F.array_max(F.filter(scored, lambda s: (s["score"] > 0.3) & ~F.array_contains(done, -s["k"])))
        return F.concat(done, F.array(F.coalesce(-best["k"], F.lit(-1))))

    return F.aggregate(blocks, F.expr("cast(array() as array<int>)"), step)


def chunk_rows(parsed: DataFrame, answers: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per chunk with its blocks, answer, names and neighbours; answers (novel, section_index, chunk, raw)."""
    read = entries.read_answers(answers.select(*SECTION, "chunk", "raw"), "raw", entries.CHUNK_SCHEMA).filter("answer is not null")
    told = read.groupBy(*SECTION).agg(F.collect_list(F.struct("chunk", "answer")).alias("_answers"))
    beside = placed_sections(parsed).join(names_of(lookup), "novel", "left").withColumn("names", F.coalesce("names", F.expr("cast(map() as map<string, struct<id: bigint, name: string>>)")))
    met = parsed.join(told, SECTION, "left").join(beside, SECTION)
    rows = met.select("*", F.posexplode("chunks").alias("chunk", "c"))
    number = F.col("chunk")
    answer = F.get(F.filter("_answers", lambda a: a["chunk"] == number), F.lit(0))["answer"]
    part = _blocks_of(F.col("c"))
    following = F.get("chunks", number + 1)
    ahead = F.when(following.isNotNull(), segment.rendered(_blocks_of(following))).otherwise(F.col("next_head"))
    spoken = F.exists(part, lambda b: b["block_type"] == "dialogue")
    rows = rows.select(
        *SECTION, "apart", "start", "names", "chunk", F.col("c.first").alias("first"), part.alias("part"), ahead.alias("ahead"), answer.alias("answer"), spoken.alias("spoken")
    )
    branch = F.when(F.col("apart"), "front").when(~F.col("spoken"), "deterministic").when(F.col("answer").isNull(), "failed").otherwise("answered")
    return rows.withColumn("branch", branch)


def entry_rows(chunks: DataFrame) -> DataFrame:
    """One entry per block of ``chunk_rows``: speaker, emotion, tags, associated characters, contexts, confidence."""
    lines = F.when(F.col("branch") == "answered", F.col("answer.entries"))
    rows = chunks.withColumn("lines", F.coalesce(lines, F.expr("cast(null as array<struct<entry_type: string, speaker: string, emotion: string, emotion_intensity: string, raw_text: string, original_text: string, associated_characters: array<string>, confidence: double>>)")))
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumn("picks", F.when(F.col("lines").isNotNull(), picked(F.col("part"), F.col("lines"))).otherwise(none))
    rows = rows.select(*SECTION, "branch", "start", "names", "chunk", "first", "ahead", "lines", F.posexplode(F.arrays_zip("part", "picks")).alias("at", "x"))
    line = F.when(F.col("x.picks") >= 0, F.get("lines", F.col("x.picks")))
    rows = rows.withColumns({"line": F.when(line.isNotNull(), entries.with_defaults(line, entries.LINE)), "text": F.col("x.part.text"), "entry_type": F.col("x.part.block_type")})
    matched = F.col("line").isNotNull()
    narrated = F.when(F.col("branch") == "front", "MISC_VOICE").when(F.col("entry_type").isin("narration", "thought", "action"), "NARRATOR").otherwise("MISC_VOICE")
    nobody = F.struct(F.lit(None).cast("long").alias("id"), F.lit("UNKNOWN").alias("name"))
    who = F.coalesce(F.when(matched, _known(F.col("line.speaker"))), F.try_element_at("names", narrated), F.try_element_at("names", F.lit("UNKNOWN")), nobody)
    emotion, intensity = T.snap_emotion(F.col("line.emotion"), F.col("line.emotion_intensity"))
    rows = rows.select(
        *SECTION, (F.col("start") + F.col("first") + F.col("at")).alias("sequence_number"), "chunk", "entry_type",
        F.when(F.col("branch") != "answered", F.col("branch")).when(matched, "matched").otherwise("unmatched").alias("branch"),
        F.col("text").alias("original_text"), T.tag_prefixed(F.col("line.raw_text"), F.col("text")).alias("raw_text"), who.alias("who"),
        emotion.alias("emotion"), intensity.alias("emotion_intensity"), F.when(matched, _ids(F.col("line.associated_characters"))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("associated_characters"),
        F.when(matched, entries.confidence(F.col("line.confidence"))).when(F.col("branch").isin("front", "deterministic"), 1.0).otherwise(0.0).alias("confidence"), "ahead",
    )
    # The two matched lines before a line: each matched line carries the one before it, so no list is collected.
    order = Window.partitionBy(*SECTION).orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(F.col("branch") == "matched", T.history_line(F.col("who.name"), F.col("emotion"), F.col("emotion_intensity"), F.col("raw_text")))
    rows = rows.withColumn("_line", shown)
    rows = rows.withColumn("_two", F.when(shown.isNotNull(), F.struct(F.last("_line", ignorenulls=True).over(order).alias("a"), F.col("_line").alias("b"))))
    rows = rows.withColumn("_before", F.last("_two", ignorenulls=True).over(order))
    story = F.col("branch") != "front"
    return rows.select(
        *SECTION, "sequence_number", "chunk", "entry_type", "branch", "raw_text", "original_text", F.col("who.id").alias("speaker_id"), F.col("who.name").alias("speaker_name"),
        "emotion", "emotion_intensity", "associated_characters", F.when(story, F.concat_ws("\n", "_before.a", "_before.b")).otherwise("").alias("context_before"),
        F.when(story, F.substring("ahead", 1, AFTER_CHARS)).otherwise("").alias("context_after"), "confidence",
    )


def profile_rows(chunks: DataFrame) -> DataFrame:
    """(novel, section_index, character_id, status, summary, ...): the last update of each known character in a section."""
    rows = chunks.filter("branch = 'answered'").select(*SECTION, "names", "chunk", F.posexplode("answer.profile_updates").alias("at", "u"))
    named = rows.withColumn("character_id", _known(F.col("u.character_name"))["id"]).filter("character_id is not null")
    last = named.groupBy(*SECTION, "character_id").agg(F.max_by("u", F.struct("chunk", "at")).alias("u"))
    return last.select(*SECTION, "character_id", F.lit("update").alias("profile_type"), "u.emotional_state", "u.relationships", "u.knowledge", "u.status", "u.summary")


def event_rows(chunks: DataFrame) -> DataFrame:
    """Events numbered on from the last block of their chunk, with the ids of the characters they name; where numbers meet the later chunk's stays."""
    rows = chunks.filter("branch = 'answered'").select(*SECTION, "names", "chunk", (F.col("start") + F.col("first") + F.size("part")).alias("_after"), F.posexplode("answer.events").alias("at", "e"))
    told = rows.select(*SECTION, "chunk", (F.col("_after") + F.col("at")).alias("sequence_number"), "e", _ids(F.col("e.characters_involved")).alias("involved"), _ids(F.col("e.speakers")).alias("by"))
    best = told.groupBy(*SECTION, "sequence_number").agg(F.max_by(F.struct("e", "involved", "by"), "chunk").alias("x"))
    return best.select(
        *SECTION, "sequence_number", "x.e.event_type", "x.e.summary", F.col("x.involved").alias("characters_involved"), F.col("x.by").alias("speakers"), "x.e.importance", "x.e.spoiler_level"
    )


def progress_rows(chunks: DataFrame) -> DataFrame:
    """(novel, section_index, chunks, entries, failed) of every section with text."""
    return chunks.groupBy(*SECTION).agg(F.count("*").alias("chunks"), F.sum(F.size("part")).alias("entries"), F.count_if(F.col("branch") == "failed").alias("failed"))


def section_tables(parsed: DataFrame, answers: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a parse, for ``sources.tables.write_together``."""
    chunks = chunk_rows(parsed, answers, lookup)
    return {"dialogue_entries": entry_rows(chunks), "character_profiles": profile_rows(chunks), "novel_events": event_rows(chunks), "parse_progress": progress_rows(chunks)}
