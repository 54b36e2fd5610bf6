"""Library questions: series, listings, progress, latest states and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def series_resolution(novels: DataFrame) -> DataFrame:
    """(novel, series_key, novel_number): the uuid of a series' first book, or a lone novel's own with number 1."""
    first = novels.filter("series_id is not null").groupBy("series_id").agg(F.min_by("uuid", "book_order").alias("first_uuid"))
    return novels.join(first, "series_id", "left").select(
        "novel", F.coalesce("first_uuid", "uuid").alias("series_key"), F.coalesce("book_order", F.lit(1)).alias("novel_number")
    )


def prior_characters(novels: DataFrame, characters: DataFrame) -> DataFrame:
    """(novel, character_id) of characters of earlier books of the same series."""
    books = novels.filter("series_id is not null").select("series_id", "book_order", "novel")
    earlier = books.select("series_id", F.col("book_order").alias("prior"), F.col("novel").alias("prior_novel"))
    pairs = books.join(earlier, "series_id").filter("prior < book_order").select("novel", "prior_novel")
    return pairs.join(characters.select(F.col("novel").alias("prior_novel"), "character_id"), "prior_novel").select("novel", "character_id")


def latest_profiles(profiles: DataFrame, up_to: int) -> DataFrame:
    """Last profile of each character of a novel up to a section: pre-aggregated, no window."""
    seen = profiles.filter(F.col("section_index") <= up_to)
    best = seen.groupBy("novel", "character_id").agg(F.max(F.struct("section_index", "id", "status")).alias("x"))
    return best.select("novel", "character_id", "x.section_index", "x.id", "x.status")


def latest_profiles_of_series(profiles: DataFrame, novels: DataFrame, up_to_book: int) -> DataFrame:
    """Last profile of each character across a series up to a book."""
    books = novels.filter("series_id is not null").select("novel", "series_id", "book_order").filter(F.col("book_order") <= up_to_book)
    best = profiles.join(books, "novel").groupBy("series_id", "character_id")
    best = best.agg(F.max(F.struct("book_order", "section_index", "id", "status")).alias("x"))
    return best.select("series_id", "character_id", "x.book_order", "x.section_index", "x.id", "x.status")


def last_before(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group, oldest first by ``order``. Spark limits each task's groups to n before the shuffle."""
    newest = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    out = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    return out.drop("_n")


def percent_read(done, total):
    """Whole percent of sections read, of which ``done`` is the last; 0 without sections."""
    return F.when(total > 0, F.floor((done + 1) / total * 100)).otherwise(0).cast("long")


def shelf(novels: DataFrame, sections: DataFrame, progress: DataFrame, archived: bool = False) -> DataFrame:
    """Novels with the reader's section, number of sections and a preview of the first text; archived ones only if asked for.

    progress (novel, section_index, updated_at): the latest row per novel counts.
    """
    per = sections.groupBy("novel").agg(F.count("*").alias("section_count"), F.min_by("text", "section_index").alias("_first"))
    at = progress.groupBy("novel").agg(F.max(F.struct("updated_at", "section_index")).alias("_at"))
    shown = novels if archived else novels.filter("not archived")
    return shown.join(per, "novel", "left").join(at, "novel", "left").select(
        *novels.columns, F.coalesce("_at.section_index", F.lit(0)).alias("progress_section"), F.coalesce("section_count", F.lit(0)).alias("section_count"),
        T.preview(F.col("_first")).alias("preview"),
    )


def sections_with_novel(sections: DataFrame, novels: DataFrame) -> DataFrame:
    """Every section with its novel's title, author and status."""
    return sections.join(novels.select("novel", F.col("title").alias("novel_title"), "author", "status"), "novel")


def to_index(novels: DataFrame, sections: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Novels to index: all, or the wanted ones, that are parsed and have a section."""
    chosen = novels if wanted is None else novels.join(wanted.select("uuid").distinct(), "uuid", "left_semi")
    return chosen.filter("parse_status = 'complete'").join(sections.select("novel").distinct(), "novel", "left_semi")


def section_bounds(novels: DataFrame, entries: DataFrame) -> DataFrame:
    """(novel, last_section, last_sequence, finished): -1 where a novel has no entries."""
    per = entries.groupBy("novel").agg(
        F.max("section_index").alias("last_section"), F.max("sequence_number").alias("last_sequence"), F.sort_array(F.collect_set("section_index")).alias("finished")
    )
    none = F.lit(-1)
    return novels.select("novel").join(per, "novel", "left").select(
        "novel", F.coalesce("last_section", none).alias("last_section"), F.coalesce("last_sequence", none).alias("last_sequence"),
        F.coalesce("finished", F.expr("cast(array() as array<int>)")).alias("finished"),
    )


def listing(novels: DataFrame, sections: DataFrame) -> DataFrame:
    """Novels with their number of sections and the first section's title."""
    per = sections.groupBy("novel").agg(F.count("*").alias("sections"), F.min_by("title", "section_index").alias("first_title"))
    return novels.join(per, "novel", "left").select("novel", "title", F.coalesce("sections", F.lit(0)).alias("sections"), "first_title")


def reading_percent(progress: DataFrame, sections: DataFrame) -> DataFrame:
    total = sections.groupBy("novel").agg(F.count("*").alias("total"))
    return progress.join(total, "novel", "left").select(
        "reader_id", "novel", percent_read(F.col("section_index"), F.coalesce("total", F.lit(0))).alias("percent")
    )


def unfinished_sections(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """Sections without stored entries and with text."""
    return sections.filter(F.trim("text") != "").join(entries.select("novel", "section_index").distinct(), ["novel", "section_index"], "left_anti")


def first_appearance(entries: DataFrame) -> DataFrame:
    return entries.groupBy("novel", "speaker_name").agg(F.min("section_index").alias("first_section"))


def first_met(entries: DataFrame) -> DataFrame:
    """(novel, character_id, first_section) of entries (novel, section_index, speaker_id, associated): where a character first speaks or is named."""
    named = F.explode(F.concat(F.array("speaker_id"), F.coalesce("associated", F.expr("cast(array() as array<bigint>)")))).alias("character_id")
    return entries.select("novel", "section_index", named).filter("character_id is not null").groupBy("novel", "character_id").agg(F.min("section_index").alias("first_section"))


def recent_items(items: DataFrame, n: int = 20) -> DataFrame:
    """The newest n of every kind of items (novel, kind, created_at, id) of a novel: bookmarks, highlights, lookups."""
    return last_before(items, ["novel", "kind"], ["created_at", "id"], n)


def ordered_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """All bookmarks (novel, section_index, created_at, id) of a novel with their ``place``, by section and time."""
    order = Window.partitionBy("novel").orderBy("section_index", "created_at", "id")
    return bookmarks.withColumn("place", F.row_number().over(order))


def section_labels(items: DataFrame) -> DataFrame:
    """(novel, section_index, labels) of items (novel, section_index, id, label) in the order of their ids."""
    listed = F.sort_array(F.collect_list(F.struct("id", "label")))
    return items.groupBy("novel", "section_index").agg(F.transform(listed, lambda x: x["label"]).alias("labels"))


def parse_progress(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """Finished sections (stored or blank) of all, per novel."""
    done = entries.select("novel", "section_index").distinct().withColumn("done", F.lit(True))
    joined = sections.join(done, ["novel", "section_index"], "left")
    finished = F.coalesce("done", F.lit(False)) | (F.trim("text") == "")
    return joined.groupBy("novel").agg(F.count_if(finished).alias("finished"), F.count("*").alias("total"))


def novel_report(novels: DataFrame, characters: DataFrame, entries: DataFrame, events: DataFrame, profiles: DataFrame, first: int = 10) -> DataFrame:
    """(novel, characters, entries, events, profiles, first_entries): counts, and the numbers of the first entries."""
    named = (("characters", characters), ("entries", entries), ("events", events), ("profiles", profiles))
    out = novels.select("novel")
    for name, df in named:
        out = out.join(df.groupBy("novel").agg(F.count("*").alias(name)), "novel", "left")
    order = Window.partitionBy("novel").orderBy("sequence_number")
    top = entries.select("novel", "sequence_number").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first)
    listed = top.groupBy("novel").agg(F.sort_array(F.collect_list("sequence_number")).alias("first_entries"))
    return out.na.fill(0).join(listed, "novel", "left").withColumn("first_entries", F.coalesce("first_entries", F.expr("cast(array() as array<int>)")))


def resume_decision(status: DataFrame) -> DataFrame:
    """What to do with a novel: (novel, parse_status, pass1_done, saved) to ``decision``."""
    s = F.coalesce("parse_status", F.lit("none"))
    decision = (
        F.when(s.isin("none", "pending", "error"), "from_scratch")
        .when(s == "complete", "skip")
        .when((s == "pass1_running") | ~F.col("pass1_done"), F.when(F.col("saved") > 0, "resume_pass1").otherwise("from_scratch"))
        .otherwise("resume_pass2")
    )
    return status.select("novel", decision.alias("decision"))


def introduced(characters: DataFrame, progress: DataFrame) -> DataFrame:
    """Characters (novel, first_section) that a reader at progress (novel, section_index) has met; without a first section all have."""
    seen = F.col("first_section").isNull() | (F.col("first_section") <= F.coalesce("section_index", F.lit(0)))
    return characters.join(progress.select("novel", "section_index"), "novel", "left").filter(seen).drop("section_index")


def sidebar_order(characters: DataFrame, chats: DataFrame) -> DataFrame:
    """Characters by last chat, then role rank, then name, as ``place`` in their novel."""
    # Rank of roles in the sidebar; others come last.
    roles = ("protagonist", "deuteragonist", "antagonist", "major", "minor")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, roles)), F.col("role")), F.lit(0)), F.lit(9))
    people = characters.filter(~F.col("role").isin("narrator", "misc_voice")).join(chats, "character_id", "left")
    order = Window.partitionBy("novel").orderBy(F.col("last_message").desc_nulls_last(), rank, "name")
    return people.select("novel", "character_id", F.row_number().over(order).alias("place"))
