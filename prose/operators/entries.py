"""Model answers to rows: reading, alignment branches, profiles, events, chat requests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_DECODER = json.JSONDecoder()


def _first_object(text: str) -> dict | None:
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            return value
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _closed(text: str) -> str:
    """Truncated JSON with its open string and brackets closed."""
    open_, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            open_.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and open_ and open_[-1] == c:
            open_.pop()
    return text + '"' * quoted + "".join(reversed(open_))


def readable(answer: str) -> str | None:
    """JSON text of an answer that is no plain object: its first whole object, else its rest with what is open closed."""
    found = _first_object(answer)
    at = answer.find("{")
    if found is None and at >= 0:
        for text in (answer[at : answer.rfind("}") + 1], answer[at:].rstrip().removesuffix("```").rstrip()):
            try:
                found = json.loads(_closed(text)) if text else None
            except ValueError:
                continue
            if isinstance(found, dict):
                break
    return json.dumps(found) if isinstance(found, dict) else None


def read_answers(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds ``answer`` (struct of ``schema``) and ``how``: read, repaired or rejected.

    Built-ins read an answer that is an object once reasoning and fences are gone; only others go to the helper.
    """
    text = T.without_reasoning_blocks(F.col(raw))
    plain = F.regexp_extract(text, r"(?s)^(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?$", 1)
    typed = f"{schema}, _corrupt string"
    read = lambda c: F.from_json(c, typed, {"columnNameOfCorruptRecord": "_corrupt"})
    repair = F.pandas_udf(lambda s: s.map(readable, na_action="ignore"), "string", F.PandasUDFType.SCALAR)
    first = rows.withColumns({"_text": text, "_read": read(F.nullif(plain, F.lit("")))})
    good = F.col("_read").isNotNull() & F.col("_read._corrupt").isNull()
    fixed = first.withColumn("_ok", good).withColumn("_fixed", repair(F.when(~good, F.col("_text"))))
    out = fixed.withColumns(
        {
            "_answer": F.when(F.col("_ok"), F.col("_read")).otherwise(read(F.col("_fixed"))),
            "how": F.when(F.col("_ok"), "read").when(F.col("_fixed").isNotNull(), "repaired").otherwise("rejected"),
        }
    )
    return out.withColumn("answer", F.when(F.col("how") != "rejected", F.col("_answer").dropFields("_corrupt"))).drop("_text", "_read", "_ok", "_fixed", "_answer")


# Fields of an analysed line and of a chapter's characters, with their defaults.
LINE = {"entry_type": "dialogue", "speaker": "NARRATOR", "emotion": "neutral", "emotion_intensity": "low", "raw_text": "", "original_text": ""}
CHARACTER = {"gender": "unknown", "age_range": "unknown", "role_hint": "minor", "description": ""}
CHUNK_SCHEMA = (
    "entries array<struct<entry_type string, speaker string, emotion string, emotion_intensity string, raw_text string, original_text string, "
    "associated_characters array<string>, confidence double>>, "
    "profile_updates array<struct<character_name string, emotional_state string, relationships map<string,string>, knowledge array<string>, status string, summary string>>, "
    "events array<struct<event_type string, summary string, characters_involved array<string>, speakers array<string>, importance string, spoiler_level int>>"
)


_PERSON = "struct<name string, aliases array<string>, gender string, age_range string, role_hint string, description string>"
CHAPTER_SCHEMA = f"is_story_content boolean, new_characters array<{_PERSON}>, updated_characters array<{_PERSON}>, chapter_summary string"
CONSOLIDATION_SCHEMA = (
    "characters array<struct<name string, aliases array<string>, gender string, age_range string, role string, description string>>, "
    "narrator struct<narrator_type string, narrator_character_name string>"
)


def mentions(answers: DataFrame) -> DataFrame:
    """Mentions for ``cast.cast_versions`` of chapters' answers (novel, section_index, answer of CHAPTER_SCHEMA): new characters, then updates.

    A chapter that is no story tells of nobody; a chapter that does not say is story. Missing fields take their defaults, a character without a name goes.
    """
    told = answers.filter(F.col("answer").isNotNull() & F.coalesce("answer.is_story_content", F.lit(True)))
    people = lambda c: F.coalesce(F.col(f"answer.{c}"), F.expr(f"cast(array() as array<{_PERSON}>)"))
    new = F.transform(people("new_characters"), lambda x: F.struct(F.lit("new").alias("kind"), x.alias("x")))
    kinds = F.concat(new, F.transform(people("updated_characters"), lambda x: F.struct(F.lit("update").alias("kind"), x.alias("x"))))
    rows = told.select("novel", "section_index", F.posexplode(kinds).alias("place", "m")).filter("m.x.name is not null")
    x = with_defaults(F.col("m.x"), CHARACTER)
    return rows.withColumn("x", x).select(
        "novel", "section_index", "place", "m.kind", "x.name", F.coalesce("x.aliases", F.expr("cast(array() as array<string>)")).alias("aliases"), "x.gender", "x.age_range", F.col("x.role_hint").alias("role"), "x.description"
    )


def non_story(answers: DataFrame) -> DataFrame:
    """(novel, section_index) of chapters whose answer says that they are no story."""
    return answers.filter(~F.coalesce("answer.is_story_content", F.lit(True))).select("novel", "section_index")


def with_defaults(x: Column, defaults: dict[str, str]) -> Column:
    for name, value in defaults.items():
        x = x.withField(name, F.coalesce(x[name], F.lit(value)))
    return x


def confidence(value: Column) -> Column:
    """A confidence of nothing or 0 counts as one half."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(0.5))


_ENTRY = ("novel", "section_index", "sequence_number", "entry_type", "text", "branch", "speaker", "confidence")


def entry_table(blocks: DataFrame, non_story: DataFrame, failed: DataFrame, matched: DataFrame, lookup: DataFrame) -> DataFrame:
    """One entry per block (novel, section_index, sequence_number, chunk, entry_type, text), from five branches.

    Non-story sections are read by the catch-all voice; chunks without dialogue need no model; of failed
    chunks and unmatched blocks the type decides; matched blocks (novel, section_index, sequence_number,
    label, confidence) take the speaker that ``lookup`` (novel, key, speaker) knows by exact or lower-cased label.
    Who reads the rest is looked up as well: the novel's narrator, or its catch-all voice, under the names that they have.
    """
    section, chunk = ["novel", "section_index"], ["novel", "section_index", "chunk"]
    by_type = F.when(F.col("entry_type").isin("narration", "thought", "action"), "NARRATOR").otherwise("MISC_VOICE")
    one = lambda df, branch, speaker, sure: df.withColumns(
        {"branch": F.lit(branch), "speaker": speaker, "confidence": sure}
    ).select(*_ENTRY)
    apart = non_story.select(*section).distinct()
    story = blocks.join(apart, section, "left_anti")
    spoken = story.filter("entry_type = 'dialogue'").select(*chunk).distinct()
    asked = story.join(spoken, chunk, "left_semi")
    lost = failed.select(*chunk).distinct()
    answered = asked.join(lost, chunk, "left_anti").join(matched, [*section, "sequence_number"], "left")
    keys = lookup.select("novel", F.col("key").alias("_key"), F.col("speaker").alias("_known"))
    label = F.trim("label")
    named = answered.withColumns({"_exact": label, "_lower": F.lower(label)})
    named = named.join(keys.withColumnsRenamed({"_key": "_exact", "_known": "_a"}), ["novel", "_exact"], "left")
    named = named.join(keys.withColumnsRenamed({"_key": "_lower", "_known": "_b"}), ["novel", "_lower"], "left").withColumn("_sure", F.col("confidence"))
    rows = (
        one(blocks.join(apart, section, "left_semi"), "front", F.lit("MISC_VOICE"), F.lit(1.0))
        .unionByName(one(story.join(spoken, chunk, "left_anti"), "deterministic", by_type, F.lit(1.0)))
        .unionByName(one(asked.join(lost, chunk, "left_semi"), "failed", by_type, F.lit(0.0)))
        .unionByName(one(named.filter("label is null"), "unmatched", by_type, F.lit(0.0)))
        .unionByName(one(named.filter("label is not null"), "matched", F.coalesce("_a", "_b", by_type), confidence(F.col("_sure"))))
    )
    spare = lookup.filter("key in ('NARRATOR', 'MISC_VOICE')").select("novel", F.col("key").alias("speaker"), F.col("speaker").alias("_known"))
    return rows.join(spare, ["novel", "speaker"], "left").withColumn("speaker", F.coalesce("_known", "speaker")).select(*_ENTRY)


def event_rows(chunks: DataFrame) -> DataFrame:
    """(novel, section_index, sequence_number, chunk, event) of chunks (novel, section_index, start, chunk, blocks, events).

    The events of a chunk are numbered on from its last block; where numbers meet, the later chunk's event stays.
    """
    so_far = Window.partitionBy("novel", "section_index").orderBy("chunk")
    after = chunks.withColumn("_after", F.col("start") + F.sum("blocks").over(so_far))
    rows = after.select("novel", "section_index", "chunk", "_after", F.posexplode("events").alias("at", "event"))
    keyed = rows.withColumn("sequence_number", F.col("_after") + F.col("at"))
    best = keyed.groupBy("novel", "section_index", "sequence_number").agg(F.max(F.struct("chunk", "event")).alias("x"))
    return best.select("novel", "section_index", "sequence_number", "x.chunk", "x.event")


def names_to_ids(rows: DataFrame, labels: str, lookup: DataFrame) -> DataFrame:
    """Adds ``ids``: of array ``labels`` the known characters (lookup: novel, key, character_id), each once, in order."""
    known = lookup.groupBy("novel").agg(F.map_from_entries(F.collect_list(F.struct("key", "character_id"))).alias("_map"))
    pick = lambda x: F.coalesce(F.element_at("_map", F.trim(x)), F.element_at("_map", F.lower(F.trim(x))))
    ids = F.array_distinct(F.filter(F.transform(labels, pick), lambda x: x.isNotNull()))
    return rows.join(known, "novel", "left").withColumn("ids", F.coalesce(ids, F.expr("cast(array() as array<bigint>)"))).drop("_map")


def profile_rows(answers: DataFrame, lookup: DataFrame) -> DataFrame:
    """(novel, section_index, character_id, status, summary) of profile updates (novel, section_index, chunk, updates).

    Updates of unknown characters go; the last update of a character in a section stays.
    """
    rows = answers.select("novel", "section_index", "chunk", F.posexplode("updates").alias("at", "u"))
    key = F.lower(F.trim("u.character_name"))
    known = rows.withColumn("key", key).join(lookup.select("novel", "key", "character_id"), ["novel", "key"])
    last = known.groupBy("novel", "section_index", "character_id").agg(F.max_by("u", F.struct("chunk", "at")).alias("u"))
    return last.select("novel", "section_index", "character_id", "u.status", "u.summary")


def state_line(status: Column, feeling: Column, recent: Column) -> Column:
    """A character's state as a chat shows it: what is known, in order."""
    part = lambda label, x: F.when(T.strip(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), T.strip(x)))
    return F.concat_ws(" | ", part("Status", status), part("Feeling", feeling), part("Recently", recent))


def compaction(messages: DataFrame, budget: int = 2500, keep: int = 8) -> DataFrame:
    """(session, tokens, messages, due, folded, watermark, transcript) of messages (session, id, role, content, summary_upto).

    Messages after the session's watermark count; over the budget, all but the last ``keep`` are folded
    into a transcript, and the last folded id is the new watermark.
    """
    after = messages.filter(F.col("id") > F.coalesce("summary_upto", F.lit(-1)))
    line = F.concat(F.when(F.col("role") == "character", "You").otherwise("User"), F.lit(": "), F.coalesce("content", F.lit("")))
    per = after.groupBy("session").agg(
        F.sum(T.est_tokens(F.coalesce("content", F.lit("")))).alias("tokens"), F.count("*").alias("messages"),
        F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("_all"),
    )
    due = (F.col("tokens") > budget) & (F.col("messages") > keep)
    fold = F.when(due, F.slice("_all", F.lit(1), F.size("_all") - keep))
    out = per.withColumns({"due": due, "_fold": fold})
    return out.select(
        "session", "tokens", "messages", "due", F.coalesce(F.size("_fold"), F.lit(0)).alias("folded"),
        F.get("_fold", F.size("_fold") - 1)["id"].alias("watermark"), F.array_join(F.transform("_fold", lambda x: x["line"]), "\n").alias("transcript"),
    )


def chat_requests(sessions: DataFrame, messages: DataFrame, passages: DataFrame, events: DataFrame) -> DataFrame:
    """(session, system, turns): what a chat request holds.

    sessions (session, name, aliases, description, world, chapter, state, summary, summary_upto), messages
    (session, id, role, content), passages (session, place, text), events (session, place, summary).
    Lists are joined per session in order; blocks without content are left out.
    """
    listed = lambda df, text, name: df.groupBy("session").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("- "), text).alias("t")))), lambda x: x["t"]), "\n").alias(name)
    )
    joined = sessions.join(listed(passages, T.passage(F.col("text")), "_moments"), "session", "left").join(listed(events, F.col("summary"), "_events"), "session", "left")
    said = messages.join(sessions.select("session", "summary_upto"), "session").filter(F.col("id") > F.coalesce("summary_upto", F.lit(-1)))
    role = F.when(F.col("role") == "character", "assistant").otherwise("user")
    turns = said.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("id", role.alias("role"), F.coalesce("content", F.lit("")).alias("content")))).alias("turns"))
    block = lambda title, x, sep="\n": F.when(T.strip(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(f"{title}{sep}"), x))
    context = F.concat_ws("\n\n", block("STATE:", F.col("state")), block("MOMENTS:", F.col("_moments")), block("EVENTS:", F.col("_events")))
    persona = F.concat_ws(
        "\n",
        F.concat(F.lit("You are "), "name", F.lit(" of "), "world", F.lit(", at chapter "), F.col("chapter").cast("string"), F.lit(".")),
        F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as: "), F.array_join("aliases", ", "), F.lit("."))),
        block("About you:", F.col("description"), " "),
    )
    system = F.concat_ws("\n\n", persona, F.nullif(context, F.lit("")), block("EARLIER (summary):", F.col("summary")))
    return joined.select("session", system.alias("system")).join(turns, "session", "left")
