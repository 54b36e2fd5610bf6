"""Speakers, voices, alignment of responses with source blocks, and character merging."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# The voice actors (name, gender, age, suited to a protagonist), in order.
ACTORS = [
    ("Vivian", "female", "young_adult", True), ("Serena", "female", "young", False), ("Sohee", "female", "adult", True),
    ("Ono_Anna", "female", "teen", True), ("Dylan", "male", "young", True), ("Ryan", "male", "adult", True),
    ("Aiden", "male", "young_adult", True), ("Uncle_Fu", "male", "middle_aged", False), ("Eric", "male", "young", False),
]


def actors(spark: SparkSession) -> DataFrame:
    rows = [(k + 1, *a) for k, a in enumerate(ACTORS)]
    return spark.createDataFrame(rows, "actor_id int, actor string, actor_gender string, actor_age string, suited boolean")


def voice_scores(characters: DataFrame) -> DataFrame:
    """(novel, character_id, actor_id, score) of the nine actors; gender must match unless unknown."""
    pairs = characters.crossJoin(F.broadcast(actors(characters.sparkSession)))
    pairs = pairs.filter((F.col("gender") == "unknown") | (F.col("gender") == F.col("actor_gender")))
    lead = F.col("role").isin("protagonist", "deuteragonist") & F.col("suited")
    score = F.greatest(F.lit(0), 3 - T.age_distance(F.col("age_range"), F.col("actor_age"))) + F.when(lead, 2).otherwise(0)
    return pairs.select("novel", "character_id", "role", "actor_id", score.cast("int").alias("score"))


# Roles in the order in which voices are given out; the first five have a voice of their own.
ROLES = ("protagonist", "deuteragonist", "antagonist", "major", "narrator", "minor")
RESERVED = ROLES[:5]


def assign_voices(characters: DataFrame) -> DataFrame:
    """(novel, character_id, actor_id) of characters (novel, character_id, gender, age_range, role).

    By role, then id, a character takes the best-scored actor, the first of equals; a reserved role
    scores a point for an actor that none before it took, and takes it. Without an actor of the gender it is
    the first one not taken, else the first. Only reserved roles depend on each other, so these alone are
    folded per novel; the others are chosen row by row, given who is taken. Catch-all voices share the
    novel's least used actor.
    """
    ids = F.array(*[F.lit(k + 1) for k in range(len(ACTORS))])
    role = F.when(F.col("role").isin(*ROLES, "misc_voice"), F.col("role")).otherwise("minor")
    people = characters.select("novel", "character_id", "gender", "age_range", role.alias("role"))
    scored = voice_scores(people.filter("role <> 'misc_voice'")).groupBy("novel", "character_id").agg(
        F.sort_array(F.collect_list(F.struct("actor_id", "score"))).alias("options")
    )
    options = people.filter("role <> 'misc_voice'").join(scored, ["novel", "character_id"], "left")
    options = options.withColumn("options", F.coalesce("options", F.expr("cast(array() as array<struct<actor_id:int,score:int>>)")))

    def choice(options: Column, taken: Column, bonus: int) -> Column:
        free = lambda a: F.when(F.array_contains(taken, a), 0).otherwise(1)
        best = F.array_max(F.transform(options, lambda o: F.struct((o["score"] + bonus * free(o["actor_id"])).alias("s"), (-o["actor_id"]).alias("a"))))
        first = F.coalesce(F.get(F.filter(ids, lambda a: ~F.array_contains(taken, a)), F.lit(0)), F.lit(1))
        return F.when(F.size(options) > 0, -best["a"]).otherwise(first).cast("int")

    none = F.expr("cast(array() as array<int>)")
    kind = "array<struct<character_id:bigint,actor_id:int>>"
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    major = options.filter(F.col("role").isin(*RESERVED)).groupBy("novel").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "character_id", "options"))).alias("todo")
    )

    def step(s: Column, x: Column) -> Column:
        actor = choice(x["options"], s["taken"], 1)
        given = F.struct(x["character_id"].cast("long").alias("character_id"), actor.alias("actor_id"))
        return F.struct(F.concat(s["taken"], F.array(actor)).alias("taken"), F.concat(s["done"], F.array(given)).alias("done"))

    folded = major.select("novel", F.aggregate("todo", F.struct(none.alias("taken"), F.expr(f"cast(array() as {kind})").alias("done")), step).alias("s"))
    reserved = folded.select("novel", F.explode("s.done").alias("x")).select("novel", "x.character_id", "x.actor_id")
    taken = folded.select("novel", F.array_distinct("s.taken").alias("taken"))
    minor = options.filter(~F.col("role").isin(*RESERVED)).join(taken, "novel", "left")
    minor = minor.select("novel", "character_id", choice(F.col("options"), F.coalesce("taken", none), 0).alias("actor_id"))
    regular = reserved.unionByName(minor)
    misc = people.filter("role = 'misc_voice'").select("novel", "character_id")
    return regular.unionByName(misc.join(least_used(people.select("novel").distinct(), regular), "novel").select("novel", "character_id", "actor_id"))


def least_used(novels: DataFrame, assigned: DataFrame) -> DataFrame:
    """(novel, actor_id): the actor with the fewest characters of a novel, those with none included; the first of equals."""
    every = novels.select("novel", F.explode(F.sequence(F.lit(1), F.lit(len(ACTORS)))).alias("actor_id"))
    uses = assigned.groupBy("novel", "actor_id").agg(F.count("*").alias("uses"))
    counted = every.join(uses, ["novel", "actor_id"], "left")
    return counted.groupBy("novel").agg(F.min_by("actor_id", F.struct(F.coalesce("uses", F.lit(0)), "actor_id")).alias("actor_id"))


def voiced_lines(lines: DataFrame, characters: DataFrame, stock: DataFrame, default: str = "Sohee") -> DataFrame:
    """Adds ``actor`` and ``sample`` to lines (novel, speaker_id, emotion, intensity).

    The actor is the speaker's, else the narrator's, else ``default``; characters (novel, character_id,
    actor, is_narrator). The sample is the exact one of ``stock`` (actor, emotion, intensity), else that of
    the nearest intensity, else the actor's neutral one, else the default actor's; a line without any goes.
    A missing or empty emotion is neutral, a missing or empty intensity low; an emotion that the stock does not know has no
    sample of its own, an unknown intensity takes the first of low, med and high. Actors are those of the stock.
    """
    filled = lambda c, x: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(x))
    kept = stock.select("actor", F.col("emotion").alias("_e"), F.coalesce("intensity", F.lit("")).alias("_i"))
    levels = kept.filter("_e <> 'neutral'").groupBy("actor", "_e").agg(F.collect_set("_i").alias("_levels"))
    neutral = kept.filter("_e = 'neutral'").select("actor", F.concat("actor", F.lit("_neutral")).alias("_neutral")).distinct()
    spare = neutral.filter(F.col("actor") == default).select(F.col("_neutral").alias("_spare"))
    voice = characters.select("novel", F.col("character_id").alias("speaker_id"), F.nullif("actor", F.lit("")).alias("_speaker"))
    narrator = characters.filter("is_narrator").groupBy("novel").agg(F.min_by(F.nullif("actor", F.lit("")), "character_id").alias("_narrator"))
    cast_ = lines.join(voice, ["novel", "speaker_id"], "left").join(narrator, "novel", "left")
    cast_ = cast_.withColumn("actor", F.coalesce("_speaker", "_narrator", F.lit(default))).drop("_speaker", "_narrator")
    keyed = cast_.withColumns({"_e": filled("emotion", "neutral"), "_i": filled("intensity", "low")})
    # The stock is an inventory of a few samples for each actor, so these are small tables.
    out = keyed.join(levels, ["actor", "_e"], "left").join(neutral, "actor", "left").join(F.broadcast(spare), how="left")
    # Intensities to try, in order.
    order = F.when(F.col("_i") == "med", F.array(F.lit("med"), F.lit("low"), F.lit("high"))).when(F.col("_i") == "high", F.array(F.lit("high"), F.lit("med"), F.lit("low")))
    order = F.concat(F.array("_i"), order.otherwise(F.array(F.lit("low"), F.lit("med"), F.lit("high"))))
    level = F.get(F.filter(order, lambda x: F.array_contains("_levels", x)), F.lit(0))
    own = F.when(level.isNotNull(), F.concat_ws("_", "actor", "_e", level))
    return out.withColumn("sample", F.coalesce(own, "_neutral", "_spare")).drop("_e", "_i", "_levels", "_neutral", "_spare").filter("sample is not null")


def stored_cast(characters: DataFrame, narrators: DataFrame) -> DataFrame:
    """(novel, place, name, role, is_narrator): a novel's characters, its narrator and its catch-all voice.

    narrators (novel, narrator_type, narrator_name). A narrator of type "character" is every character that
    matches by name or alias, the last of them for good; a narrator that matches none, or of another type,
    is an added NARRATOR.
    """
    named = characters.join(narrators, "novel", "left")
    candidates = F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    matches = F.exists(candidates, lambda c: T.names_match(F.trim("narrator_name"), F.trim(c)))
    flagged = named.withColumn("is_narrator", (F.col("narrator_type") == "character") & F.coalesce(matches, F.lit(False)))
    flagged = flagged.withColumn("is_narrator", F.coalesce("is_narrator", F.lit(False)))
    told = flagged.filter("is_narrator").select("novel").distinct()
    novels = characters.select("novel").unionByName(narrators.select("novel")).distinct()
    extra = lambda df, place, name, role, tells: df.select(
        "novel", F.lit(place).cast("long").alias("place"), F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(tells).alias("is_narrator")
    )
    last = 1 << 62
    return (
        flagged.select("novel", F.col("place").cast("long").alias("place"), "name", "role", "is_narrator")
        .unionByName(extra(novels.join(told, "novel", "left_anti"), last, "NARRATOR", "narrator", True))
        .unionByName(extra(novels, last + 1, "MISC_VOICE", "misc_voice", False))
    )


def consolidated(found: DataFrame, accumulated: DataFrame) -> DataFrame:
    """The consolidated cast, or the accumulated one of a novel whose consolidation lost all its characters."""
    kept = found.select("novel").distinct()
    return found.unionByName(accumulated.select(*found.columns).join(kept, "novel", "left_anti"))


def speaker_lookup(characters: DataFrame) -> DataFrame:
    """(novel, key, character_id): names and aliases in lower case; a later character wins a key.

    Where characters have ``is_narrator`` and ``role``, the first narrator owns "narrator", the first catch-all voice "misc_voice".
    """
    keys = characters.select("novel", "character_id", F.explode(F.concat(F.array("name"), "aliases")).alias("key"))
    if {"is_narrator", "role"} <= set(characters.columns):
        fixed = lambda df, key: df.groupBy("novel").agg(F.min("character_id").alias("character_id")).withColumn("key", F.lit(key))
        owned = fixed(characters.filter("is_narrator"), "narrator").unionByName(fixed(characters.filter("role = 'misc_voice'"), "misc_voice"))
        keys = keys.withColumn("key", F.lower("key"))
        keys = keys.join(owned.select("novel", "key"), ["novel", "key"], "left_anti").unionByName(owned)
    return keys.groupBy("novel", F.lower("key").alias("key")).agg(F.max("character_id").alias("character_id"))


def label_lookup(characters: DataFrame) -> DataFrame:
    """(novel, key, speaker, character_id) of characters (novel, character_id, name, aliases, role, is_narrator).

    Keys are names and aliases as they are and in lower case; a later character wins a key. The first
    narrator owns NARRATOR, the first catch-all voice MISC_VOICE, and UNKNOWN is nobody: these win over names.
    """
    label = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))))
    keys = characters.select("novel", F.col("character_id").cast("long").alias("rank"), "name", F.col("character_id").cast("long").alias("id"), label.alias("label")).withColumn("label", F.trim("label"))
    last = F.lit((1 << 62) + 1)
    fixed = lambda df, key: df.groupBy("novel").agg(
        F.min_by("name", "character_id").alias("name"), F.min("character_id").cast("long").alias("id")
    ).withColumns({"label": F.lit(key), "rank": last})
    nobody = characters.select("novel").distinct().withColumns({"name": F.lit("UNKNOWN"), "label": F.lit("UNKNOWN"), "rank": last, "id": F.lit(None).cast("long")})
    every = keys.unionByName(fixed(characters.filter("is_narrator"), "NARRATOR")).unionByName(fixed(characters.filter("role = 'misc_voice'"), "MISC_VOICE")).unionByName(nobody)
    both = every.filter("label <> ''").select("novel", "rank", "name", "id", F.explode(F.array_distinct(F.array("label", F.lower("label")))).alias("key"))
    best = both.groupBy("novel", "key").agg(F.max(F.struct("rank", "name", "id")).alias("x"))
    return best.select("novel", "key", F.col("x.name").alias("speaker"), F.col("x.id").alias("character_id"))


def resolved(entries: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds the speaker's character: by name, else who the lookup (novel, key, character_id) knows as narrator, for narration,
    thought and action, or as catch-all voice. A lookup that knows neither leaves NARRATOR or MISC_VOICE."""
    keyed = entries.withColumn("key", F.lower("speaker_name"))
    fallback = F.when(F.col("entry_type").isin("narration", "thought", "action"), "NARRATOR").otherwise("MISC_VOICE")
    own = keyed.join(lookup.select("novel", "key", F.col("character_id").alias("_own")), ["novel", "key"], "left").withColumn("key", F.lower(fallback))
    both = own.join(lookup.select("novel", "key", F.col("character_id").alias("_spare")), ["novel", "key"], "left")
    return both.withColumn("speaker", F.coalesce(F.col("_own").cast("string"), F.col("_spare").cast("string"), fallback)).drop("key", "_own", "_spare")


def aligned(blocks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, line): greedy in block order, a line once, the first best above 0.3.

    Pairs stay within a request chunk of at most six blocks; the greedy pick is a fold over them.
    """
    scored = blocks.join(lines, keys).withColumn("score", F.round(T.overlap_score(F.col("block_text"), F.col("line_text")), 6)).filter("score > 0.3")
    per = scored.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("line").alias("line")))).alias("options"))
    chunk = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "options"))).alias("todo"))
    kind = "array<struct<block:int,line:int>>"
    # A block that got no line stands in ``done`` with a null, which must not make the test of the others' lines null.
    pick = lambda done, x: F.get(F.filter(x["options"], lambda o: ~F.exists(done, lambda d: d["line"].eqNullSafe(o["line"]))), F.lit(0))["line"]
    done = F.aggregate(
        "todo",
        F.expr(f"cast(array() as {kind})"),
        lambda done, x: F.concat(done, F.array(F.struct(x["block"].cast("int").alias("block"), pick(done, x).cast("int").alias("line")))),
    )
    return chunk.select(*keys, F.explode(done).alias("x")).select(*keys, "x.block", "x.line").filter("line is not null")


class _Cast:
    """A cast as its mentions come in: see ``merge_characters``. Its size is that of the cast, not of the mentions."""

    RANK = {r: k for k, r in enumerate(("protagonist", "deuteragonist", "antagonist", "major"))}

    def __init__(self):
        self.people: list[dict] = []
        self.by_name: dict[str, int] = {}

    def known(self, mention: dict) -> int | None:
        names = (mention["name"], *mention["aliases"])
        return min((self.by_name[n.lower()] for n in names if n.lower() in self.by_name), default=None)

    def add(self, mention: dict) -> int:
        self.people.append({f: mention[f] for f in MENTIONED} | {"aliases": list(mention["aliases"])})
        return self._named(len(self.people) - 1)

    def update(self, at: int, mention: dict) -> int:
        person = self.people[at]
        person["aliases"] = sorted({*person["aliases"], *mention["aliases"]} - {person["name"]})
        for field in ("gender", "age_range"):
            person[field] = mention[field] if person[field] == "unknown" else person[field]
        if mention["description"].lower() not in person["description"].lower():
            person["description"] = f"{person['description']} {mention['description']}".strip()
        if self.RANK.get(mention["role"], 4) < self.RANK.get(person["role"], 4):
            person["role"] = mention["role"]
        return self._named(at)

    def _named(self, at: int) -> int:
        for n in (self.people[at]["name"], *self.people[at]["aliases"]):
            self.by_name[n.lower()] = min(at, self.by_name.get(n.lower(), at))
        return at


MENTIONED = ("name", "aliases", "gender", "age_range", "role", "description")
_VERSION = "novel long, number int, name string, aliases array<string>, gender string, age_range string, role string, description string, first_section int, from_section int, to_section int"


def _versions(rows: Iterator[dict]) -> Iterator[dict]:
    """Versions of casts from mentions in order of series, book, section and place, with a row of kind "book" before each book's."""
    cast_, series, novel, since, first = _Cast(), None, None, [], []

    def version(at: int, end: int | None) -> dict:
        return {"novel": novel, "number": at, **cast_.people[at], "aliases": list(cast_.people[at]["aliases"]), "first_section": first[at], "from_section": since[at], "to_section": end}

    for r in rows:
        if r["kind"] == "book":
            yield from (version(k, None) for k in range(len(since)))
            if r["series_key"] != series:
                cast_, series, since, first = _Cast(), r["series_key"], [], []
            # Who is known from the books before is known from the first section on.
            novel, since = r["novel"], [0] * len(since)
            continue
        at, after = cast_.known(r), r["section_index"] + 1
        if at is None and r["kind"] == "new":
            cast_.add(r)
            since.append(after)
            first.append(r["section_index"])
        elif at is not None and r["kind"] == "update":
            before = version(at, r["section_index"])
            cast_.update(at, r)
            if since[at] < after and any(before[f] != cast_.people[at][f] for f in MENTIONED):
                yield before
                since[at] = after
    yield from (version(k, None) for k in range(len(since)))


def cast_versions(found: DataFrame, books: DataFrame) -> DataFrame:
    """The cast as of every section: (novel, number, name, ..., first_section, from_section, to_section).

    found (novel, section_index, place, kind, name, aliases, gender, age_range, role, description) are mentions as in
    ``merge_characters``, books (novel, series_key, novel_number). A version holds for requests of sections from
    ``from_section`` to ``to_section``, which is null up to the book's end: what section s tells is known from s + 1 on. A book begins
    with the cast of the one before it in its series, numbered alike; ``first_section`` is that of the book that told of a character first.
    Mentions pass through a task in order, with no more state than a cast; a series is one such stream, since every mention
    depends on those before it. Nulls in mentions are empty texts or unknown.
    """
    text = {f: F.coalesce(f, F.lit("unknown" if f in ("gender", "age_range") else "")) for f in MENTIONED if f != "aliases"}
    mentions = found.withColumns(text | {"aliases": F.coalesce("aliases", F.expr("cast(array() as array<string>)"))})
    place = books.select("novel", "series_key", F.coalesce("novel_number", F.lit(1)).alias("novel_number"))
    told = mentions.join(place, "novel").select("series_key", "novel_number", "novel", "section_index", "place", "kind", *MENTIONED)
    begins = place.withColumns({"section_index": F.lit(-1), "place": F.lit(-1), "kind": F.lit("book")})
    order = ["series_key", "novel_number", "novel", "section_index", "place"]
    rows = told.unionByName(begins, allowMissingColumns=True).repartition("series_key").sortWithinPartitions(*order)
    kind = pa.schema([("novel", pa.int64()), ("number", pa.int32()), ("name", pa.string()), ("aliases", pa.list_(pa.string())), ("gender", pa.string()), ("age_range", pa.string()),
                      ("role", pa.string()), ("description", pa.string()), ("first_section", pa.int32()), ("from_section", pa.int32()), ("to_section", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        versions = _versions(r for batch in batches for r in batch.to_pylist())
        while part := list(islice(versions, 5_000)):
            yield pa.RecordBatch.from_pylist(part, kind)

    out = rows.mapInArrow(run, _VERSION)
    return out.withColumn("novel", F.col("novel").cast(found.schema["novel"].dataType))


def merge_characters(found: DataFrame) -> DataFrame:
    """(novel, name, aliases, gender, age_range, role, description) of mentions (novel, section_index, place, kind, and these).

    In order of section and place, a new character whose name or alias, in any case, belongs to one before it is
    dropped; an update goes to the first character that shares a name with it, or nowhere: aliases unite
    without the own name, gender and age fill in where unknown, a description that is not part of the
    known one is appended, and the more important role stays.
    """
    alone = found.select("novel").distinct().select("novel", F.col("novel").alias("series_key"), F.lit(1).alias("novel_number"))
    last = cast_versions(found, alone).filter("to_section is null")
    return last.select("novel", *(F.array_join(f, ",").alias(f) if f == "aliases" else F.col(f) for f in MENTIONED))


def base_profiles(characters: DataFrame) -> DataFrame:
    """(novel, character_id, section_index, profile_type, status, summary): the profile that a stored character begins with."""
    return characters.select(
        "novel", "character_id", F.lit(0).alias("section_index"), F.lit("base").alias("profile_type"), F.lit("active").alias("status"), F.col("description").alias("summary")
    )


def samples(spark: SparkSession) -> DataFrame:
    """(actor, emotion, intensity): the inventory of voice samples; neutral has one without intensity."""
    rows = [(a[0], e, i) for a in ACTORS for e, levels in T.EMOTIONS.items() for i in (levels or [None])]
    return spark.createDataFrame(rows, "actor string, emotion string, intensity string")


def sample_files(paths: DataFrame) -> DataFrame:
    """(actor, emotion, intensities) of file names ``{Actor}_{emotion}[_{intensity}].wav``."""
    # Fixed value: how sample files are named.
    name = r"(?i)^([A-Za-z_]+?)_([a-z]+)(?:_(low|med|high))?\.wav$"
    got = [F.regexp_extract(F.regexp_extract("path", r"[^/]+$", 0), name, k) for k in (1, 2, 3)]
    rows = paths.select(got[0].alias("actor"), F.lower(got[1]).alias("emotion"), F.nullif(F.lower(got[2]), F.lit("")).alias("i")).filter("actor <> ''")
    return rows.groupBy("actor", "emotion").agg(F.sort_array(F.collect_set("i")).alias("intensities"))
