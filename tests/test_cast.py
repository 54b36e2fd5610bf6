"""The cast as of each chapter over the books of a series, against a replay chapter by chapter."""

import random

import pytest
from pyspark.sql import functions as F

from prose.operators import cast, entries, requests

MENTION = "novel int, section_index int, place int, kind string, name string, aliases array<string>, gender string, age_range string, role string, description string"
RANK = ("protagonist", "deuteragonist", "antagonist", "major")


def replay(mentions, books, sections):
    """{(novel, section): cast before it}: books of a series in order, every mention in turn."""
    out = {}
    for series in {s for _, s, _ in books}:
        people = []
        for novel, _, _ in sorted((b for b in books if b[1] == series), key=lambda b: b[2]):
            mine = sorted(m for m in mentions if m[0] == novel)
            for k in range(sections):
                out[(novel, k)] = sorted((n, tuple(a), role, g, age, d) for n, a, g, age, role, d in people)
                for m in (m for m in mine if m[1] == k):
                    names = {x.lower() for x in (m[4], *m[5])}
                    hit = next((p for p in people if names & {x.lower() for x in (p[0], *p[1])}), None)
                    if hit is None and m[3] == "new":
                        people.append([m[4], list(m[5]), *m[6:]])
                    elif hit is not None and m[3] == "update":
                        hit[1] = sorted({*hit[1], *m[5]} - {hit[0]})
                        hit[2] = m[6] if hit[2] == "unknown" else hit[2]
                        hit[3] = m[7] if hit[3] == "unknown" else hit[3]
                        rank = lambda r: RANK.index(r) if r in RANK else 4
                        hit[4] = m[8] if rank(m[8]) < rank(hit[4]) else hit[4]
                        if m[9].lower() not in hit[5].lower():
                            hit[5] = f"{hit[5]} {m[9]}".strip()
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_requests_know_no_later_character(spark, partitions):
    rng = random.Random(partitions)
    books = [(n, f"s{n // 5}" if n < 10 else f"alone{n}", n % 5 + 1 if n < 10 else None) for n in range(12)]
    mentions = []
    for n, _, _ in books:
        for section in range(8):
            for place in range(rng.randint(0, 5)):
                name, also = f"N{rng.randrange(25)}", [f"n{rng.randrange(40)}"] if rng.random() < 0.2 else []
                mentions.append((n, section, place, rng.choice(["new", "update"]), name, also, rng.choice(["unknown", "female"]), rng.choice(["unknown", "adult"]), rng.choice([*RANK, "minor"]), f"d{rng.randrange(3)}"))
    mentions = [m for m in mentions if m[0] != 3]  # a book that tells of nobody still knows its predecessors' cast
    shuffled = list(mentions)
    rng.shuffle(shuffled)
    found = spark.createDataFrame(shuffled, MENTION).repartition(partitions)
    versions = cast.cast_versions(found, spark.createDataFrame(books, "novel int, series_key string, novel_number int"))
    keys = [(n, k, f"t{k}", "x", None) for n, _, _ in books for k in range(8)]
    sections = spark.createDataFrame(keys, "novel int, section_index int, title string, text string, summary string")
    kind = "array<struct<name string, aliases array<string>, role string, gender string, age_range string, description string>>"
    out = requests.pass1_requests(sections, versions).select("novel", "section_index", F.from_json("characters", kind).alias("c")).collect()
    got = {(r.novel, r.section_index): sorted((c.name, tuple(c.aliases), c.role, c.gender, c.age_range, c.description) for c in r.c or []) for r in out}
    want = replay(mentions, books, 8)
    assert got == want and sum(map(len, want.values())) > 500
    # A version is held by one row, not by one for each section.
    assert versions.count() < len(mentions) + 12 * 25


def test_rolling_summaries_mark_empty_and_failed_chapters(spark):
    rows = [(1, k, f"t{k}", s, o) for k, (s, o) in enumerate([("a", None), (None, "empty"), ("", None), ("b", None), (None, "failed"), ("c", "ok"), ("d", None), ("e", None), (None, "empty"), (None, None)])]
    out = requests.rolling_summaries(spark.createDataFrame(rows, "novel int, section_index int, title string, summary string, outcome string")).orderBy("section_index").collect()
    b = "Chapter 1 (t0): a\nChapter 2: [empty]\nChapter 4 (t3): b"
    c = f"{b}\nChapter 5: [extraction failed]\nChapter 6 (t5): c"
    e = "Chapter 4 (t3): b\nChapter 5: [extraction failed]\nChapter 6 (t5): c\nChapter 7 (t6): d\nChapter 8 (t7): e"
    assert [r.rolling for r in out[:6]] == ["", "Chapter 1 (t0): a", "Chapter 1 (t0): a", "Chapter 1 (t0): a", b, b] and out[6].rolling == c and [r.rolling for r in out[8:]] == [e, e]


def test_answers_of_the_first_pass_become_a_cast(spark):
    import json

    raw = [
        (1, 0, json.dumps({"new_characters": [{"name": "Mina", "aliases": ["M"]}, {"name": None}], "chapter_summary": "s"})),
        (1, 1, "<think>{</think>" + json.dumps({"is_story_content": True, "updated_characters": [{"name": "m", "gender": "female", "role_hint": "major", "description": "A sailor"}], "new_characters": [{"name": "Rob"}]})),
        (1, 2, json.dumps({"is_story_content": False, "new_characters": [{"name": "Editor"}]})), (1, 3, "no answer"), (1, 4, None),
    ]
    read = entries.read_answers(spark.createDataFrame(raw, "novel int, section_index int, raw string"), "raw", entries.CHAPTER_SCHEMA)
    books = spark.createDataFrame([(1, "s", 1)], "novel int, series_key string, novel_number int")
    last = cast.cast_versions(entries.mentions(read), books).filter("to_section is null").orderBy("number").collect()
    assert [(r.name, r.aliases, r.gender, r.role, r.description, r.first_section) for r in last] == [("Mina", ["M"], "female", "major", "A sailor", 0), ("Rob", [], "unknown", "minor", "", 1)]
    assert [tuple(r) for r in entries.non_story(read).collect()] == [(1, 2)]
    whole = json.dumps({"characters": [{"name": "Mina", "role": "major"}], "narrator": {"narrator_type": "character", "narrator_character_name": "Mina"}})
    one = entries.read_answers(spark.createDataFrame([(whole,)], "raw string"), "raw", entries.CONSOLIDATION_SCHEMA).first().answer
    assert one.characters[0].name == "Mina" and one.narrator.narrator_character_name == "Mina"
