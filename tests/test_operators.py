"""Small hand-written cases of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from prose.functions import text as T
from prose.operators import cast, enrich, entries, library, retrieve, segment, upsert


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return row.select(column.alias("v")).first().v


def blocks(spark, text):
    return [(b.text, b.block_type) for b in value(spark, segment.text_blocks(F.col("t")), t=text)]


def test_mixed_paragraph(spark):
    got = blocks(spark, '"Mind the step," the porter lifts his lamp.')
    assert got == [("Mind the step,", "dialogue"), ("the porter lifts his lamp.", "narration")]


def test_quotes_actions_and_thoughts(spark):
    assert blocks(spark, "she can't, it's Mina's boat") == [("she can't, it's Mina's boat", "narration")]
    assert blocks(spark, "*A door shuts*") == [("A door shuts", "action")]
    assert blocks(spark, "“A” said «B».") == [("A", "dialogue"), ("said", "narration"), ("B", "dialogue"), (".", "narration")]
    assert blocks(spark, '"Hm." <em>What now</em>')[1][1] == "thought"


def test_mixed_quotes_and_long_action_lines(spark):
    assert blocks(spark, '"Hi there” he said.') == [("Hi there", "dialogue"), ("he said.", "narration")]
    assert blocks(spark, '"A" and "B” end') == [("A", "dialogue"), ("and", "narration"), ("B", "dialogue"), ("end", "narration")]
    long = "So it went. " * 250
    assert blocks(spark, f"[{long}]") == [(long.strip(), "action")] and len(blocks(spark, long)) == 3


def test_speakers_fall_back_to_the_novels_own_narrator(spark):
    people = spark.createDataFrame(
        [(1, 5, "Mina", ["the girl"], "protagonist", True), (1, 6, "Crowd", None, "misc_voice", False), (2, 7, "Rob", None, "minor", False)],
        "novel int, character_id long, name string, aliases array<string>, role string, is_narrator boolean",
    ).withColumn("aliases", F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    said = spark.createDataFrame(
        [(1, "THE GIRL", "dialogue"), (1, None, "narration"), (1, "nobody", "dialogue"), (2, "x", "thought"), (2, "rob", "action"), (2, None, "dialogue")], "novel int, speaker_name string, entry_type string"
    )
    got = sorted((r.novel, r.entry_type, str(r.speaker_name), r.speaker) for r in cast.resolved(said, cast.speaker_lookup(people)).collect())
    assert got == sorted([(1, "dialogue", "THE GIRL", "5"), (1, "narration", "None", "5"), (1, "dialogue", "nobody", "6"), (2, "thought", "x", "NARRATOR"), (2, "action", "rob", "7"), (2, "dialogue", "None", "MISC_VOICE")])
    keys = ["novel int", "section_index int", "sequence_number int"]
    rows = spark.createDataFrame([(1, 0, 0, 0, "narration", "a"), (1, 0, 1, 0, "dialogue", "b"), (1, 0, 2, 1, "narration", "c"), (1, 1, 3, 0, "dialogue", "d")], ", ".join([*keys, "chunk int", "entry_type string", "text string"]))
    none = rows.limit(0)
    matched = spark.createDataFrame([(1, 0, 1, "Nobody", 0.9)], ", ".join([*keys, "label string", "confidence double"]))
    table = entries.entry_table(rows, rows.filter("section_index = 1"), none, matched, cast.label_lookup(people))
    assert sorted((r.sequence_number, r.branch, r.speaker) for r in table.collect()) == [(0, "unmatched", "Mina"), (1, "matched", "Crowd"), (2, "deterministic", "Mina"), (3, "front", "Crowd")]


def test_long_escaped_quote_is_one_span(spark):
    got = blocks(spark, '"' + 'x\\"' * 20_000 + '"')
    assert {k for _, k in got} == {"dialogue"} and sum(len(t) for t, _ in got) == 60_000


def test_paragraph_fallback(spark):
    assert len(value(spark, segment.paragraphs(F.col("t")), t="\n".join("abcdefgh"))) == 8
    assert value(spark, segment.paragraphs(F.col("t")), t="a\nb\n\n c ") == ["a\nb", "c"]


@pytest.mark.parametrize(
    "given, want",
    [(("warm", "med"), ("warm", "low")), (("mysterious", "high"), ("mysterious", "low")), (("bogus", "high"), ("neutral", "low")),
     ((None, None), ("neutral", "low")), (("neutral", "high"), ("neutral", "low")), (("happy", "bogus"), ("happy", "low")), (("Sad", "HIGH"), ("sad", "high"))],
)
def test_emotion_snap(spark, given, want):
    e, i = T.snap_emotion(F.col("e"), F.col("i"))
    assert tuple(value(spark, F.struct(e.alias("a"), i.alias("b")), e=given[0], i=given[1])) == want


def test_names(spark):
    match = T.names_match(F.col("a"), F.col("b"))
    assert value(spark, match, a="Mina", b="Mina Aldous") and not value(spark, match, a="Rob", b="Robin")


def test_reasoning_and_normalisation(spark):
    assert value(spark, T.strip_reasoning(F.col("t")), t="<Think>x</thought> hi <reasoning>open") == "hi "
    assert value(spark, T.normalize(F.col("t")), t=" a\r\nb \t c\n\n\n\nd ") == "a\nb c\n\nd"
    assert value(spark, T.is_front_matter(F.col("t")), t="Author's Note") and not value(spark, T.is_front_matter(F.col("t")), t="Chapter 1")


def test_uuid5(spark):
    import uuid

    space = uuid.UUID("b6f1e3a2-0c4d-4e6f-8a1b-2c3d4e5f6a7b")
    for name in ("a:1", "b:22", "uuid-7:0"):
        assert value(spark, T.uuid5(space.hex, F.col("n")), n=name) == str(uuid.uuid5(space, name))


def test_chapters(spark):
    books = spark.createDataFrame([(1, "intro\nChapter I\nbody one\nPROLOGUE\n\nEpilogue: end\nlast")], "novel int, text string")
    got = [(r.section_index, r.title, r.locator, r.text) for r in segment.chapters(books).orderBy("section_index").collect()]
    assert got == [(0, "Opening", "txt:opening", "intro"), (1, "Chapter I", "txt:2", "body one"), (2, "Epilogue: end", "txt:6", "last")]
    # Lines stay as they are, but for what normalising does; other ends of lines are ends of lines.
    odd = spark.createDataFrame([(1, "\r\n  Chapter 2 \r\n  one\t two \x0bthree\n\n\n\n  four  \n")], "novel int, text string")
    assert [tuple(r)[2:] for r in segment.chapters(odd).collect()] == [("Chapter 2", "txt:1", "one two \nthree\n\n four")]


def test_packing_of_sections_units_and_chunks(spark):
    text = "\n\n".join("x" * n for n in (4000, 2000, 1000, 7000, 10))
    assert [[len(p) for p in s] for s in value(spark, segment.pack_sections(F.col("t")), t=text)] == [[4000, 2000], [1000], [7000], [10]]
    numbers = value(spark, segment.request_chunk_numbers(segment.text_blocks(F.col("t"))), t="\n\n".join(f"p{k}" for k in range(5)))
    assert numbers == [0, 0, 1, 1, 2]


def pieces_of(sentence, limit):
    """Words up to the limit, longer ones cut and apart."""
    out, open_ = [], False
    for w in sentence.split():
        if len(w) > limit:
            out += [w[k : k + limit] for k in range(0, len(w), limit)]
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(w) <= limit:
            out[-1] += " " + w
        else:
            out.append(w)
            open_ = True
    return out


def parts_of(text, limit):
    """Sentences up to the limit, longer ones cut and apart."""
    out, open_ = [], False
    for x in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        if len(x) > limit:
            out += pieces_of(x, limit)
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(x) <= limit:
            out[-1] += " " + x
        else:
            out.append(x)
            open_ = True
    return out


LONG = ["One. Two! Three?", "y" * 1400, "z" * 5000, "a. " + "z" * 3000 + " b c. D.", ("w" * 90 + " ") * 40 + "end. Next one. " + "v " * 900 + "x. Last."]


def test_long_blocks_are_cut_at_sentences_words_and_letters(spark):
    for text in LONG:
        want = parts_of(text.strip(), 1400) if len(text.strip()) > 1400 else [text.strip()]
        got = [t for t, _ in blocks(spark, text)]
        assert got == want and all(len(t) <= 1400 for t in got)
    assert len(blocks(spark, "z" * 5000)) == 4


def test_request_chunks_agree_with_the_numbers_of_blocks(spark):
    for text in ("\n\n".join(f"p{k} " * (k % 9 * 60 + 1) for k in range(40)), "\n\n".join('"a" b "c" d "e" f "g" h' for _ in range(5)), "", *LONG):
        found = segment.text_blocks(F.col("t"))
        row = value(spark, F.struct(found.alias("b"), segment.request_chunk_numbers(found).alias("n"), segment.request_chunks(found).alias("c")), t=text)
        want = {}
        for b, n in zip(row.b, row.n, strict=True):
            want.setdefault(n, []).append(len(b.text))
        assert [(c.blocks, c.chars) for c in row.c] == [(len(x), sum(x)) for x in want.values()]
        assert [c.first for c in row.c] == [sum(len(x) for x in list(want.values())[:k]) for k in range(len(want))]
        assert all(len(x) <= 6 and (sum(x) + 2 * len(x) - 2 <= 3200 or len(x) == 1) for x in want.values())


def test_narration_units(spark):
    units = lambda t: value(spark, segment.narration_units(F.col("t")), t=t)
    assert units("Hello, world. He left - slowly.") == ["Hello, world. He left - slowly."]
    assert units(None) == [] and units("  ") == []
    long = "This clause goes on, and on; " * 12 + "then it stops"
    got = units(f"First. Second! {long}. {'y' * 700} z. Last one.")
    assert got[0] == "First. Second!" and got[-1] == "Last one." and all(0 < len(u) <= 300 for u in got)
    assert got[1].endswith((",", ";")) and len(got[1]) > 270
    assert "y" * 300 in got and "".join(got).replace(" ", "") == f"First.Second!{long}.{'y' * 700}z.Lastone.".replace(" ", "")
    told = "“" + "A sentence of some length here. " * 14 + "”"
    assert units(told) == [u for u in segment.units_of(told.strip())] and len(units(told)) == 2


def test_sentences_with_places(spark):
    text = 'He said "No." Then (oh!) left.  Fine\n\n  '
    got = [(x.text, x.start) for x in value(spark, segment.sentence_spans(F.col("t")), t=text)]
    assert [t.strip() for t, _ in got] == ['He said "No."', "Then (oh!)", "left.", "Fine"] and all(text[a : a + len(t)] == t for t, a in got)


def test_blocks_of_long_turns_against_brute_force(spark, tmp_path):
    from hashlib import sha256

    from prose.plans.queries import QUERIES

    tale = lambda n, m: " ".join(" ".join(f"w{k}x{j}" for j in range(m)) + "." for k in range(n))
    texts = ["Short one. And more.", "y" * 1400, "z" * 1401, tale(90, 9), tale(3, 400) + " End!\n" + tale(40, 20), 'He "said" ' + tale(60, 12)]
    rows = [(c, t, role, x) for t, role in enumerate(("system", "user", "assistant")) for c, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for c, t, role, x in rows:
        x = x.replace('"', "").replace("\n", " ")
        found = [(y, "action" if role == "system" else "dialogue") for y in (parts_of(x, 1400) if len(x) > 1400 and role != "system" else [x])]
        found += [("said the guide.", "narration")] if role == "assistant" else []
        want |= {(c, t, at, kind, len(y), sha256(y.encode()).hexdigest()) for at, (y, kind) in enumerate(found)}
    got = [tuple(r) for r in QUERIES["text_blocks_of_all_turns"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(at for _, _, at, *_ in want) > 3


def test_retrieval_spans(spark, tmp_path):
    from prose.plans.queries import QUERIES

    said = lambda n, m, x: " ".join(" ".join(f"{x}{k}é{j}" for j in range(m)) + "." for k in range(n))
    long, small = said(60, 20, "l"), [said(10, 20, x) for x in "abcd"]
    texts = {0: "\n\n".join([small[0], small[1], long, *small[2:]]), 1: "", 2: said(1, 700, "g") + " " + said(3, 5, "h"), 3: None, 4: "One. Two!\n\n Three?"}
    df = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(QUERIES["retrieval_chunk_spans"](spark, str(tmp_path)).collect(), key=lambda r: r.serial)
    assert [(r.doc_id, r.chunk, r.serial) for r in rows] == [(0, k, k) for k in range(5)] + [(2, 0, 5), (2, 1, 6), (4, 0, 7)]
    # Two paragraphs; 25, 25 and 10 sentences of the long one; two paragraphs; a giant sentence alone.
    assert [r.tokens for r in rows] == [400, 500, 500, 200, 400, 700, 15, 3]
    shown = {}
    for r in rows:
        text, before = texts[r.doc_id], shown.get(r.doc_id)
        body, overlap = text[r.body_start : r.char_end], text[r.char_start : r.body_start]
        assert len(body.split()) == r.tokens and (r.tokens <= 512 or r.doc_id == 2)
        if before is None:
            assert not overlap
        elif r.doc_id == 0:
            assert overlap.split() == before[-80:]  # four sentences of 20 words are the least that reach 64
        else:
            assert overlap.split() == before
        shown[r.doc_id] = body.split()
    for i in (0, 2, 4):
        assert [w for r in rows if r.doc_id == i for w in texts[i][r.body_start : r.char_end].split()] == texts[i].split()
    seen = sorted((r.doc_id, r.chunk, r.words, r.overlap) for r in QUERIES["chunk_overlap_invariants"](spark, str(tmp_path)).collect())
    assert [x[2] for x in seen] == [r.tokens for r in rows] and [x[3] for x in seen] == [0, 80, 80, 80, 80, 0, 700, 0]


def test_finished_sections_over_many_unordered_files(spark, tmp_path):
    import os

    from prose.streaming import jobs

    days = ["2025-06-01", "2024-01-01", "2025-03-01", "2024-09-01", "2025-06-02", "2024-01-02"]
    kind = "event_id long, event_type string, props string, ts string"
    for k, day in enumerate(days):
        rows = [(0, "click", f'{{"k": {k % 4}}}', day), (0, "click", '{"k": 9}', day), (1, "view", '{"k": 1}', day)]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/out{k}")
        part = next(x for x in (tmp_path / f"out{k}").iterdir() if x.suffix == ".parquet")
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(part, f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.finished(jobs.finished_sections(events), "complete", f"{tmp_path}/out")
    assert [tuple(r) for r in got.collect()] == [(0, 5)]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, 5)], "k int, v string, version int, first int")
    delta = spark.createDataFrame([(1, "c", 2, 7), (3, "d", 2, 9), (2, "e", 2, 8)], "k int, v string, version int, first int")
    assert sorted((r.k, r.v) for r in upsert.upsert(base, delta, ["k"], "version").collect()) == [(1, "c"), (2, "e"), (3, "d")]
    kept = upsert.upsert_keeping_first(base, delta, ["k"], "version", "first").collect()
    assert sorted((r.k, r.v, r.first) for r in kept) == [(1, "c", 7), (2, "e", 5), (3, "d", 9)]
    deleted = spark.createDataFrame([(1, "The Invisible Man"), (2, "x")], "k int, title string")
    assert sorted(r.k for r in upsert.cascade_delete(base, deleted, "k").collect()) == [1]


def test_percent(spark):
    for done, total, want in ((0, 0, 0), (0, 3, 33), (2, 3, 100)):
        assert spark.range(1).select(library.percent_read(F.lit(done), F.lit(total)).alias("v")).first().v == want


def test_boost(spark):
    rows = [(1, 1, 1.0, 2, 5, 2, 5), (2, 2, 1.0, 2, 5, 2, 0), (3, 3, 1.0, 2, 5, 2, 8)]
    hits = spark.createDataFrame(rows, "query int, chunk int, score double, novel_number_now int, current_chapter int, novel_number int, chapter_index int")
    assert {r.query: r.score for r in retrieve.boosted(hits).collect()} == {1: 1.15, 2: 1.055182, 3: 1.15}


def test_as_of_and_range_join(spark):
    entries = spark.createDataFrame([(1, 3, 30), (1, 5, 50)], "novel int, seq int, value int")
    events = spark.createDataFrame([(1, 0, 9), (1, 3, 10), (1, 4, 11), (2, 1, 12)], "novel int, seq int, event_id long")
    assert {r.event_id: r.value for r in enrich.as_of(events, entries, ["novel"], "seq", "value").collect()} == {9: None, 10: 30, 11: 30, 12: None}
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 8, 20)], "novel int, chunk int, char_start int, char_end int")
    at = spark.createDataFrame([(1, k, p) for k, p in enumerate((0, 9, 19, 99))], "novel int, entry int, pos int")
    assert {r.pos: r.chunk for r in enrich.chunk_of_position(at, chunks, ["novel"]).collect()} == {0: 0, 9: 0, 19: 1, 99: 1}


def test_alignment_takes_a_line_once(spark):
    blocks_ = spark.createDataFrame([(1, 0, "the red fox"), (1, 1, "the red fox"), (1, 2, "nothing alike")], "c int, block int, block_text string")
    lines = spark.createDataFrame([(1, 0, "The red fox ran"), (1, 1, "the red fox")], "c int, line int, line_text string")
    assert sorted((r.block, r.line) for r in cast.aligned(blocks_, lines, ["c"]).collect()) == [(0, 1), (1, 0)]


def test_empty_lines_match_nothing(spark):
    score = T.overlap_score(F.col("a"), F.col("b"))
    assert value(spark, score, a="he left", b="") == 0 and value(spark, score, a="he left", b=" \n") == 0 and value(spark, score, a="he left", b="He LEFT ") == 1.5


MENTION = "novel int, section_index int, place int, kind string, name string, aliases array<string>, gender string, age_range string, role string, description string"


def test_merge_of_characters(spark):
    rows = [
        (1, 0, 0, "new", "Mina", ["M"], "unknown", "adult", "minor", "A sailor"), (1, 1, 0, "new", "mina", ["Captain"], "male", "teen", "major", "dropped"),
        (1, 1, 1, "update", "MINA", ["Skip", "Mina"], "female", "elderly", "antagonist", "a SAILOR"), (1, 2, 0, "update", "skip", [], "male", "teen", "minor", "Brave"),
        (1, 2, 1, "update", "Nobody", [], "male", "teen", "minor", "lost"), (1, 3, 0, "new", "Rob", None, None, None, None, None), (2, 0, 0, "new", "Mina", [], "female", "adult", "minor", ""),
    ]
    got = sorted(tuple(r) for r in cast.merge_characters(spark.createDataFrame(rows, MENTION)).collect())
    assert got == [
        (1, "Mina", "M,Skip", "female", "adult", "antagonist", "A sailor Brave"), (1, "Rob", "", "unknown", "unknown", "", ""), (2, "Mina", "", "female", "adult", "minor", ""),
    ]


def voices_by_hand(people):
    """Brute force: one novel, roles in order, then ids."""
    ages, taken, out = T.AGES, set(), {}
    order = {r: k for k, r in enumerate(cast.ROLES)}
    for i, gender, age, role in sorted((p for p in people if p[3] != "misc_voice"), key=lambda p: (order.get(p[3], 5), p[0])):
        best = None
        for k, (_, g, a, suited) in enumerate(cast.ACTORS, 1):
            if gender not in ("unknown", g):
                continue
            gap = abs(ages.index(age) - ages.index(a)) if age in ages else 3
            score = max(0, 3 - gap) + 2 * (role in ("protagonist", "deuteragonist") and suited) + (role in cast.RESERVED and k not in taken)
            if best is None or score > best[0]:
                best = (score, k)
        chosen = best[1] if best else next((k for k in range(1, 10) if k not in taken), 1)
        out[i] = chosen
        if role in cast.RESERVED:
            taken.add(chosen)
    used = [sum(v == k for v in out.values()) for k in range(1, 10)]
    return out | {p[0]: used.index(min(used)) + 1 for p in people if p[3] == "misc_voice"}


def test_voices_against_brute_force(spark):
    import random

    rng = random.Random(1)
    genders, ages = ["male", "female", "unknown", "other"], [*T.AGES, "unknown"]
    roles = [*cast.ROLES, "minor", "extra", "misc_voice"]
    novels = {n: [(100 * n + k, rng.choice(genders), rng.choice(ages), rng.choice(roles)) for k in range(rng.randint(1, 30))] for n in range(12)}
    df = spark.createDataFrame([(n, *p) for n, x in novels.items() for p in x], "novel int, character_id long, gender string, age_range string, role string")
    got = {r.character_id: r.actor_id for r in cast.assign_voices(df).collect()}
    assert got == {i: a for x in novels.values() for i, a in voices_by_hand(x).items()}


def test_sample_files(spark):
    paths = spark.createDataFrame([("x/Ono_Anna_sad_low.wav",), ("y/Ono_Anna_SAD_high.wav",), ("Ryan_neutral.wav",), ("a.txt",)], "path string")
    assert {(r.actor, r.emotion): r.intensities for r in cast.sample_files(paths).collect()} == {("Ono_Anna", "sad"): ["high", "low"], ("Ryan", "neutral"): []}


def test_alignment_goes_on_after_a_block_without_a_line(spark):
    """Blocks 0 and 1 want line 0 alone, so block 1 gets none; block 2 still gets its own."""
    blocks_ = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "a b c"), (0, 2, "d e f")], "chunk int, block int, block_text string")
    lines = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "d e f")], "chunk int, line int, line_text string")
    assert sorted((r.block, r.line) for r in cast.aligned(blocks_, lines, ["chunk"]).collect()) == [(0, 0), (2, 1)]


def test_character_references(spark):
    from prose.operators import requests

    assert value(spark, requests.unescaped(F.col("t")), t="a &amp; b &eacute;") == "a & b é"


def test_references_without_semicolon_stay(spark):
    from prose.operators import requests

    text = "a&amp;&quot;&eacute;&#39;&#xe9;&nosuch;&ampx; &amp; cut&amp"
    assert value(spark, requests.closed_unescaped(F.col("t")), t=text) == 'a&"é\'é&nosuch;&ampx; & cut&amp'
    assert value(spark, requests.closed_unescaped(F.col("t")), t="&amp;lt;") == "&lt;"


def test_bad_bytes_are_replaced(spark, tmp_path):
    from prose.sources import tables

    (tmp_path / "A.TXT").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "b.doc").write_bytes(b"x")
    files = tables.read_books(spark, str(tmp_path))
    good, bad = tables.supported_books(files)
    assert [(r.suffix, r.text) for r in good.collect()] == [(".txt", "café \ufffd end")] and [r.suffix for r in bad.collect()] == [".doc"]


def test_partitions_are_replaced_and_runs_published(spark, tmp_path):
    from prose.sources import tables

    row = lambda *x: spark.createDataFrame([*x], "novel_uuid string, chunk_serial int")
    tables.rewrite_index(row(("a", 1), ("a", 2), ("b", 1)), f"{tmp_path}/index")
    for _ in range(2):
        tables.rewrite_index(row(("a", 7)), f"{tmp_path}/index")
    assert sorted((r.novel_uuid, r.chunk_serial) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [("a", 7), ("b", 1)]
    tables.write_together({"x": row(("a", 1)), "y": row(("b", 2))}, f"{tmp_path}/runs", "r1")
    row(("lost", 9)).write.parquet(f"{tmp_path}/runs/run=r2/x")
    assert [(r.run, r.novel_uuid) for r in tables.published(spark, f"{tmp_path}/runs", "x").collect()] == [("r1", "a")]


def test_answers_are_read_repaired_or_rejected(spark):
    from prose.operators import entries

    raw = [
        '{"a": "x", "b": [1, 2]}', "```json\n{\"a\": \"x\"}\n```", '<Think>{"a": 0}</think> {"a": "y"}', 'so {bad} then {"a": "br}ace"} end {', '{"a": "cut sho', '{"b": [1, 2',
        "nothing", None, "", '<reasoning> open {"a": "z"}', '{"a": "x", oops}',
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    got = {r.k: (r.how, r.answer and r.answer.a) for r in entries.read_answers(df, "raw", "a string, b array<int>").collect()}
    assert got == {
        0: ("read", "x"), 1: ("read", "x"), 2: ("read", "y"), 3: ("repaired", "br}ace"), 4: ("repaired", "cut sho"), 5: ("repaired", None),
        6: ("rejected", None), 7: ("rejected", None), 8: ("rejected", None), 9: ("read", "z"), 10: ("rejected", None),
    }


def test_blocks_of_queries_give_the_same_hits(spark, monkeypatch):
    from prose.sources import tables

    sf = "/root/testdata/sf0.001"
    run = lambda: sorted(tuple(r) for r in retrieve.dense(tables.retrieval_queries(spark, sf), tables.chunks(spark, sf)).select("query", "chunk", "rank").collect())
    want = run()
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(retrieve, "BLOCK_CHUNKS", 50)
    assert run() == want and len(want) > 50


def test_book_sections(spark):
    from prose.operators import ingest

    page = lambda title, text: f"<html><head><title>{title}</title></head><body><h1></h1>{text}</body></html>"
    docs = [
        (1, "t/a.html", "Book", page("x/part_split_004.html", "<p>one</p>"), None, 0), (1, "t/b.html", "Book", page("Book", "<p>two &amp; &lt;</p>"), 5, 1),
        (1, "t/c.html", "Book", page("", ""), 4, 2), (1, "t/my-file_x.html", "Book", page("", "<hr class='k'/>"), 3, 3), (1, "t/d7.html", "Book", page("", '<img alt="q" src="i.png">'), None, 4),
        (2, "x.html", "B", "<p>listed</p>", None, 0), (2, "y.html", "B", "<p>not</p>", None, 1),
    ]
    df = spark.createDataFrame(docs, "book int, name string, book_title string, html string, spine_pos int, manifest_pos int")
    toc = spark.createDataFrame([(2, 0, "f/x.html#a", " Listed "), (2, 1, "x.html", "late"), (2, 2, "z.html", "gone")], "book int, place int, href string, title string")
    got = sorted(tuple(r)[:5] for r in ingest.book_sections(df, toc).collect())
    assert [(b, k, t, x) for b, k, t, x, _ in got] == [
        (1, 0, "My File X", "My File X"), (1, 1, "Chapter 2", "two & <"), (1, 2, "Chapter 5", "one"), (1, 3, "Chapter 7", "Chapter 7"), (2, 0, "Listed", "listed"),
    ]
    assert got[0][4].endswith("<hr>") and '<img src="i.png">' in got[3][4]
