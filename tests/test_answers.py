"""Answers to stored rows, and requests in rounds, against a replay of one section after another."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prose.functions import text as T
from prose.operators import answers, cast, rounds
from prose.sources import tables

WORDS = "lamp boat storm rope deck gull salt wind tide keel mast bell fog reef sail net".split()
PEOPLE = [(1, 11, "Mina Hale", ["Mina", "M"], "protagonist", True), (1, 12, "Rob", None, "major", False), (1, 13, "Crowd", [], "misc_voice", False), (2, 21, "Ann", ["Rob"], "minor", False)]


def library(seed):
    """Three novels of sections with dialogue, narration, actions and thoughts; two titles are front matter, one section is empty."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = []
    for novel in (1, 2, 3):
        for k in range(5):
            pars = []
            for _ in range(rng.randint(3, 16)):
                pars.append(rng.choice([f'"{say(6)}," {say(4)}.', f"{say(12)}.", f"*{say(3)}*", f'“{say(9)}” and "{say(3)}" {say(2)}', f"<em>{say(5)}</em>", f'"{say(400)}. {say(40)}."']))
            title = "Preface" if k == 0 and novel < 3 else f"Chapter {k}"
            rows.append((novel, k, title, None if (novel, k) == (3, 2) else "\n\n".join(pars)))
    return rows


def model(seed):
    """A model's answer to a request: lines reworded, dropped and renamed by the request's own content; some are cut short or no answer."""

    def answer(text, chunk, section):
        rng = random.Random(f"{seed}{text}{chunk}{section}")
        if rng.random() < 0.15:
            return rng.choice(["nothing", None, ""])
        lines = []
        for block in text.split("\n\n"):
            bare = block.strip('"*[]')
            if rng.random() < 0.25:
                continue
            line = {"speaker": rng.choice(["mina", " Rob ", "Mina Hale", "nobody", "", None, "NARRATOR", "M"]), "emotion": rng.choice(["happy", "Sad", "bogus", None, "warm"]), "emotion_intensity": rng.choice(["low", "med", "high", None])}
            line["original_text"] = rng.choice([bare, bare.upper(), " ".join(bare.split()[1:]), None, ""])
            line["raw_text"] = rng.choice(["[sigh] ", "", "[laugh] [gasp] "]) + bare
            line["associated_characters"] = rng.choice([None, ["Rob", "ROB", "x", "mina"], []])
            line["confidence"] = rng.choice([0.0, 0.7, None])
            lines.append(line)
        rng.shuffle(lines)
        body = {"entries": lines, "profile_updates": [{"character_name": rng.choice(["Rob", "m", "zz"]), "status": f"s{chunk}", "summary": "x"} for _ in range(rng.randint(0, 2))]}
        body["events"] = [{"event_type": "e", "summary": f"{chunk}.{i}", "characters_involved": ["Mina", "who"], "speakers": ["rob"], "spoiler_level": i} for i in range(rng.randint(0, 4))]
        return rng.choice(["", "<think>hm {</think>", "Sure: "]) + json.dumps(body)

    return answer


def replay(parsed, people, ask):
    """Entries, events, profiles and requests of one section after another, chunk by chunk, as a plain loop."""
    names = {}
    for novel in {p[0] for p in people}:
        own = {}
        mine = sorted(p for p in people if p[0] == novel)
        for _, i, name, aliases, _, _ in mine:
            for label in (name, *(aliases or [])):
                own[label.strip()] = own[label.strip().lower()] = (i, name)
        for label, who in (("NARRATOR", [p for p in mine if p[5]]), ("MISC_VOICE", [p for p in mine if p[4] == "misc_voice"])):
            if who:
                own[label] = own[label.lower()] = (who[0][1], who[0][2])
        own["UNKNOWN"] = own["unknown"] = (None, "UNKNOWN")
        names[novel] = own
    shape = {"dialogue": '"{}"', "thought": "*{}*", "action": "[{}]"}
    render = lambda bs: "\n\n".join(shape.get(b.block_type, "{}").format(b.text) for b in bs)
    rows, events, profiles, requests = [], {}, {}, {}
    for novel in sorted({p.novel for p in parsed}):
        seq, own = 0, names.get(novel, {})
        sections = sorted((p for p in parsed if p.novel == novel), key=lambda p: p.section_index)
        known = lambda x: own.get((x or "").strip()) or own.get((x or "").strip().lower())  # noqa: B023, E731
        for at, section in enumerate(sections):
            key = (novel, section.section_index)
            parts = [section.blocks[c.first : c.first + c.blocks] for c in section.chunks]
            history, previous = [], ""
            if at and sections[at - 1].chunks:
                last = sections[at - 1].chunks[-1]
                previous = render(sections[at - 1].blocks[last.first : last.first + last.blocks])
            for k, part in enumerate(parts):
                ahead = render(parts[k + 1]) if k + 1 < len(parts) else render(sections[at + 1].blocks[:3])[:500] if at + 1 < len(sections) else ""
                fallback = lambda b: known("NARRATOR" if b.block_type != "dialogue" else "MISC_VOICE") or (None, "UNKNOWN")  # noqa: B023, E731
                plain = lambda b, branch, sure, who=None: (*key, seq, branch, b.text, b.text, *(who or fallback(b)), "neutral", "low", (), "\n".join(history[-2:]), ahead[:200], sure)  # noqa: B023, E731
                if section.apart:
                    for b in part:
                        rows.append((*plain(b, "front", 1.0, known("MISC_VOICE") or (None, "UNKNOWN"))[:-3], "", "", 1.0))
                        seq += 1
                    continue
                if all(b.block_type != "dialogue" for b in part):
                    for b in part:
                        rows.append(plain(b, "deterministic", 1.0))
                        seq += 1
                    previous = render(part)
                    continue
                requests[(*key, k)] = (previous[:800] or "(start of section)", "\n".join(history) or "(start of novel)", render(part), ahead[:500] or "(end of section)")
                raw = ask(render(part), k, section.section_index)
                body = json.loads(raw[raw.index('{"entries') :]) if raw and "{" in raw else None
                if body is None:
                    for b in part:
                        rows.append(plain(b, "failed", 0.0))
                        seq += 1
                    continue
                left = list(enumerate(body["entries"]))
                for b in part:
                    best, top = None, 0.0
                    for i, e in left:
                        said = (e["original_text"] or e["raw_text"] or "").strip()
                        x, y = set(b.text.lower().split()), set(said.lower().split())
                        if not said:
                            continue
                        score = len(x & y) / max(len(x), len(y)) + (0.5 if said.lower() in b.text.lower() or b.text.lower() in said.lower() else 0)
                        if score > top + 1e-9:
                            best, top = (i, e), score
                    if best is None or top <= 0.3:
                        rows.append(plain(b, "unmatched", 0.0))
                    else:
                        left.remove(best)
                        e = best[1]
                        label = e["speaker"] if e["speaker"] is not None else "NARRATOR"
                        who = (known(label) if label.strip() else None) or fallback(b)
                        emotion = (e["emotion"] or "neutral").lower()
                        emotion = emotion if emotion in T.EMOTIONS else "neutral"
                        intensity = e["emotion_intensity"] or "low"
                        intensity = intensity if intensity in T.EMOTIONS[emotion] else "low"
                        tag = next((t + " " for t in T.TAGS if t in e["raw_text"]), "")
                        ids = list(dict.fromkeys(known(x)[0] for x in e["associated_characters"] or [] if known(x)))
                        rows.append((*key, seq, "matched", tag + b.text, b.text, *who, emotion, intensity, tuple(ids), "\n".join(history[-2:]), ahead[:200], e["confidence"] or 0.5))
                        text = tag + b.text
                        history = [*history, f"{who[1]}: {emotion}_{intensity} — {text[:60]}" + ("..." if len(text) > 60 else "")][-8:]
                    seq += 1
                for u in body["profile_updates"]:
                    if known(u["character_name"]):
                        profiles[(*key, known(u["character_name"])[0])] = u["status"]
                for i, e in enumerate(body["events"]):
                    named = lambda xs: tuple(dict.fromkeys(known(x)[0] for x in xs if known(x)))  # noqa: B023, E731
                    events[(*key, seq + i)] = (e["summary"], named(e["characters_involved"]), named(e["speakers"]), e["spoiler_level"])
                previous = render(part)
    return rows, profiles, events, requests


@pytest.fixture(scope="module")
def case(spark):
    sections = spark.createDataFrame(library(5), "novel int, section_index int, title string, text string")
    parsed = answers.parsed_sections(sections, spark.createDataFrame([(3, 4)], "novel int, section_index int")).cache()
    people = spark.createDataFrame(PEOPLE, "novel int, character_id long, name string, aliases array<string>, role string, is_narrator boolean")
    lookup = cast.label_lookup(people).cache()
    said = model(5)
    return parsed, lookup, said, replay(parsed.collect(), PEOPLE, said)


def asked(said, stop=None):
    """A model over request tables that can be told to die; counts what it is asked."""
    calls = []

    def ask(requests):
        if stop is not None and len(calls) == stop:
            raise RuntimeError("killed")
        calls.append(1)
        reply = F.udf(said)
        return requests.withColumn("raw", reply("text", "chunk", "section_index"))

    return ask, calls


def told(table):
    return [
        (r.novel, r.section_index, r.sequence_number, r.branch, r.raw_text, r.original_text, r.speaker_id, r.speaker_name, r.emotion, r.emotion_intensity, tuple(r.associated_characters), r.context_before, r.context_after, r.confidence)
        for r in table.orderBy("novel", "sequence_number").collect()
    ]


def test_a_killed_run_goes_on_and_all_tables_equal_the_replay(spark, case, tmp_path):
    parsed, lookup, said, (rows, profiles, events, requests) = case
    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        rounds.run(parsed, lookup, asked(said, stop=2)[0], folder)
    ask, calls = asked(said)
    raw = rounds.run(parsed, lookup, ask, folder)
    per_section = max(sum(1 for q in requests if q[:2] == s) for s in {q[:2] for q in requests})
    assert per_section >= 4 and len(calls) == per_section - 2
    asked_for = [r for k in range(per_section) for r in spark.read.parquet(f"{folder}/requests={k}").collect()]
    assert {(r.novel, r.section_index, r.chunk): (r.before, r.history, r.text, r.ahead) for r in asked_for} == requests and len(asked_for) == len(requests)

    made = answers.section_tables(parsed, raw, lookup)
    assert told(made["dialogue_entries"]) == rows
    assert {"front", "deterministic", "failed", "unmatched", "matched"} == {r[3] for r in rows}
    assert {(r.novel, r.section_index, r.character_id): r.status for r in made["character_profiles"].collect()} == profiles and profiles
    got = {(r.novel, r.section_index, r.sequence_number): (r.summary, tuple(r.characters_involved), tuple(r.speakers), r.spoiler_level) for r in made["novel_events"].collect()}
    assert got == events and events
    tables.write_together(made, str(tmp_path / "out"), "r1")
    assert tables.published(spark, str(tmp_path / "out"), "dialogue_entries").count() == len(rows)
    assert sum(r.entries for r in tables.published(spark, str(tmp_path / "out"), "parse_progress").collect()) == len(rows)


def test_one_exchange_by_section(spark, case):
    """Every input is dealt out by section once, and nothing after the join is dealt out again."""
    lookup = case[1]
    parsed = answers.parsed_sections(spark.createDataFrame(library(5), "novel int, section_index int, title string, text string"))
    raw = spark.createDataFrame([(1, 1, 0, "{}")], "novel int, section_index int, chunk int, raw string")
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in answers.section_tables(parsed, raw, lookup).items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
            dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(novel" in line and "section_index" in line]
            assert len(dealt) == 3, (name, plan)
            assert all(line.split("hashpartitioning(")[1].split(")")[0].count("#") == 2 for line in dealt), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_no_sections_and_no_answers(spark, case, tmp_path):
    parsed, lookup, said, _ = case
    none = spark.createDataFrame([], "novel int, section_index int, chunk int, raw string")
    made = answers.section_tables(parsed, none, lookup)
    assert {r.branch for r in made["dialogue_entries"].select("branch").distinct().collect()} == {"front", "deterministic", "failed"}
    empty = answers.section_tables(parsed.limit(0), none, lookup)
    assert all(df.count() == 0 for df in empty.values())
    assert rounds.run(parsed.filter("novel = 99"), lookup, asked(said)[0], str(tmp_path / "r")).count() == 0
