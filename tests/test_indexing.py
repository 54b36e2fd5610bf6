"""The index job against one chapter after another."""

import bisect
import random
import uuid

from prose.operators import indexing, segment
from prose.sources import tables

SECTION = "novel int, section_index int, title string, text string"
ENTRY = "novel int, section_index int, sequence_number int, original_text string, raw_text string, speaker_name string, associated array<long>"


def case(seed):
    rng = random.Random(seed)
    sections, entries, events = [], [], []
    for novel in (1, 2):
        for k in range(4):
            lines = [" ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=rng.randint(1, 9))) + "." for _ in range(rng.randint(0, 30))]
            sections.append((novel, k, f"t{k}", None if (novel, k) == (2, 3) else "\n\n".join(lines)))
            for n, line in enumerate(lines):
                if rng.random() < 0.8:
                    said = rng.choice([line, line, line[: len(line) // 2], "not there at all", "", None])
                    entries.append((novel, k, n, said, rng.choice([line, None, ""]), rng.choice(["Ann", "Bob", "", None]), rng.choice([None, [], [1, 2], [9, 2, 2]])))
                if rng.random() < 0.2:
                    events.append((novel, k, len(events), n, rng.choice([None, 1, 5])))
    return sections, entries, events


def by_hand(sections, entries, events, names, size, overlap):
    out, serial = {}, {}
    for novel, k, title, text in sorted(sections, key=lambda s: s[:2]):
        text = text or ""
        chunks = []
        for i, (a, _, b, _, _) in enumerate(segment.chunk_spans(text, size, overlap)):
            chunks.append({"serial": serial.get(novel, 0), "a": a, "b": b, "text": text[a:b], "speakers": [], "names": [], "events": [], "level": 0})
            serial[novel] = serial.get(novel, 0) + 1
        if not chunks:
            continue
        cursor, placed = 0, []
        for _, _, n, said, raw, speaker, ids in sorted(e for e in entries if e[:2] == (novel, k)):
            needle = said or raw or ""
            at = text.find(needle, cursor) if needle else -1
            at = text.find(needle) if at < 0 and needle else at
            at = text.find(needle[:48], cursor) if at < 0 and needle else at
            if at >= 0:
                cursor = at + max(1, len(needle))
            else:
                at = cursor
            chunk = next((c for c in chunks if c["a"] <= at < c["b"]), None) or min(chunks, key=lambda c: abs(c["a"] - at))
            placed.append((n, chunk))
            if speaker and speaker not in chunk["speakers"]:
                chunk["speakers"].append(speaker)
            chunk["names"] += [names[i] for i in dict.fromkeys(ids or []) if i in names and names[i] not in chunk["names"]]
        for _, _, event, n, level in (e for e in events if e[:2] == (novel, k)):
            at = bisect.bisect_right([p for p, _ in placed], n) - 1
            chunk = placed[at][1] if at >= 0 else chunks[0]
            chunk["events"].append((n, event))
            chunk["level"] = max(chunk["level"], level or 0)
        for i, c in enumerate(chunks):
            key = str(uuid.uuid5(uuid.UUID(indexing.NAMESPACE), f"u{novel}:{c['serial']}"))
            out[key] = (f"u{novel}", "s", novel, k, title, c["serial"], i, c["a"], c["b"], c["text"], tuple(c["speakers"]), tuple(c["names"]), tuple(e for _, e in sorted(c["events"])), c["level"])
    return out


def test_all_rows_equal_the_loop(spark, tmp_path):
    sections, entries, events = case(3)
    names = {1: "Mina", 2: "Rob"}
    books = spark.createDataFrame([(n, f"u{n}", "s", n) for n in (1, 2)], "novel int, novel_uuid string, series_key string, novel_number int")
    people = spark.createDataFrame(list(names.items()), "character_id long, name string")
    s = spark.createDataFrame(sections, SECTION)
    chunks = indexing.chunk_table(s, 25, 6)
    rows = indexing.index_rows(s, spark.createDataFrame(entries, ENTRY), spark.createDataFrame(events, "novel int, section_index int, event_id long, sequence_number int, spoiler_level int"), people, books, chunks)
    tables.rewrite_index(rows, str(tmp_path / "index"))
    tables.rewrite_index(rows, str(tmp_path / "index"))  # once more: nothing doubles
    stored = spark.read.parquet(str(tmp_path / "index")).select(*rows.columns)
    got = {r.id: tuple(tuple(x) if isinstance(x, list) else x for x in r[:-1]) for r in stored.collect()}
    want = by_hand(sections, entries, events, names, 25, 6)
    assert stored.count() == len(want) and got == want
    assert sum(len(w[10]) for w in want.values()) > 10 and sum(len(w[12]) for w in want.values()) == len([e for e in events if e[:2] != (2, 3)])


def test_a_tokenizer_measures_chunks(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        return
    measure = segment.bpe_measure(path)
    text = "\n\n".join(" ".join(f"word{k}x{j}" for j in range(9)) + "." for k in range(40))
    rows = indexing.chunk_table(spark.createDataFrame([(1, 0, "t", text)], SECTION), 120, 20, measure).collect()
    whole = segment.chunk_spans(text, 120, 20, segment.bpe_measure(path))
    assert [(r.char_start, r.char_end) for r in rows] == [(a, b) for a, _, b, _, _ in whole] and len(rows) > 5
    assert all(n <= 120 and measure(text[a:b]) <= n + 20 for _, a, b, n, _ in whole)
