"""Streams over folders of files in any order against their batch forms, and what a batch writes."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from prose.plans.queries import QUERIES
from prose.streaming import jobs

SF = "/root/testdata/sf0.001"


def folder_of(spark, tmp_path, name, files):
    """A table as a folder of files that arrive in another order than their rows are in."""
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    df.repartition(files, F.rand(3)).write.parquet(f"{tmp_path}/{name}.parquet")
    for k, part in enumerate(sorted((tmp_path / f"{name}.parquet").glob("*.parquet"))):
        os.utime(part, (1_700_000_000 + 10 * (k * 7 % files),) * 2)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["stream_progress", "stream_toggles", "stream_chat_state", "stream_blocks", "stream_progress_count", "stream_activity"])
def test_a_folder_gives_what_a_single_file_gives(spark, tmp_path, monkeypatch, name):
    table = {"stream_blocks": "documents", "stream_chat_state": "conversations"}.get(name, "events")
    folder_of(spark, tmp_path, table, 5)
    # Files of other tables, and of names that begin alike, are not read.
    shutil.copy(f"{SF}/{table}.parquet", tmp_path / f"{table}_old.parquet")
    feed = jobs.feed
    monkeypatch.setattr(jobs, "feed", lambda spark, d, table: feed(spark, d, table, files=2))
    got, want = rows(QUERIES[name](spark, str(tmp_path))), rows(QUERIES[name](spark, SF))
    assert got == want and want


def events_in(spark, tmp_path, batches, per):
    """A folder to which a file of events is added for every batch; readers are new in every file but for one."""
    kind = "event_id long, user_id long, event_type string, props string, ts string"
    for k in range(batches):
        some = [(k * per + i, 0 if i == 0 else k * per + i, "view", f'{{"k": {k}}}', f"2025-01-{k + 1:02}") for i in range(per)]
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_batch_writes_what_it_changed_and_the_state_folds_in_parts(spark, tmp_path):
    per, batches = 40, 6
    keys, schema = ["reader_id", "novel"], "reader_id long, novel int, section_index int"
    stream = jobs.latest_progress(events_in(spark, tmp_path, batches, per))
    changed = jobs.finished(stream, "update", f"{tmp_path}/out")
    counts = [r["count"] for r in changed.groupBy("batch").count().orderBy("batch").collect()]
    assert counts == [per] * batches  # not the keys of all batches before
    state = rows(jobs.last_states(changed, *keys))
    assert len(state) > per * batches / 2
    folded = jobs.folded_states(spark, f"{tmp_path}/out", keys, schema, parts=8)
    assert rows(folded) == state
    # Another file: only parts that its keys fall into are written again; a second run changes nothing.
    stamp = lambda: {p: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in (tmp_path / "out" / "state").glob("part=*")}
    before = stamp()
    kind = "event_id long, user_id long, event_type string, props string, ts string"
    spark.createDataFrame([(0, 0, "view", '{"k": 77}', "2026-01-01")], kind).write.mode("append").parquet(f"{tmp_path}/in")
    again = jobs.latest_progress(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    state = rows(jobs.last_states(jobs.finished(again, "update", f"{tmp_path}/out"), *keys))
    assert rows(jobs.folded_states(spark, f"{tmp_path}/out", keys, schema, parts=8)) == state and "(0, 0, 77)" in state
    after = stamp()
    assert sum(before[p] != after[p] for p in before) == 1
    shutil.rmtree(tmp_path / "out" / "folded")  # as if killed before its last write
    assert rows(jobs.folded_states(spark, f"{tmp_path}/out", keys, schema, parts=8)) == state


def test_no_batch_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kind = "event_id long, user_id long, event_type string, props string, ts string"
    nothing = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    assert jobs.finished(jobs.latest_progress(nothing), "update", f"{tmp_path}/out").count() == 0


def folds(messages, budget, keep):
    """One message after another."""
    out, open_, mark = [], {}, {}
    for session, i, role, content, upto in sorted(messages, key=lambda m: (m[0], m[1])):
        if i <= mark.get(session, -1 if upto is None else upto):
            continue
        held = open_.setdefault(session, [])
        held.append((i, f"{'You' if role == 'character' else 'User'}: {content or ''}", len(content or "") // 4))
        if sum(t for *_, t in held) > budget and len(held) > keep:
            out.append((session, held[-keep - 1][0], len(held) - keep, "\n".join(x for _, x, _ in held[:-keep])))
            mark[session], open_[session] = held[-keep - 1][0], held[-keep:]
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_folds_do_not_depend_on_batches(spark, tmp_path, batches):
    rng = random.Random(1)
    messages = [(s, i, rng.choice(["user", "character"]), rng.choice([None, "", "x" * rng.randint(1, 90)]), rng.choice([None, 2])) for s in range(6) for i in range(30)]
    # What lies before the watermark is the same for all messages of a session.
    messages = [(s, i, r, c, 2 if s % 2 else None) for s, i, r, c, _ in messages]
    kind = "session long, id long, role string, content string, summary_upto long"
    for k in range(batches):
        part = [m for m in messages if m[1] * batches // 30 == k]
        rng.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        newest = max((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with jobs.state_in_rocksdb(spark):
        out = jobs.finished(jobs.compactions(stream, 60, 3), "append", f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out.collect()) == folds(messages, 60, 3) and out.count() > 10
