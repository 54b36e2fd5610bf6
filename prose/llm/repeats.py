"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A word is removed if it is covered by a window whose words
also start a window in a document with a smaller doc_id. The work is split by content, so that no
document meets every automaton and no window is shuffled on its own:

1. Anchors. The anchor of a window is the least hash of its ``PHRASE``-word phrases. Equal windows
   have equal anchors, and neighbouring windows mostly share one; a run of them is a piece. Only
   (anchor, doc_id) is counted, pre-aggregated; anchors of two or more documents recur.
2. Pieces. Documents that hold recurring anchors give their pieces with those anchors, as 64-bit hashes
   beside the anchor; equal pieces fold into one with the least doc_id. An anchor with one piece needs nothing
   more; of the others, each piece's text is read off once, from the document with the least doc_id.
3. Confirmation. Of the pieces of an anchor, the windows that stand in several places are confirmed, by
   128-bit hash: what merely surrounds a recurring passage is not compiled.
4. Automata. Confirmed windows are sharded by anchor and compiled into Aho-Corasick automata of
   ``AUTOMATON_WINDOWS`` windows each, every window with the least doc_id that holds it. All pieces of all
   documents with these anchors are streamed through to locate every occurrence. Words are letters of the
   automaton, so matches are exact. An anchor of more than ``TASK_PIECES`` pieces is confirmed by a
   pre-aggregated count, and its pieces are spread over tasks, each with the anchor's automata.
5. Removal. Occurrences take the owners of their piece's windows; those before the document mark it.

Cases with a defined result: null text has no words; rows without doc_id are left alone and mark
nothing; repeated rows of a doc_id are treated alike and do not mark each other; texts shorter than
a window are kept; a very long text becomes many pieces of 92 words at most; of several documents that hold a
window the one with the least doc_id owns it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut
from .wordhash import Words, range_hash, sliding_min, split_words, text_slices

WINDOW = 50
PHRASE = 8
#: Pieces of an anchor that one task resolves, and about as many of its windows as they meet there at once.
TASK_PIECES, TASK_WINDOWS = 20_000, 20_000
#: Windows compiled into one automaton, and windows of the anchors that are resolved at once.
AUTOMATON_WINDOWS = 10_000


def pieces_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, number of windows) of the runs of windows that share an anchor."""
    n = len(words.starts)
    none = np.empty(0, dtype=np.int64)
    if n < WINDOW:
        return none, none.astype(np.uint64), none, none
    at = np.arange(n - PHRASE + 1)
    anchor = sliding_min(range_hash(words.hashes, at, at + PHRASE, seed=1), WINDOW - PHRASE + 1)
    doc = words.doc_of()
    count = len(anchor)
    whole = doc[:count] == doc[WINDOW - 1 : WINDOW - 1 + count]
    new = np.ones(count, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:count] != doc[: count - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, count))
    keep = whole[first]
    first, size = first[keep], size[keep]
    return doc[first], anchor[first], first, size


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id), each pair once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in text_slices(batch.column(1)):
                doc, anchor, _, _ = pieces_of(split_words(data, offsets))
                found = np.unique(np.stack([anchor.view(np.int64), ids[row + doc]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors): of every document that holds anchors of two or more documents, those anchors."""
    anchors = _anchors(docs)
    counted = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    counted = counted.filter("low < high").select("anchor")
    return anchors.join(counted, "anchor").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("anchor").alias("anchors"))


def _piece_ids(words: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return range_hash(words.hashes, first, first + size + WINDOW - 1).view(np.int64)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, id, doc_id, first, size): pieces with recurring anchors, their places and numbers of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors = batch.column(0).to_numpy(), batch.column(2)
            for row, stop, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets)
                doc, anchor, first, size = pieces_of(words)
                wanted = np.isin(anchor.view(np.int64), anchors[row:stop].flatten().to_numpy())
                doc, anchor, first, size = doc[wanted], anchor[wanted], first[wanted], size[wanted]
                values = (anchor.view(np.int64), _piece_ids(words, first, size), ids[row + doc], first - words.first[doc], size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], ["anchor", "id", "doc_id", "first", "size"])

    found = docs.join(recurring(docs), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "anchors")
    return found.mapInArrow(run, "anchor long, id long, doc_id long, first long, size long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, id, owner, n, piece) of wanted pieces (anchor, id, owner, first, size, n): words joined by one space, off the owner's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for owner, text, pieces in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                for p in pieces:
                    piece = b" ".join(words[p["first"] : p["first"] + p["size"] + WINDOW - 1]).decode()
                    out.append((p["anchor"], p["id"], owner, p["n"], piece))
            columns = list(zip(*out, strict=True)) or [()] * 5
            # Another row of the same doc_id can have another text: pieces that are not the wanted ones go.
            found = split_words(*_joined(columns[4]))
            same = _piece_ids(found, found.first[:-1], np.diff(found.first) - WINDOW + 1) == np.array(columns[1], dtype=np.int64)
            types = (pa.int64(),) * 4 + (pa.string(),)
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "id", "owner", "n", "piece"])
            yield rows.filter(pa.array(same))

    per = wanted.groupBy(F.col("owner").alias("_id")).agg(F.collect_list(F.struct("anchor", "id", "first", "size", "n")).alias("pieces"))
    joined = docs.join(per, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "pieces")
    return joined.mapInArrow(run, "anchor long, id long, owner long, n long, piece string")


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, one after the other."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)


def _runs(owners: list[int]) -> list[dict]:
    out: list[dict] = []
    for k, owner in enumerate(owners):
        if out and out[-1]["owner"] == owner:
            out[-1]["b"] = k + 1
        else:
            out.append({"a": k, "b": k + 1, "owner": owner})
    return out


def automata(windows: list[tuple[int, list[str]]]) -> Iterator[tuple[ahocorasick.Automaton, dict[str, str]]]:
    """Automata of (owner, words), so many windows each, and the letters of each one's words."""
    for k in range(0, len(windows), AUTOMATON_WINDOWS):
        letters: dict[str, str] = {}
        automaton = ahocorasick.Automaton()
        for owner, words in windows[k : k + AUTOMATON_WINDOWS]:
            for w in words:
                if w not in letters:
                    n = len(letters) + 0x100
                    letters[w] = chr(n if n < 0xD800 else n + 0x800)
            automaton.add_word("".join(map(letters.__getitem__, words)), owner)
        automaton.make_automaton()
        yield automaton, letters


def locate(pieces: list[tuple[int, list[str]]], windows: list[tuple[int, list[str]]]) -> list[list[int]]:
    """Of every (owner, words): the owner of each of its windows, its own if the window is not among ``windows``."""
    owners = [[owner] * (len(words) - WINDOW + 1) for owner, words in pieces]
    for automaton, letters in automata(windows):
        for (_, words), found in zip(pieces, owners, strict=True):
            for end, owner in automaton.iter("".join([letters.get(w, "\0") for w in words])):
                found[end - WINDOW + 1] = min(owner, found[end - WINDOW + 1])
    return owners


_RUNS = "array<struct<a:int,b:int,owner:bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("owner", pa.int64())]))


def _window_hashes(pieces: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first piece, piece of each window, window's place in it, its two hashes) of slices of pieces."""
    for row, _, data, offsets in text_slices(pieces):
        words = split_words(data, offsets)
        size = np.diff(words.first) - WINDOW + 1
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        start = words.first[of] + at
        yield row, of, at, [range_hash(words.hashes, start, start + WINDOW, seed=s) for s in (0, 1)]


def confirmed(pieces: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(owner, piece, place) of every window that stands in several places of the (owner, text), with the least owner."""
    owner = np.array([o for o, _ in pieces])
    parts = [(row + of, at, *hashes) for row, of, at, hashes in _window_hashes(pa.array([p for _, p in pieces], pa.string()))]
    of, at, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((owner[of], h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    first = np.flatnonzero(new)
    least = order[first[np.diff(np.append(first, len(order))) > 1]]
    return list(zip(owner[of[least]].tolist(), of[least].tolist(), at[least].tolist(), strict=True))


def _resolved(anchors: list[int], ids: list[int], owners: list[list[int]]) -> pa.RecordBatch:
    runs = pa.array([_runs(x) for x in owners], _RUNS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(ids, pa.int64()), runs], ["anchor", "id", "runs"])


def _resolve(pieces: DataFrame) -> DataFrame:
    """(anchor, id, runs) of pieces (anchor, id, owner, piece), a task holding all pieces of an anchor."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        split = [(r[2], r[3].split(" ")) for r in rows]
        windows = [(owner, split[k][1][a : a + WINDOW]) for owner, k, a in confirmed([r[2:4] for r in rows])]
        return _resolved([r[0] for r in rows], [r[1] for r in rows], locate(split, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        windows = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "id", "owner", "piece"))
            for anchor, key, owner, piece in zip(*columns, strict=True):
                if waiting and waiting[-1][:2] == (anchor, key):
                    continue  # a repeated row of the owner
                if windows >= AUTOMATON_WINDOWS and waiting[-1][0] != anchor:
                    yield solve(waiting)
                    waiting, windows = [], 0
                waiting.append((anchor, key, owner, piece))
                windows += piece.count(" ") + 2 - WINDOW
        if waiting:
            yield solve(waiting)

    sharded = pieces.repartition("anchor").sortWithinPartitions("anchor", "owner", "id")
    return sharded.mapInArrow(run, f"anchor long, id long, runs {_RUNS}")


def _resolve_wide(pieces: DataFrame) -> DataFrame:
    """As ``_resolve``, for anchors with very many pieces (``n`` of them): confirmed by a count, pieces and windows spread over tasks.

    Windows are dealt to shards by their hash, and every share of the pieces meets every shard, so a task holds a bounded
    number of both. A piece has a row for every shard; the windows that some row finds are those that the document shares.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("anchor", "id", "owner")]
            for row, of, at, hashes in _window_hashes(batch.column("piece")):
                values = [pa.array(h.view(np.int64)) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k[row + of]) for k in keys), pa.array(at.astype(np.int32)), *values],
                    ["anchor", "id", "owner", "a", "h1", "h2"],
                )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows, waiting = None, [], []

        def solved() -> pa.RecordBatch:
            found = locate([(o, p.split(" ")) for _, o, p in waiting], windows)
            return _resolved([group[0]] * len(waiting), [k for k, _, _ in waiting], found)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "shard", "salt", "id", "owner", "piece"))
            for anchor, shard, salt, key, owner, text in zip(*columns, strict=True):
                if (anchor, shard, salt) != group:
                    if waiting:
                        yield solved()
                    group, windows, waiting = (anchor, shard, salt), [], []
                if waiting and waiting[-1][0] == key:
                    continue
                if key is None:
                    windows.append((owner, text.split(" ")))
                else:
                    waiting.append((key, owner, text))
                    if len(waiting) >= TASK_PIECES:
                        yield solved()
                        waiting = []
        if waiting:
            yield solved()

    kind = "anchor long, id long, owner long, a int, h1 long, h2 long"
    windows = pieces.select("anchor", "id", "owner", "piece").mapInArrow(hashed, kind)
    several = windows.groupBy("anchor", "h1", "h2").agg(F.min(F.struct("owner", "id", "a")).alias("x"), F.count("*").alias("many")).filter("many > 1")
    several = cut(several.select("anchor", "h1", "x.owner", "x.id", "x.a"))
    shards = several.groupBy("anchor").agg((F.floor(F.count("*") / TASK_WINDOWS) + 1).cast("int").alias("shards"))
    salts = (F.col("n") / TASK_PIECES).cast("int") + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    texts = several.join(pieces.select("anchor", "id", "piece", salts.alias("salts")), ["anchor", "id"]).join(shards, "anchor")
    words = F.array_join(F.slice(F.split("piece", " "), F.col("a") + 1, F.lit(WINDOW)), " ")
    shard = F.pmod("h1", F.col("shards")).cast("int").alias("shard")
    patterns = texts.select("anchor", shard, each(F.col("salts")).alias("salt"), F.lit(None).cast("long").alias("id"), "owner", words.alias("piece"))
    spread = pieces.join(shards, "anchor", "left").select(
        "anchor", each(F.coalesce("shards", F.lit(1))).alias("shard"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), "id", "owner", "piece"
    )
    # Nulls first: the windows of a shard come before the pieces.
    dealt = spread.unionByName(patterns).repartition("anchor", "shard", "salt").sortWithinPartitions("anchor", "shard", "salt", "id")
    return dealt.mapInArrow(stream, f"anchor long, id long, runs {_RUNS}")


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): of every document with words to remove, the spans [a, b) of word numbers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    found = cut(_occurrences(docs))
    folded = found.groupBy("anchor", "id").agg(F.min(F.struct("doc_id", "first")).alias("x"), F.first("size").cast("int").alias("size"))
    folded = cut(folded.select("anchor", "id", F.col("x.doc_id").alias("owner"), F.col("x.first").alias("first"), "size"))
    counted = folded.join(folded.groupBy("anchor").agg(F.count("*").alias("n")), "anchor")
    texts = cut(_texts(docs, counted.filter("n > 1")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"), F.col("owner").alias("owner"))).cast(_RUNS)
    runs = (
        counted.filter("n = 1").select("anchor", "id", whole.alias("runs"))
        .unionByName(_resolve(texts.filter(F.col("n") <= TASK_PIECES).drop("n")))
        .unionByName(_resolve_wide(texts.filter(F.col("n") > TASK_PIECES)))
    )
    # Only pieces of documents after the first owner can have words to remove.
    placed = found.select("anchor", "id", "doc_id", "first").distinct().join(runs, ["anchor", "id"])
    spans = F.transform(
        F.filter("runs", lambda r: r["owner"] < F.col("doc_id")),
        lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + (WINDOW - 1)).alias("b")),
    )
    return placed.select("doc_id", F.explode(spans).alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [s["a"] for s in spans], 1)
                    np.add.at(edge, [s["b"] for s in spans], -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone = len(words) - len(left)
                    words_left = [words[k] for k in left]
                else:
                    words_left = words
                total.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words_left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = marks(docs).withColumnRenamed("doc_id", "_id")
    joined = source.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
