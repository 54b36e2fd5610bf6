"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens.

A node is a distinct sequence of turns from the start of a conversation. Every node's turn is
rendered and tokenised once; nodes are laid out depth-first in one token stream, a tree after the
other. A node carries its place in the stream, the position of its first token within a
conversation, and the stream intervals of its ancestors, which are all that its tokens may attend to
besides earlier tokens of the node itself.

Template: ``<|turn|>role\\n`` + text + ``<|end|>\\n``. In texts and roles ``\\`` becomes ``\\\\``, ``<``
becomes ``\\l`` and ``[`` becomes ``\\b`` (in roles also a line feed ``\\n``), so that neither this
template's marks nor those of others can occur in them; the escapes are undone exactly.

Nodes are found without comparing conversations: a node's key is the exclusive-or of 128-bit hashes
of (place, role, text) over its turns, a running aggregate. Keys are pre-aggregated before their
shuffle, so a first turn that a third of all conversations share is one row per task. Turns are rendered
and tokenised once, into a written table.

A node is owned by the least conversation, by a hash, that goes through it, so the nodes that a conversation owns are a
segment: its last turns, from some turn on. A segment lies in the stream in one piece, and what hangs from it follows it, from its
deepest turn to its first, which is depth-first order. The turns of a conversation lie in few segments, a logarithm of the
number of conversations, since along a path the least of ever fewer hashes seldom changes; only these pieces, not turns,
make up the key of the order and the ancestors of a node, so a conversation of any number of turns costs what its turns do. Order comes
from range partitions of segments with lengths alone, and partial sums per partition. Branches meet what they hang from in a
plain equi-join, in which adaptive execution splits the many of a common first turn.

Cases with a defined result: null role, text and turn count as empty, empty and first; rows are taken
by turn, then role, then text, so repeated rows are repeated turns; rows with a null conv_id are one
conversation; an empty table gives empty results; extra columns are ignored. A conversation is one
record and fits a task's memory, as it does any trainer's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, discard

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"
_ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_UNESCAPE = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_RENDERED = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_NODE = ["k1", "k2", "level"]
_SEGMENT = ["o1", "o2"]
_TOKENIZERS: dict = {}


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPE[m[0]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPE[m[1]], text)


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, its hash c1, c2, and level, role, text and key k1, k2 of the node of every turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("level", F.row_number().over(order) - 1)
    rows = rows.withColumns(
        {"h1": F.xxhash64("level", "role", "text"), "h2": F.xxhash64("text", F.lit("|"), "role", F.col("level") + 7)}
    )
    so_far = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k1": F.bit_xor("h1").over(so_far), "k2": F.bit_xor("h2").over(so_far)})
    return rows.withColumns({"c1": F.xxhash64("conv_id"), "c2": F.xxhash64(F.lit("|"), "conv_id")}).drop("h1", "h2", "turn")


def _render(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ids, the loss span [loss_start, loss_stop) within them, formatted_chars and length; drops role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            heads = [f"{TURN}{escape_role(r)}\n" for r in roles]
            bodies = [escape(t) for t in texts]
            encode = lambda x: [e.ids for e in _tokenizer(tokenizer).encode_batch_fast(x, add_special_tokens=False)]
            parts = list(zip(encode(heads), encode(bodies), encode([f"{END}\n"] * len(roles)), strict=True))
            lossy = [r == LOSS_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*_NODE, *_SEGMENT)]
                + [
                    pa.array([a + b + c for a, b, c in parts], pa.list_(pa.int32())),
                    pa.array([len(a) for a, _, _ in parts], pa.int64()),
                    pa.array([len(a) + len(b) * k for (a, b, _), k in zip(parts, lossy, strict=True)], pa.int64()),
                    pa.array([len(a) + len(b) + len(END) + 1 for a, b in zip(heads, bodies, strict=True)], pa.int64()),
                ],
                [*_NODE, *_SEGMENT, "ids", "loss_start", "loss_stop", "formatted_chars"],
            )

    schema = "k1 long, k2 long, level int, o1 long, o2 long, ids array<int>, loss_start long, loss_stop long, formatted_chars long"
    return nodes.select(*_NODE, *_SEGMENT, "role", "text").mapInArrow(run, schema)


def _laid_out(segments: DataFrame) -> DataFrame:
    """(o1, o2, seg_start) of segments (o1, o2, pieces, length): places in the stream, in the order of what they hang from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            ends = done + np.cumsum(length)
            done = int(ends[-1]) if len(ends) else done
            parts = pa.array(np.full(len(length), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([parts, *(batch.column(c) for c in _SEGMENT), pa.array(ends - length), batch.column("length")], ["part", *_SEGMENT, "local", "length"])

    # What hangs deeper comes first; a segment comes before all that hangs from it, as its key begins theirs.
    key = F.transform("pieces", lambda p: F.struct((-p["first"]).alias("up"), p["o1"].alias("o1"), p["o2"].alias("o2")))
    ordered = segments.select(key.alias("key"), *_SEGMENT, "length").repartitionByRange("key").sortWithinPartitions("key")
    placed = cut(ordered.mapInArrow(run, "part int, o1 long, o2 long, local long, length long"))
    # One row per partition.
    before = placed.groupBy("part").agg(F.sum("length").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return placed.join(F.broadcast(before), "part").select(*_SEGMENT, (F.col("local") + F.col("before")).alias("seg_start"))


def _merged(intervals: Column) -> Column:
    """Touching intervals of an array of struct<start, stop> in order as one."""
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    last = lambda done: F.get(done, F.size(done) - 1)
    one = lambda start, stop: F.array(F.struct(start.alias("start"), stop.alias("stop")))
    return F.aggregate(
        intervals,
        none,
        lambda done, x: F.when(
            F.coalesce(last(done)["stop"] == x["start"], F.lit(False)),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), one(last(done)["start"], x["stop"])),
        ).otherwise(F.concat(done, one(x["start"], x["stop"]))),
    )


def format_tree(conversations: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and (conv_id, k1, k2, level) of the last node of every conversation.

    Nodes: key, segment o1, o2, ids, loss_start and loss_stop within ids, formatted_chars, ``start`` and ``length`` in
    the stream, ``position`` of the first token, ``tree`` (segment of its root), ``ancestors``, array of
    struct<start, stop> in stream order with touching intervals merged, and ``pieces``, array of struct<first, o1, o2, upto>: the
    segments and levels that its path from the root goes through, itself included.
    """
    rows = turns(conversations)
    tokens, last = format_tokens(rows, tokenizer)
    sized = tokens.withColumn("length", F.size("ids").cast("long")).select(*_NODE, *_SEGMENT, "length")
    # Where every conversation goes through which segment: few rows for each, added up before they are shuffled.
    through = rows.select("c1", "c2", *_NODE).join(sized.select(*_NODE, *_SEGMENT), _NODE)
    pieces = cut(through.groupBy("c1", "c2", *_SEGMENT).agg(F.min("level").cast("int").alias("first"), F.max("level").cast("int").alias("upto")))
    own = pieces.groupBy("c1", "c2").agg(
        F.sort_array(F.collect_list(F.struct("first", *_SEGMENT, "upto"))).alias("pieces"), F.bool_or((F.col("c1") == F.col("o1")) & (F.col("c2") == F.col("o2"))).alias("owns")
    ).filter("owns").select(F.col("c1").alias("o1"), F.col("c2").alias("o2"), "pieces")
    lengths = sized.groupBy(*_SEGMENT).agg(F.sum("length").alias("length"))
    segments = cut(own.join(lengths, _SEGMENT))
    along = Window.partitionBy(*_SEGMENT).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    begins = sized.withColumn("_offset", F.coalesce(F.sum("length").over(along), F.lit(0))).join(_laid_out(segments), _SEGMENT)
    places = cut(begins.select(*_NODE, *_SEGMENT, "length", "seg_start", (F.col("seg_start") + F.col("_offset")).alias("start")))
    # A segment's ancestors: of every piece before its own, from the piece's first turn to the one that it hangs from.
    hung = segments.select(F.col("o1").alias("s1"), F.col("o2").alias("s2"), F.explode("pieces").alias("p")).select("s1", "s2", "p.o1", "p.o2", F.col("p.upto").alias("level"))
    above = hung.filter("o1 <> s1 or o2 <> s2").join(places.select(*_SEGMENT, "level", "seg_start", (F.col("start") + F.col("length")).alias("stop")), [*_SEGMENT, "level"])
    above = above.groupBy(F.col("s1").alias("o1"), F.col("s2").alias("o2")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("seg_start").alias("start"), "stop"))).alias("x"), F.sum(F.col("stop") - F.col("seg_start")).alias("before")
    )
    known = segments.select(*_SEGMENT, "pieces").join(above, _SEGMENT, "left")
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    inside = F.when(F.col("start") > F.col("seg_start"), F.array(F.struct(F.col("seg_start").alias("start"), F.col("start").alias("stop")))).otherwise(none)
    to_here = F.transform("pieces", lambda p, k: F.when(k == F.size("pieces") - 1, p.withField("upto", F.col("level"))).otherwise(p))
    nodes = tokens.join(places.drop(*_SEGMENT), _NODE).join(known, _SEGMENT).select(
        *_NODE, *_SEGMENT, "ids", "loss_start", "loss_stop", "formatted_chars", "start", "length",
        (F.coalesce("before", F.lit(0)) + F.col("start") - F.col("seg_start")).alias("position"), F.get("pieces", F.lit(0))["o1"].alias("tree"),
        _merged(F.concat(F.coalesce("x", none), inside)).alias("ancestors"), to_here.alias("pieces"),
    )
    nodes = cut(nodes)
    for part in (tokens, pieces, segments, places):
        discard(part)
    return nodes, last


def format_tokens(rows: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``turns`` without their places, in a written table, and the last node of every conversation."""
    found = rows.groupBy(*_NODE).agg(F.min(F.struct("c1", "c2")).alias("o"), F.first("role").alias("role"), F.first("text").alias("text"))
    tokens = cut(_render(found.select(*_NODE, F.col("o.c1").alias("o1"), F.col("o.c2").alias("o2"), "role", "text"), tokenizer))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("level", "k1", "k2")).alias("x"))
    return tokens, last.select("conv_id", "x.k1", "x.k2", "x.level")


def read_back(nodes: DataFrame, last: DataFrame, tokenizer: str) -> DataFrame:
    """The digests of every conversation, from the tokens of its path alone.

    Conversations with the same turns are read once. The turns of a path are those of its pieces, and lie in
    the order of the stream.
    """
    leaves = nodes.select(*_NODE, "pieces").join(last.select(*_NODE).distinct(), _NODE, "left_semi")
    own = nodes.select(*_SEGMENT, F.col("level").alias("at"), "start", "ids", "loss_start", "loss_stop", "formatted_chars")
    turns_of = leaves.select(*_NODE, F.explode("pieces").alias("p")).select(*_NODE, "p.o1", "p.o2", F.explode(F.sequence("p.first", "p.upto")).alias("at"))
    paths = (
        turns_of.join(own, [*_SEGMENT, "at"])
        .groupBy(*_NODE)
        .agg(F.sort_array(F.collect_list(F.struct("start", "ids", "loss_start", "loss_stop"))).alias("x"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = lambda ids: _tokenizer(tokenizer).decode(ids, skip_special_tokens=False)
        for batch in batches:
            out = []
            for path in batch.column("x").to_pylist():
                text = decode([i for x in path for i in x["ids"]])
                said = [(unescape(r), unescape(t)) for r, t in _RENDERED.findall(text)]
                loss = "".join(unescape(decode(x["ids"][x["loss_start"] : x["loss_stop"]])) for x in path)
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in _NODE] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [*_NODE, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "k1 long, k2 long, level int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return last.join(paths.select(*_NODE, "x").mapInArrow(run, schema), _NODE).drop(*_NODE)
