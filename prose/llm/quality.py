"""Quality rules with cross-document line frequency, on DataFrame functions only.

A document's lines are normalised and hashed; a line is frequent in its host if it stands in more than
``MAX_LINE_DOCUMENTS`` different documents there. Exact copies are one document: a document is its
text, by a 128-bit signature. Frequent lines are removed, and a document that loses more than
``MAX_REMOVED_SHARE`` of its characters is depleted and rejected.

Cases with a defined result: null or blank text has no words, fails the base rule and is rejected;
a null host counts as a host of its own; repeated rows are judged one by one and alike; a very long
text costs a sort of its windows and nothing that grows with their square; a line at the limit itself is
not frequent, and a document at the share itself is kept; an empty table gives an empty result; extra
columns of the input are ignored by ``judge`` and kept by ``kept_rows``.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line is frequent in its host if it stands in more than this many different documents.
MAX_LINE_DOCUMENTS = 20
#: A document is depleted if removing frequent lines takes more than this share of the characters of its words.
MAX_REMOVED_SHARE = 0.5
#: Columns that stand for a document: its host and the signature of its text.
_KEY = ["_host", "_sig1", "_sig2"]


def _lines(text: Column) -> Column:
    """Lines that hold a word, unchanged, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalise_line(line: Column) -> Column:
    """Lower case, runs of digits to 0, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[0-9]+", "0"))


def _tail(array: str, start: int) -> Column:
    return F.slice(array, F.lit(start), F.greatest(F.size(array) - (start - 1), F.lit(0)))


#: Low bits of a packed window that hold its position; longer documents take the plain sort.
_PLACE_BITS = 21


def _pairs(array: str, key) -> Column:
    """Pairs (first, second) of neighbours of a sorted array that agree in ``key``."""
    zipped = F.arrays_zip(F.col(array).alias(array), F.col("_next"))
    return F.filter(zipped, lambda x: key(x[array]) == key(x["_next"]))


def _with_repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that occur at least twice in the text.

    Each window becomes one long, the high bits of its 64-bit hash above its position; sorting these
    puts equal windows side by side in the order of their positions. Neighbours that agree in the
    high bits are compared by the whole hash; a document where that finds two different windows, or
    one too long for the position bits, is sorted by (hash, position) instead. Each repeated
    position then adds as many words as it lies after the one before it, at most 3. No explode and
    no self join: everything stays inside the document's row.
    """
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    heads = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))
    df = df.withColumn(
        "_windows", F.transform(heads, lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    ).drop("_h")
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1).cast("long")).cast("int")
    packed = F.transform(
        "_windows", lambda h, i: F.shiftleft(high(h), _PLACE_BITS).bitwiseOR(i.cast("long"))
    )
    df = df.withColumn("_packed", F.when(F.size("_windows") < 1 << _PLACE_BITS, F.sort_array(packed)))
    df = df.withColumn("_next", _tail("_packed", 2))
    df = df.withColumn("_equal", _pairs("_packed", high)).drop("_packed", "_next")
    same = lambda x: F.get("_windows", place(x["_packed"])) == F.get("_windows", place(x["_next"]))
    whole = F.coalesce(F.forall("_equal", same), F.lit(False))
    df = df.withColumn(
        "_sorted",
        F.when(~whole, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_windows")
    df = df.withColumn("_next", _tail("_sorted", 2))
    slow = F.transform(_pairs("_sorted", lambda x: x["h"]), lambda x: F.array(x["_sorted"]["i"], x["_next"]["i"]))
    fast = F.transform("_equal", lambda x: F.array(place(x["_packed"]), place(x["_next"])))
    df = df.withColumn(
        "_at", F.sort_array(F.array_distinct(F.flatten(F.when(F.col("_sorted").isNull(), fast).otherwise(slow))))
    ).drop("_equal", "_sorted", "_next")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(i - s["last"], F.lit(3)).cast("long")).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    # A filter on the result must not be pushed below: it would carry these expressions into each other's
    # lambdas and evaluate them for every element. No optimiser rule moves a filter past a random number.
    return df.withColumn("n_repeat_words", F.when(F.rand(0) >= 0, covered)).drop("_at")


def base_features(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the base columns and the columns ``also`` of every row; nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = reduce(add, [F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in SYMBOLS])
    df = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("_words"),
        _lines(F.col("text")).alias("_lines"),
        symbols.cast("long").alias("n_symbols"),
        *also,
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    df = _with_repeated(df)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *also
    )


def _signed(docs: DataFrame) -> DataFrame:
    """Adds the key of a document: host and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"_host": F.coalesce(F.col("source"), F.lit("")), "_sig1": F.xxhash64(text), "_sig2": F.xxhash64(F.lit(7), text)}
    )


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normalise_line(line))


def document_lines(docs: DataFrame) -> DataFrame:
    """(key, line_hash): every different line of every different document once."""
    hashes = F.array_distinct(F.transform(_lines(F.col("text")), _line_hash))
    return _signed(docs).select(*_KEY, F.explode(hashes).alias("line_hash")).distinct()


def frequent_lines(lines: DataFrame, max_documents: int = MAX_LINE_DOCUMENTS) -> DataFrame:
    """(host, line_hash) of lines of more than ``max_documents`` documents of a host, pre-aggregated before the shuffle."""
    counted = lines.groupBy("_host", "line_hash").agg(F.count("*").alias("documents"))
    return counted.filter(F.col("documents") > max_documents).select("_host", "line_hash")


def depletions(docs: DataFrame, max_documents: int = MAX_LINE_DOCUMENTS) -> DataFrame:
    """(key, gone): of every document that holds frequent lines, the hashes of those. Lines travel as hashes."""
    lines = document_lines(docs)
    found = lines.join(frequent_lines(lines, max_documents), ["_host", "line_hash"])
    return found.groupBy(*[F.col(c).alias(f"{c}_") for c in _KEY]).agg(F.collect_set("line_hash").alias("_gone"))


def _by_key(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """A join by key; a document that a third of all rows copy is one skewed key that adaptive execution splits."""
    same = reduce(and_, [F.col(c) == F.col(f"{c}_") for c in _KEY])
    return rows.join(other, same, how).drop(*[f"{c}_" for c in _KEY])


def _judged(docs: DataFrame, max_documents: int, max_removed_share: float) -> DataFrame:
    """What ``judge`` returns, with the key and the hashes of the document's frequent lines."""
    chars = F.transform(
        _lines(F.col("text")), lambda x: F.struct(_line_hash(x).alias("h"), F.length(F.translate(x, " \t\n\x0b\x0c\r", "")).cast("long").alias("n"))
    )
    rows = _by_key(base_features(_signed(docs).withColumn("_line", chars), *_KEY, "_line"), depletions(docs, max_documents), "left")
    removed = F.aggregate(F.filter("_line", lambda x: F.array_contains("_gone", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    out = rows.withColumn("n_frequent_chars", F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(removed)).drop("_line")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_frequent_chars") <= max_removed_share * F.col("word_chars")))


def judge(docs: DataFrame, max_documents: int = MAX_LINE_DOCUMENTS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """Every row's doc_id, base columns, n_frequent_chars (of frequent lines, without white space) and kept.

    Text is never shuffled: lines travel as hashes and lengths, features as numbers.
    """
    return _judged(docs, max_documents, max_removed_share).drop(*_KEY, "_gone")


def kept_rows(docs: DataFrame, max_documents: int = MAX_LINE_DOCUMENTS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """The rows that ``judge`` keeps, with frequent lines removed from ``text`` and ``n_chars``, where there is one, set anew.

    Verdicts are those of documents, so they are folded by key; the text is shuffled once, to its verdict.
    """
    judged = _judged(docs, max_documents, max_removed_share)
    verdicts = judged.groupBy(*[F.col(c).alias(f"{c}_") for c in _KEY]).agg(F.max("kept").alias("_kept"), F.first("_gone").alias("_gone"))
    whole = docs.select("text", "source", F.struct(*docs.columns).alias("_row"))
    rows = _by_key(_signed(whole), verdicts.filter("_kept"), "inner")
    spared = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains("_gone", _line_hash(x))
    out = {c: F.col(f"_row.{c}").alias(c) for c in docs.columns}
    touched, clean = F.col("_gone").isNotNull(), F.array_join(F.filter(F.split("text", "\n"), spared), "\n")
    out["text"] = F.when(touched, clean).otherwise(F.col("text")).alias("text")
    out = rows.select(*out.values(), touched.alias("_touched"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_touched"), size).otherwise(F.col("n_chars")))
    return out.drop("_touched")
