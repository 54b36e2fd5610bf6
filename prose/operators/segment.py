"""Sections to paragraphs, typed blocks, request chunks, retrieval chunks and narration units.

A section is one row, so all of this is row-local: arrays in, arrays out, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_BLOCK, MAX_CHUNK, MAX_BLOCKS, MAX_PARAGRAPHS = 1400, 3200, 6, 2
SECTION_CHARS = 6500
UNIT_CHARS = 300
#: Possessive, so that a quote of any length costs no stack.
_SPANS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|“[^”]*+”|«[^»]*+»|"[^"”]*+[”"]'


def paragraphs(text: Column) -> Column:
    """Stripped non-empty paragraphs: split at blank lines, or at line feeds if that gives one and there are more than five."""
    clean = lambda parts: F.filter(F.transform(parts, T.strip), lambda x: x != "")
    blank, lines = clean(F.split(text, r"\n\s*\n")), clean(F.split(text, r"\n"))
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when((F.size(blank) <= 1) & (feeds > 5), lines).otherwise(blank)


def _block(text: Column, kind: Column | str) -> Column:
    return F.struct(text.alias("text"), (F.lit(kind) if isinstance(kind, str) else kind).alias("block_type"))


def split_paragraph(par: Column) -> Column:
    """Blocks of one paragraph: an action line, or quoted spans as dialogue and what lies between them."""
    gaps, spans = F.split(par, _SPANS), F.regexp_extract_all(par, F.lit(_SPANS), F.lit(0))
    inner = F.transform(spans, lambda s: _block(T.strip(F.substring(s, F.lit(2), F.length(s) - 2)), "dialogue"))
    thought = lambda g: F.length(F.regexp_extract(g, r"(?s)(?:<em>|<i>|\*).*?(?:</em>|</i>|\*)", 0)) > F.length(g) * 0.5
    between = F.transform(gaps, lambda g: _block(T.strip(g), F.when(thought(g), "thought").otherwise("narration")))
    woven = F.flatten(F.zip_with(between, inner, lambda g, s: F.array(g, s)))
    kept = F.filter(woven, lambda b: b.isNotNull() & ((b["text"] != "") | (b["block_type"] == "dialogue")))
    action = par.rlike(r"^\s*(?:\*[^*]+\*|\[[^\]]+\])\s*$")
    return F.when(action, F.array(_block(F.regexp_replace(par, r"^[\s*\[\]]+|[\s*\[\]]+$", ""), "action"))).otherwise(kept)


def text_blocks(text: Column) -> Column:
    """array<struct<text, block_type, paragraph_index>> of a section, over-long blocks cut at sentences; action lines stay whole."""
    def placed(par: Column, i: Column) -> Column:
        cut = lambda b: F.transform(
            F.when((F.length(b["text"]) > MAX_BLOCK) & (b["block_type"] != "action"), pack_sentences(b["text"], MAX_BLOCK)).otherwise(F.array(b["text"])),
            lambda t: F.struct(t.alias("text"), b["block_type"].alias("block_type"), i.alias("paragraph_index")),
        )
        return F.flatten(F.transform(split_paragraph(par), cut))

    return F.flatten(F.transform(paragraphs(text), placed))


def sentences(text: Column) -> Column:
    # Fixed value: where a sentence ends inside a block.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), T.strip), lambda s: s != "")


def _packed(parts: Column, limit: int) -> Column:
    """Greedy packing up to ``limit`` characters of array<struct<own, pieces>>: single pieces join with a space, those marked ``own`` stay apart."""
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))
    closed = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, x: Column) -> Column:
        one = x["pieces"][0]
        fits = (s["open"] == "") | (F.length(s["open"]) + 1 + F.length(one) <= limit)
        joined = F.when(s["open"] == "", one).otherwise(F.concat_ws(" ", s["open"], one))
        return (
            F.when(x["own"], F.struct(F.concat(closed(s), x["pieces"]).alias("done"), F.lit("").alias("open")))
            .when(fits, F.struct(s["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(closed(s).alias("done"), one.alias("open")))
        )

    return F.aggregate(parts, empty, step, closed)


def _parts(texts: Column, limit: int, cut) -> Column:
    """Texts as parts for ``_packed``: those over ``limit`` are cut and stay apart."""
    part = lambda own, pieces: F.struct(F.lit(own).alias("own"), pieces.alias("pieces"))
    return F.transform(texts, lambda t: F.when(F.length(t) > limit, part(True, cut(t))).otherwise(part(False, F.array(t))))


def _slices(word: Column, limit: int) -> Column:
    count = F.ceil(F.length(word) / limit).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(word, k * limit + 1, F.lit(limit)))


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences packed up to ``limit``. One that is longer is packed by words and kept apart; a word that is longer is cut."""
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    by_words = lambda s: _packed(_parts(words(s), limit, lambda w: _slices(w, limit)), limit)
    return _packed(_parts(sentences(text), limit, by_words), limit)


def pack_sections(text: Column, limit: int = SECTION_CHARS) -> Column:
    """Paragraphs packed into sections of up to ``limit`` characters (separators not counted), as arrays of paragraphs."""
    kind = "array<array<string>>"
    empty = F.struct(F.expr(f"cast(array() as {kind})").alias("done"), F.expr("cast(array() as array<string>)").alias("open"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(
        (F.size(s["open"]) > 0) & (s["n"] + F.length(p) > limit),
        F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.array(p).alias("open"), F.length(p).alias("n")),
    ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(p)).alias("open"), (s["n"] + F.length(p)).alias("n")))
    pars = F.filter(F.transform(F.split(text, "\n\n"), T.strip), lambda x: x != "")
    return F.aggregate(pars, empty, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def request_chunk_numbers(blocks: Column) -> Column:
    """Chunk number of every block: a chunk closes at two paragraph changes, six blocks or 3200 characters."""
    start = F.struct(
        F.expr("cast(array() as array<int>)").alias("numbers"), F.lit(-1).alias("par"), F.lit(0).alias("changes"),
        F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("chunk"),
    )

    def step(s: Column, b: Column) -> Column:
        changes = s["changes"] + F.when((s["par"] >= 0) & (b["paragraph_index"] != s["par"]), 1).otherwise(0)
        size = F.length(b["text"])
        close = (s["n"] > 0) & ((changes >= MAX_PARAGRAPHS) | (s["n"] >= MAX_BLOCKS) | (s["chars"] + 2 + size > MAX_CHUNK))
        chunk = s["chunk"] + F.when(close, 1).otherwise(0)
        return F.struct(
            F.concat(s["numbers"], F.array(chunk)).alias("numbers"), b["paragraph_index"].alias("par"), F.when(close, 0).otherwise(changes).alias("changes"),
            F.when(close, 1).otherwise(s["n"] + 1).alias("n"), F.when(close | (s["n"] == 0), size).otherwise(s["chars"] + 2 + size).alias("chars"), chunk.alias("chunk"),
        )

    return F.aggregate(blocks, start, step, lambda s: s["numbers"])


def request_chunks(blocks: Column) -> Column:
    """array<struct<first, blocks, chars>>: the request chunks of a section's blocks, by the rules of ``request_chunk_numbers``.

    The fold carries the open chunk as numbers and appends only when one closes.
    """
    kind = "array<struct<first:int,blocks:int,chars:bigint>>"
    start = F.struct(
        F.expr(f"cast(array() as {kind})").alias("done"), F.lit(-1).alias("par"), F.lit(0).alias("changes"), F.lit(0).alias("at"),
        F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"),
    )
    one = lambda s: F.array(F.struct((s["at"] - s["n"]).alias("first"), s["n"].alias("blocks"), s["chars"].alias("chars")))

    def step(s: Column, b: Column) -> Column:
        changes = s["changes"] + F.when((s["par"] >= 0) & (b["paragraph_index"] != s["par"]), 1).otherwise(0)
        size = F.length(b["text"]).cast("long")
        separators = F.when(s["n"] > 0, 2 * (s["n"] - 1)).otherwise(0)
        close = (s["n"] > 0) & ((changes >= MAX_PARAGRAPHS) | (s["n"] >= MAX_BLOCKS) | (s["chars"] + separators + 2 + size > MAX_CHUNK))
        return F.struct(
            F.when(close, F.concat(s["done"], one(s))).otherwise(s["done"]).alias("done"), b["paragraph_index"].alias("par"),
            F.when(close, 0).otherwise(changes).alias("changes"), (s["at"] + 1).alias("at"),
            F.when(close, 1).otherwise(s["n"] + 1).alias("n"), F.when(close, size).otherwise(s["chars"] + size).alias("chars"),
        )

    return F.aggregate(blocks, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], one(s))).otherwise(s["done"]))


def plain_text(blocks: Column) -> Column:
    """Blocks as context shows them: their texts, a line each."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def rendered(blocks: Column) -> Column:
    """A chunk as a request shows it: dialogue quoted, thoughts starred, actions bracketed."""
    one = lambda b: (
        F.when(b["block_type"] == "dialogue", F.concat(F.lit('"'), b["text"], F.lit('"')))
        .when(b["block_type"] == "thought", F.concat(F.lit("*"), b["text"], F.lit("*")))
        .when(b["block_type"] == "action", F.concat(F.lit("["), b["text"], F.lit("]")))
        .otherwise(b["text"])
    )
    return F.array_join(F.transform(blocks, one), "\n\n")


# Fixed value: a sentence with its closing quotes and brackets and the white space after it.
_SENTENCE = re.compile(r"""(?s).*?[.!?]["”’')\]]*(?:\s+|\Z)|.+\Z""")
CHUNK_WORDS, OVERLAP_WORDS = 512, 64
Measure = Callable[[str], int]


def _words(text: str) -> int:
    return len(text.split())


def _sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(start + m.start(), start + m.end()) for m in _SENTENCE.finditer(text[start:end]) if m.group().strip()]


def sentence_spans(text: Column) -> Column:
    """array<struct<text, start>>: the sentences of a text that hold more than white space, with their places from 0."""
    found = F.regexp_extract_all(text, F.lit(_SENTENCE.pattern.replace(r"\Z", r"\z")), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,start:int>>)").alias("done"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["done"], F.array(F.struct(x.alias("text"), s["at"].alias("start")))).alias("done"))
    return F.filter(F.aggregate(found, empty, step, lambda s: s["done"]), lambda x: T.strip(x["text"]) != "")


def _paragraph_spans(text: str) -> list[tuple[int, int]]:
    def between(pattern: str) -> list[tuple[int, int]]:
        breaks = [m.span() for m in re.finditer(pattern, text)]
        ends = zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)], strict=True)
        return [(a, b) for a, b in ends if text[a:b].strip()]

    spans = between(r"\n\s*\n")
    return between(r"\n+") if len(spans) <= 1 and text.count("\n") > 5 else spans


def _packed_spans(text: str, parts: list[tuple[int, int]], size: int, measure: Measure) -> list[tuple[int, int, int]]:
    """(start, end, words): neighbouring spans packed up to ``size`` words; one that is longer stays whole."""
    out: list[tuple[int, int, int]] = []
    for a, b in parts:
        n = measure(text[a:b])
        out.append((out.pop()[0], b, last + n) if out and (last := out[-1][2]) + n <= size else (a, b, n))
    return out


def chunk_spans(text: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, measure: Measure = _words) -> list[tuple[int, int, int, int, int]]:
    """(char_start, body_start, char_end, tokens, repeated) of the chunks of one section, ends exclusive.

    Whole paragraphs are packed up to ``size`` words; one that is longer closes the chunk before it and
    is packed by sentences. From the second chunk on, char_start lies before the body, at the start
    of those sentences of the body before that reach ``overlap`` words, or of all of it. tokens are the words of the body, repeated those before it.
    ``measure`` counts something else in place of words, such as a tokenizer's tokens.
    """
    bodies: list[tuple[int, int, int]] = []
    run: list[tuple[int, int]] = []
    for a, b in _paragraph_spans(text):
        if measure(text[a:b]) > size:
            bodies += _packed_spans(text, run, size, measure) + _packed_spans(text, _sentence_spans(text, a, b), size, measure)
            run = []
        else:
            run.append((a, b))
    bodies += _packed_spans(text, run, size, measure)
    out = []
    for k, (a, b, n) in enumerate(bodies):
        start, held = a, 0
        for x, y in reversed(_sentence_spans(text, *bodies[k - 1][:2]) if k and overlap else []):
            start, held = x, held + measure(text[x:y])
            if held >= overlap:
                break
        out.append((start, a, b, n, held))
    return out


def bpe_measure(path: str) -> Measure:
    """Counts the tokens of a tokenizer file, loaded once a worker."""
    held: list = []

    def measure(text: str) -> int:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return len(held[0].encode(text, add_special_tokens=False).ids)

    return measure


def retrieval_spans(sections: DataFrame, key: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, measure: Measure = _words) -> DataFrame:
    """(key, chunks) of sections (key, text): ``chunk_spans`` of every section; null text has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("char_start", "body_start", "char_end", "tokens", "repeated")
        for pdf in frames:
            found = [[dict(zip(names, c, strict=True)) for c in chunk_spans(t or "", size, overlap, measure)] for t in pdf["text"]]
            yield pd.DataFrame({key: pdf[key], "chunks": found})

    kind = "array<struct<char_start:int,body_start:int,char_end:int,tokens:int,repeated:int>>"
    return sections.select(F.col(key).cast("long").alias(key), "text").mapInPandas(run, f"{key} long, chunks {kind}")


# Where a narration unit may end, and the marks at which an over-long sentence is cut.
_UNIT_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_CLAUSE_MARKS = ",;:—–-"


def _cut_sentence(text: str, limit: int) -> list[str]:
    """Pieces of an over-long sentence: cut behind the last clause mark within the limit, else before the last space, else at the limit."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        at = max(rest.rfind(c, 0, limit) for c in _CLAUSE_MARKS) + 1 or max(rest.rfind(" ", 0, limit), 0) or limit
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in (*out, rest) if x]


def units_of(text: str, limit: int = UNIT_CHARS) -> list[str]:
    """The narration units of one line of more than ``limit`` characters: sentences packed, over-long ones cut and kept apart."""
    out: list[str] = []
    open_ = False
    for sentence in filter(None, map(str.strip, _UNIT_END.split(text))):
        if len(sentence) > limit:
            out += _cut_sentence(sentence, limit)
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(sentence) <= limit:
            out[-1] += " " + sentence
        else:
            out.append(sentence)
            open_ = True
    return out


def narration_units(text: Column, limit: int = UNIT_CHARS) -> Column:
    """array<string>: a line within ``limit`` characters as it is; a longer one goes through ``units_of``."""
    clean = T.strip(F.coalesce(text, F.lit("")))
    long = F.pandas_udf(lambda s: s.map(lambda t: units_of(t, limit), na_action="ignore"), "array<string>", F.PandasUDFType.SCALAR)
    return F.when(clean == "", F.expr("cast(array() as array<string>)")).when(F.length(clean) <= limit, F.array(clean)).otherwise(
        long(F.when(F.length(clean) > limit, clean))
    )


#: What ends a line of a book.
_LINE_END = "[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def chapters(books: DataFrame) -> DataFrame:
    """(novel, section_index, title, locator, text) of books (novel, text): normalised and split at chapter lines.

    Row-local: lines are numbered and grouped inside the book's row, and stay as they are; titles and bodies are stripped.
    Text before the first chapter line is "Opening"; empty bodies go before sections are numbered densely.
    """
    return chapters_by_line(books).drop("chapter")


def chapters_by_line(books: DataFrame) -> DataFrame:
    """As ``chapters``, with ``chapter``: the number of the section's chapter line in the book, 0 before the first, also counting those without a body."""
    lines = F.transform(F.split(T.normalize(F.col("text")), _LINE_END), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"), T.is_chapter_line(x).alias("head")))
    marked = books.select("novel", lines.alias("lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.filter("lines", lambda x: x["head"]), lambda x: x["no"]))
    marked = marked.withColumn("starts", starts)
    part = lambda i: F.slice("lines", F.get("starts", i) + 1, F.coalesce(F.get("starts", i + 1) - 1, F.size("lines")) - F.get("starts", i))
    body = lambda i: F.array_join(F.transform(part(i), lambda x: x["line"]), "\n")
    found = F.transform(
        "starts",
        lambda s, i: F.struct(
            s.alias("no"), i.alias("chapter"), F.when(s == 0, "Opening").otherwise(T.strip(F.get("lines", s - 1)["line"])).alias("title"), T.strip(body(i)).alias("text")
        ),
    )
    kept = marked.select("novel", F.posexplode(F.filter(found, lambda x: x["text"] != "")).alias("section_index", "x"))
    locator = F.concat(F.lit("txt:"), F.when(F.col("x.no") == 0, "opening").otherwise(F.col("x.no").cast("string")))
    return kept.select("novel", "section_index", "x.title", locator.alias("locator"), "x.text", "x.chapter")


def fallback_sections(text: Column, limit: int = SECTION_CHARS) -> Column:
    """array<struct<title, text>> of a book without chapter lines: packed paragraphs as numbered sections, or its first characters."""
    packed = F.transform(pack_sections(text, limit), lambda p: F.array_join(p, "\n\n"))
    texts = F.when(F.size(packed) > 0, packed).otherwise(F.array(F.substring(text, 1, limit)))
    return F.transform(texts, lambda t, i: F.struct(F.concat(F.lit("Section "), (i + 1).cast("string")).alias("title"), t.alias("text")))


def sequence_starts(counts: DataFrame) -> DataFrame:
    """First global sequence number of every section, from (novel, section_index, n): a prefix sum over counts only."""
    before = Window.partitionBy("novel").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
