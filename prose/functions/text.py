"""Column functions on text. Everything here is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which intensities each emotion has a voice sample for, and the expression tags, in order.
EMOTIONS = {
    "neutral": [], "happy": ["low", "med", "high"], "angry": ["low", "med", "high"], "sad": ["low", "med", "high"],
    "fearful": ["low", "med", "high"], "warm": ["low", "high"], "serious": ["low", "high"], "whisper": ["low", "high"],
    "mysterious": ["low"],
}
INTENSITIES = ["low", "med", "high"]
TAGS = [
    "[sigh]", "[gasp]", "[cough]", "[laugh]", "[whisper]", "[breath]",
    "[chuckle]", "[clear throat]", "[sniff]", "[groan]", "[shush]",
]
AGES = ["child", "teen", "young", "young_adult", "adult", "middle_aged", "elderly"]
# Fixed value: titles of front and back matter.
FRONT_MATTER = (
    r"\b(preface|foreword|author'?s?\s+note|translator'?s?\s+note|dedication|acknowledge?ments?|copyright|about\s+the\s+author|"
    r"title\s+page|table\s+of\s+contents|colophon|epigraph|publisher'?s?\s+note|introduction)\b"
)
# Fixed value: a line that opens a chapter.
CHAPTER_LINE = (
    r"^\s*((chapter|book|part)\s+([ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b.*|prologue\b.*|epilogue\b.*)\s*$"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Line feeds only, one space for runs of spaces and tabs, at most one blank line, stripped."""
    one = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(one, r"\n{3,}", "\n\n"))


def is_front_matter(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)" + FRONT_MATTER)


def is_chapter_line(line: Column) -> Column:
    return line.rlike("(?i)" + CHAPTER_LINE)


def est_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def capped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def history_line(speaker: Column, emotion: Column, intensity: Column, text: Column) -> Column:
    """A line as requests show it to a model: who spoke, how, and the first 60 characters."""
    return F.concat(speaker, F.lit(": "), emotion, F.lit("_"), intensity, F.lit(" — "), capped(text, 60))


def snap_emotion(emotion: Column, intensity: Column) -> tuple[Column, Column]:
    """The nearest pair that has a voice sample: an unknown emotion is neutral, a missing intensity low."""
    e, i = F.lower(F.coalesce(emotion, F.lit(""))), F.lower(F.coalesce(intensity, F.lit("low")))
    valid = F.create_map(*[x for k, v in EMOTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    known = e.isin(*EMOTIONS)
    has = F.element_at(valid, F.when(known, e).otherwise("neutral"))
    # Samples of an emotion lack med, or have low alone, so the nearest one is always low.
    snapped = F.when(F.array_contains(has, i), i).otherwise("low")
    return F.when(known, e).otherwise("neutral"), snapped


def tag_prefixed(response: Column, source: Column) -> Column:
    """Source text behind the first tag, in list order, that the response holds."""
    found = F.get(F.filter(F.array(*map(F.lit, TAGS)), lambda t: F.contains(response, t)), F.lit(0))
    return F.concat_ws(" ", found, source)


def strip_reasoning(text: Column) -> Column:
    """Without reasoning blocks: from an opening tag to any closing one, or to the end."""
    tags = "think|thought|reasoning|thinking"
    return F.ltrim(F.regexp_replace(text, rf"(?is)<(?:{tags})>.*?(?:</(?:{tags})>|\z)", ""))


def without_reasoning_blocks(text: Column) -> Column:
    """An answer without whole reasoning blocks, and without one that is left open before the first brace."""
    tags = "think|thought|reasoning|thought_process"
    whole = strip(F.regexp_replace(text, rf"(?is)<({tags})>.*?</\1>", ""))
    return strip(F.regexp_replace(whole, rf"(?is)^<(?:{tags})>[^{{]*", ""))


def passage(text: Column, n: int = 600) -> Column:
    """White space as single spaces, the first ``n`` characters."""
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, n)


def title_of_stem(stem: Column) -> Column:
    """A title from a file's stem."""
    return F.coalesce(F.nullif(F.initcap(F.trim(F.translate(stem, "_-", "  "))), F.lit("")), F.lit("Untitled"))


def _tenths(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def size_text(size: Column) -> Column:
    """Bytes as a person reads them."""
    units = ["B", "KB", "MB", "GB"]
    shown = F.when(F.coalesce(size, F.lit(0)) == 0, "Unknown size")
    for k, unit in enumerate(units):
        shown = shown.when(size < 1024 ** (k + 1), F.concat(_tenths(size / F.lit(float(1024**k))), F.lit(f" {unit}")))
    return shown.otherwise(F.concat(_tenths(size / F.lit(float(1024**4))), F.lit(" TB")))


def date_text(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm"), F.lit("Never"))


def preview(text: Column, n: int = 140) -> Column:
    """The first characters without tags, for a book without a cover."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", "")
    shown = F.concat(F.substring(strip(bare), 1, n), F.when(F.length(bare) > n, "...").otherwise(""))
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("No text content available."))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def overlap_score(a: Column, b: Column) -> Column:
    """Share of common tokens of the larger set, and half a point if one text holds the other; an empty answer ``b`` scores nothing."""
    b = strip(b)
    x, y = token_set(a), token_set(b)
    larger = F.greatest(F.size(x), F.size(y))
    la, lb = F.lower(a), F.lower(b)
    inside = F.contains(la, lb) | F.contains(lb, la)
    score = F.when(larger > 0, F.size(F.array_intersect(x, y)) / larger).otherwise(0.0) + F.when(inside, 0.5).otherwise(0.0)
    return F.when(strip(b) == "", 0.0).otherwise(score)


def age_distance(a: Column, b: Column) -> Column:
    """Steps between two ages; 3 if either is unknown."""
    order = F.array(*map(F.lit, AGES))
    x, y = F.array_position(order, a), F.array_position(order, b)
    return F.when((x == 0) | (y == 0), 3).otherwise(F.abs(x - y))


def names_match(name: Column, other: Column) -> Column:
    """Equal names, or all words of one among those of the other."""
    x, y = token_set(name), token_set(other)
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.lower(name) == F.lower(other)) | ((F.size(x) > 0) & (F.size(y) > 0) & subset)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name, from its SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
