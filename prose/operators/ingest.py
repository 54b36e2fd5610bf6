"""Documents of a book as sections: clean markup, titles, order, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import requests

# Elements that a section's markup may keep.
ALLOWED = (
    "a", "b", "blockquote", "br", "code", "div", "em", "h1", "h2", "h3", "h4", "hr", "i", "img", "li", "ol", "p", "pre", "section",
    "span", "strong", "u", "ul",
)
_UNSEEN = r"(?is)<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>|<!--.*?-->|<head\b.*?</head>|<!doctype[^>]*>"


def document_text(page: Column) -> Column:
    """Text of a document: no scripts, styles and menus, a line per text node, references decoded, normalised."""
    return T.normalize(requests.unescaped(requests.markup_free(page)))


_IMG = r"""(?is)<img\b(?:[^>"']|"[^"]*"|'[^']*')*>"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in double, single or no quotes; null if it has none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), F.concat(*(F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3))))


def _allowed(body: Column) -> Column:
    """Allowed tags without attributes; they are set apart by two control characters first, so one plain pattern drops the others."""
    names = "|".join(sorted(ALLOWED, key=len, reverse=True))
    body = F.regexp_replace(body, rf"(?i)<(/?)({names})(?:[\s/][^>]*)?>", "\x01$1$2\x02")
    return F.translate(F.regexp_replace(body, r"<[^>]*>", ""), "\x01\x02", "<>")


def clean_markup(page: Column) -> Column:
    """Markup of the allowed elements only, without attributes; an image keeps its source and goes if it has none."""
    body = F.regexp_replace(page, _UNSEEN, "")
    for quoted in (r'"([^"]+)"', r"'([^'\"]+)'", r"([^\s\"'>]+)"):
        body = F.regexp_replace(body, rf"(?i)<img\b[^>]*\ssrc\s*=\s*{quoted}[^>]*>", "\x01img src=\"$1\"\x02")
    return T.strip(_allowed(F.regexp_replace(body, r"(?i)<img\b[^>]*>", "")))


def linked_markup(docs: DataFrame, images: DataFrame) -> DataFrame:
    """(book, name, html) of documents (book, name, html): allowed markup, whose images are those of ``images`` (book, image, data).

    Images are cut out of the markup with their places, joined with the stored ones under all the names that they may have, and
    woven back with ``data`` as source and their ``alt``; an image that is not stored goes. All other text and markup stays as
    ``clean_markup`` leaves it.
    """
    # The three control characters below mark tags and images, so the text may not hold them.
    body = F.regexp_replace(F.translate(F.coalesce("html", F.lit("")), "\x01\x02\x03", ""), _UNSEEN, "")
    cut = docs.select("book", "name", F.regexp_extract_all(body, F.lit(_IMG), F.lit(0)).alias("tags"), F.split(_allowed(F.regexp_replace(body, _IMG, "\x03")), "\x03", -1).alias("parts"))
    found = cut.select("book", F.col("name").alias("document"), F.posexplode("tags").alias("at", "tag"))
    plain = lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))
    found = found.select("book", "document", "at", plain(_attribute(F.col("tag"), "src")).alias("src"), F.coalesce(_attribute(F.col("tag"), "alt"), F.lit("")).alias("alt")).filter("src <> ''")
    stored = images.select("book", "image", "data").dropDuplicates(["book", "image"])
    named = resolved_images(found.select("book", "document", "src").distinct(), images).join(stored, ["book", "image"])
    told = found.join(named, ["book", "document", "src"])
    tag = F.concat(F.lit('<img src="'), "data", F.lit('" alt="'), F.replace("alt", F.lit('"'), F.lit("&quot;")), F.lit('">'))
    put = told.groupBy("book", F.col("document").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("at", tag.alias("tag")))).alias("put"))
    woven = F.transform("parts", lambda p, k: F.concat(p, F.coalesce(F.try_element_at("put", k), F.lit(""))))
    return cut.join(put, ["book", "name"], "left").select("book", "name", T.strip(F.array_join(woven, "")).alias("html"))


def page_title(page: Column) -> Column:
    """First heading, else the document's own title, else null."""
    tag = lambda p: F.nullif(T.strip(F.regexp_replace(F.regexp_extract(page, p, 1), r"<[^>]*>", " ")), F.lit(""))
    return F.coalesce(tag(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), tag(r"(?is)<title[^>]*>(.*?)</title>"))


def document_title(toc_title: Column, found: Column, name: Column, number: Column, book_title: Column) -> Column:
    """Listed title, ``found`` one, number in the file name, cleaned stem or "Chapter n"; never the book's own title."""
    path_like = found.rlike(r"/|\.(?:html|xhtml|xml|htm)$")
    base = F.regexp_extract(F.when(path_like, found).otherwise(name), r"[^/]*$", 0)
    chapter = lambda n: F.concat(F.lit("Chapter "), n.cast("string"))
    split = F.nullif(F.regexp_extract(base, r"split_(\d+)", 1), F.lit("")).cast("int")
    any_number = F.nullif(F.regexp_extract(base, r"(\d+)", 1), F.lit("")).cast("int")
    stem = F.nullif(F.initcap(F.translate(F.regexp_replace(base, r"\.[^.]*$", ""), "_-", "  ")), F.lit(""))
    named = F.coalesce(F.nullif(toc_title, F.lit("")), F.when(~path_like, found), chapter(split + 1), chapter(any_number), stem, chapter(number))
    return F.when(F.lower(named) == F.lower(book_title), chapter(number)).otherwise(named)


def toc_lookup(toc: DataFrame) -> DataFrame:
    """(book, key, toc_title) of (book, place, href, title): path without fragment and its base name; the first entry wins a key."""
    path = F.translate(F.substring_index("href", "#", 1), "\\", "/")
    keys = toc.filter("href <> '' and title <> ''").select(
        "book", "place", T.strip(F.col("title")).alias("title"), F.explode(F.array_distinct(F.array(path, F.regexp_extract(path, r"[^/]*$", 0)))).alias("key")
    )
    return keys.groupBy("book", "key").agg(F.min_by("title", "place").alias("toc_title"))


def with_toc_titles(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """Adds ``toc_title`` to documents (book, name): by whole path, else by base name."""
    keys = toc_lookup(toc)
    whole = keys.withColumnsRenamed({"key": "_whole", "toc_title": "_by_path"})
    base = keys.withColumnsRenamed({"key": "_base", "toc_title": "_by_base"})
    named = docs.withColumns({"_whole": F.translate("name", "\\", "/"), "_base": F.regexp_extract(F.translate("name", "\\", "/"), r"[^/]*$", 0)})
    out = named.join(whole, ["book", "_whole"], "left").join(base, ["book", "_base"], "left")
    return out.withColumn("toc_title", F.coalesce("_by_path", "_by_base")).drop("_whole", "_base", "_by_path", "_by_base")


def image_source(document: Column, src: Column) -> Column:
    """Array of the names under which an image may be stored, in the order they are tried."""
    clean = F.url_decode(F.regexp_replace(F.regexp_replace(src, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", ""))
    folder = F.regexp_replace(document, r"[^/]*$", "")
    steps = F.filter(F.split(F.concat(folder, clean), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(
        steps, F.expr("cast(array() as array<string>)"),
        lambda done, x: F.when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.array_distinct(F.array(clean, F.regexp_replace(clean, r"^/+", ""), F.array_join(up, "/"), F.regexp_extract(clean, r"[^/]*$", 0)))


def resolved_images(links: DataFrame, images: DataFrame) -> DataFrame:
    """(book, document, src, image): the first candidate of every link that is a stored image's name."""
    tried = links.select("book", "document", "src", F.posexplode(image_source(F.col("document"), F.col("src"))).alias("at", "image"))
    found = tried.join(images.select("book", "image").distinct(), ["book", "image"])
    return found.groupBy("book", "document", "src").agg(F.min_by("image", "at").alias("image"))


def reading_order(docs: DataFrame) -> DataFrame:
    """Adds ``place``: documents of the spine in its order, then the unlisted ones in theirs."""
    order = Window.partitionBy("book").orderBy(F.col("spine_pos").asc_nulls_last(), "manifest_pos")
    return docs.withColumn("place", F.row_number().over(order) - 1)


def book_sections(docs: DataFrame, toc: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(book, section_index, title, text, html, locator) of documents (book, name, book_title, html, spine_pos, manifest_pos).

    Documents that the table of contents lists, or all of a book that lists none; of these, those that
    hold text, an image or a rule. Only ids and flags go through the numbering windows. With ``images`` (book, image, data)
    the markup shows the stored images, and those that are not stored go.
    """
    titled = with_toc_titles(docs, toc)
    shown = titled.withColumns({"_text": document_text(F.col("html")), "_html": clean_markup(F.col("html")), "_found": page_title(F.col("html"))})
    if images is not None:
        shown = shown.drop("_html").join(linked_markup(docs, images).withColumnRenamed("html", "_html"), ["book", "name"])
    holds = (F.col("_text") != "") | F.col("_html").contains("<img") | F.col("_html").contains("<hr")
    kept = reading_order(shown.filter(holds))
    listed = Window.partitionBy("book")
    kept = kept.withColumn("_listed", F.count_if(F.col("toc_title").isNotNull()).over(listed)).filter("toc_title is not null or _listed = 0")
    kept = kept.withColumn("section_index", F.row_number().over(Window.partitionBy("book").orderBy("place")) - 1)
    title = document_title(F.col("toc_title"), F.col("_found"), F.col("name"), F.col("section_index") + 1, F.col("book_title"))
    return kept.withColumn("title", title).select(
        "book", "section_index", "title", F.coalesce(F.nullif("_text", F.lit("")), F.nullif("title", F.lit("")), F.lit("Illustration")).alias("text"),
        F.col("_html").alias("html"), F.concat(F.lit("epub:"), "name").alias("locator"),
    )


def with_placeholder(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections, and one placeholder for every book that has none."""
    # Title and text of the placeholder.
    empty = books.join(sections.select("novel").distinct(), "novel", "left_anti").select(
        "novel", F.lit(0).alias("section_index"), F.lit("Empty Book").alias("title"), F.lit("empty").alias("locator"),
        F.lit("No readable text was found in this file.").alias("text"),
    )
    return sections.select(*empty.columns).unionByName(empty)
