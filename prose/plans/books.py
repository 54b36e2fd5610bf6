"""Queries of books, documents and shelves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, library, segment
from ..sources import tables as S
from .registry import query


@query("""SELECT doc_id, 'Section ' || (k + 1) AS title, sha256(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS sha FROM (SELECT doc_id, unnest(s.ks) AS k, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
          SELECT doc_id, ps, list_reduce(list_transform(ps, lambda x: {'n': length(x)::BIGINT, 'ks': [0::BIGINT]}), lambda s, x: CASE WHEN s.n + x.n > 6500
          THEN {'n': x.n, 'ks': list_append(s.ks, s.ks[-1] + 1)} ELSE {'n': s.n + x.n, 'ks': list_append(s.ks, s.ks[-1])} END) AS s FROM packed_pars WHERE len(ps) > 0)) GROUP BY doc_id, k""")
def fallback_sections(spark, d):
    """Numbered sections of books without chapter lines, with their texts."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = S.table(spark, d, "documents").filter(F.coalesce("text", F.lit("")).rlike(r"[^\s]"))
    found = rows.select("doc_id", F.explode(segment.fallback_sections(text)).alias("x"))
    return found.select("doc_id", "x.title", F.sha2("x.text", 256).alias("sha"))


@query("""SELECT doc_id, coalesce(nullif(array_to_string(list_transform(string_split(trim(replace(replace(stem, '_', ' '), '-', ' ')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), ''), 'Untitled') AS title
          FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '_the-BOOK' WHEN 1 THEN '_' || lang || '-vol_' || doc_id WHEN 2 THEN '_-_' ELSE lang END AS stem FROM documents)""")
def book_titles(spark, d):
    stem = F.expr("CASE doc_id % 4 WHEN 0 THEN source || '_the-BOOK' WHEN 1 THEN '_' || lang || '-vol_' || doc_id WHEN 2 THEN '_-_' ELSE lang END")
    return S.table(spark, d, "documents").select("doc_id", T.title_of_stem(stem).alias("title"))


@query(r"""SELECT novel, section_index, title, sha256(text) AS sha FROM (SELECT doc_id AS novel, 0 AS section_index, title, text FROM section_keys JOIN documents USING (doc_id)
          WHERE doc_id % 7 <> 0 AND regexp_matches(text, '\S') UNION ALL SELECT doc_id, 0, 'Empty Book', 'No readable text was found in this file.' FROM documents
          WHERE doc_id % 7 = 0 OR text IS NULL OR NOT regexp_matches(text, '\S'))""")
def placeholder_sections(spark, d):
    """Every document as a book; every seventh file has no readable text, and gets the placeholder."""
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    found = S.section_keys(spark, d).join(docs, "doc_id").filter("doc_id % 7 <> 0").filter(F.col("text").rlike(r"\S"))
    rows = found.select(F.col("doc_id").alias("novel"), F.lit(0).alias("section_index"), "title", F.lit("txt:1").alias("locator"), "text")
    books = docs.select(F.col("doc_id").alias("novel"))
    return ingest.with_placeholder(books, rows).select("novel", "section_index", "title", F.sha2("text", 256).alias("sha"))


def _documents(spark, d):
    """Pages as documents of books of ten: file name from the address, every fourth outside the spine, which runs backwards."""
    name = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"[?#].*$", "")
    return S.table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 10).alias("book"), name.alias("name"), F.lit("Nothing").alias("book_title"), "html", "page_id",
        F.when(F.col("page_id") % 4 != 0, 1000 - F.col("page_id") % 10).alias("spine_pos"), F.col("page_id").alias("manifest_pos"),
    )


def _toc(spark, d):
    """Two pages of three are listed in books of even number, some under their base names and twice; books of odd number list none."""
    rows = _documents(spark, d).filter("book % 2 = 0 and page_id % 3 <> 0")
    href = F.when(F.col("page_id") % 2 == 0, F.concat("name", F.lit("#top"))).otherwise(F.regexp_extract("name", r"[^/]*$", 0))
    one = rows.select("book", F.col("page_id").alias("place"), href.alias("href"), F.concat(F.lit(" Part "), F.col("page_id").cast("string")).alias("title"))
    return one.unionByName(one.withColumns({"place": F.col("place") + 100_000_000, "title": F.lit("late")}))


_DOCS = r"""SELECT page_id // 10 AS book, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS name, html, page_id,
    CASE WHEN page_id % 4 <> 0 THEN 1000 - page_id % 10 END AS spine_pos FROM pages"""
_TOC = rf"""SELECT book, key, arg_min(title, page_id) AS toc_title FROM (SELECT book, page_id, 'Part ' || page_id AS title, unnest(list_distinct([path, regexp_extract(path, '[^/]*$')])) AS key FROM (
    SELECT book, page_id, CASE WHEN page_id % 2 = 0 THEN name ELSE regexp_extract(name, '[^/]*$') END AS path FROM ({_DOCS}) WHERE book % 2 = 0 AND page_id % 3 <> 0) WHERE path <> '') GROUP BY ALL"""


@query(rf"""WITH docs AS ({_DOCS}), toc AS ({_TOC}) SELECT page_id, coalesce(a.toc_title, b.toc_title) AS toc_title FROM docs
          LEFT JOIN toc a ON a.book = docs.book AND a.key = name LEFT JOIN toc b ON b.book = docs.book AND b.key = regexp_extract(name, '[^/]*$')""")
def toc_titles(spark, d):
    return ingest.with_toc_titles(_documents(spark, d), _toc(spark, d)).select("page_id", "toc_title")


@query(f"SELECT book, page_id, row_number() OVER (PARTITION BY book ORDER BY spine_pos NULLS LAST, page_id) - 1 AS place FROM ({_DOCS})")
def spine_order(spark, d):
    return ingest.reading_order(_documents(spark, d)).select("book", "page_id", "place")


_TAGS = "blockquote|section|strong|code|span|pre|div|img|br|em|h1|h2|h3|h4|hr|li|ol|ul|a|b|i|p|u"


@query(rf"""SELECT page_id, sha256(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>|<!--.*?-->|<head\b.*?</head>|<!doctype[^>]*>', '', 'gis'),
          '<(/?)({_TAGS})([\s/][^>]*)?>', chr(1) || '\1\2' || chr(2), 'gi'), '<[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>'), '^\s+|\s+$', '', 'g')) AS sha FROM pages""")
def sanitised_html(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(ingest.clean_markup(F.col("html")), 256).alias("sha"))


@query()
def book_sections(spark, d):
    """Sections of books of documents: listed ones, in reading order, titled and cleaned."""
    return ingest.book_sections(_documents(spark, d), _toc(spark, d))


_SRC = "CASE page_id % 5 WHEN 0 THEN 'img/a%20' || page_id % 7 || '.png?x=1' WHEN 1 THEN '../img/a ' || page_id % 7 || '.png' WHEN 2 THEN '/cover.png#z' WHEN 3 THEN 'http://h/x/./b.png' ELSE '' END"


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'img/a ' || page_id % 7 || '.png' WHEN 1 THEN 'img/a ' || page_id % 7 || '.png' WHEN 2 THEN 'cover.png' WHEN 3 THEN 'b.png' END AS image
          FROM pages WHERE page_id % 5 IN (2, 3) OR (page_id % 5 < 2 AND page_id % 7 < 4)""")
def image_lookup(spark, d):
    """Image links of documents in a folder: relative, escaped, upwards, absolute and empty; not every image is stored."""
    links = S.table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("book"), F.lit("text/ch.html").alias("document"), F.expr(_SRC).alias("src"))
    numbers = F.array(*map(F.lit, range(4)))
    names = F.flatten(F.array(F.transform(numbers, lambda n: F.format_string("text/img/a %d.png", n)), F.transform(numbers, lambda n: F.format_string("img/a %d.png", n)), F.array(F.lit("cover.png"), F.lit("b.png"))))
    images = links.select("book").distinct().select("book", F.explode(names).alias("image"))
    found = ingest.resolved_images(links.filter("src <> ''"), images)
    return links.join(found, ["book", "document", "src"]).select("page_id", "image")


_QUOTED = """CASE page_id % 3 WHEN 0 THEN '<img alt="Cat > dog" src="' || s || '"/>' WHEN 1 THEN '<IMG class=x src="' || s || '" alt="A ~b~">' ELSE '<img data-src="no" src=' || replace(s, ' ', '%20') || '>' END"""
_CLEAN = rf"""regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html || '<p>x</p>', '<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>|<!--.*?-->|<head\b.*?</head>|<!doctype[^>]*>', '', 'gis'),
    '<(/?)({_TAGS})([\s/][^>]*)?>', chr(1) || '\1\2' || chr(2), 'gi'), '<[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>'), '^\s+', '', 'g')"""


@query(f"""SELECT page_id, sha256({_CLEAN} || CASE WHEN page_id % 5 IN (2, 3) OR (page_id % 5 < 2 AND page_id % 7 < 4) THEN '<img src="data:' || CASE page_id % 5 WHEN 2 THEN 'cover.png' WHEN 3 THEN 'b.png' ELSE 'img/a ' || page_id % 7 || '.png' END
          || '" alt="' || CASE page_id % 3 WHEN 0 THEN 'Cat > dog' WHEN 1 THEN 'A &quot;b&quot;' ELSE '' END || '">' ELSE '' END) AS sha FROM pages""")
def linked_images(spark, d):
    """Pages with an image each, in double, single and no quotes; not every image is stored."""
    pages = S.table(spark, d, "pages").withColumn("s", F.expr(_SRC))
    single = F.when(F.col("page_id") % 3 == 1, F.translate(F.expr(_QUOTED), "\"~", "'\"")).otherwise(F.expr(_QUOTED))
    docs = pages.select(F.floor(F.col("page_id") / 10).alias("book"), F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.concat("html", F.lit("<p>x</p>"), single).alias("html"), "page_id")
    names = F.expr("concat(transform(sequence(0, 3), n -> concat('img/a ', n, '.png')), transform(sequence(0, 3), n -> concat('text/img/a ', n, '.png')), array('cover.png', 'b.png'))")
    images = docs.select("book").distinct().select("book", F.explode(names).alias("image")).withColumn("data", F.concat(F.lit("data:"), F.regexp_replace("image", "^text/", "")))
    out = ingest.linked_markup(docs, images).join(docs.select("book", "name", "page_id"), ["book", "name"])
    return out.select("page_id", F.sha2("html", 256).alias("sha"))


def _shelved(spark, d):
    return S.novels(spark, d).withColumn("archived", F.col("novel") % 3 == 0)


@query(r"""SELECT novel, title, progress_section, section_count, coalesce(nullif(left(regexp_replace(bare, '^\s+|\s+$', '', 'g'), 140) || CASE WHEN length(bare) > 140 THEN '...' ELSE '' END, ''), 'No text content available.') AS preview
          FROM (SELECT n.novel, n.title, coalesce(p.section_index, 0) AS progress_section, coalesce(s.n, 0) AS section_count, regexp_replace(coalesce(s.first, ''), '<[^>]*>', '', 'g') AS bare FROM novels n
          LEFT JOIN (SELECT novel, count(*) AS n, arg_min_null(text, section_index) AS first FROM sections GROUP BY 1) s USING (novel)
          LEFT JOIN (SELECT novel, arg_max(section_index, (updated_at, section_index)) AS section_index FROM progress GROUP BY 1) p USING (novel) WHERE n.novel % 3 <> 0)""")
def shelf(spark, d):
    """Books that are not archived, with the latest reader's section and a preview."""
    out = library.shelf(_shelved(spark, d), S.sections(spark, d), S.progress(S.reader_events(spark, d)))
    return out.select("novel", "title", "progress_section", "section_count", "preview")


@query("SELECT novel, section_index, doc_id, n.title AS novel_title, 'Author ' || novel % 3 AS author, CASE WHEN novel % 2 = 0 THEN 'ready' ELSE 'new' END AS status FROM section_keys JOIN novels n USING (novel)")
def sections_with_novel(spark, d):
    novels = S.novels(spark, d).withColumns({"author": F.concat(F.lit("Author "), (F.col("novel") % 3).cast("string")), "status": F.when(F.col("novel") % 2 == 0, "ready").otherwise("new")})
    return library.sections_with_novel(S.section_keys(spark, d), novels).select("novel", "section_index", "doc_id", "novel_title", "author", "status")


@query("SELECT novel, uuid FROM novels WHERE novel % 4 = 3 AND novel % 5 <> 0 AND novel IN (SELECT novel FROM section_keys WHERE doc_id % 2 = 0)")
def index_backfill(spark, d):
    """Listed novels that are parsed and have a section."""
    novels = S.novels(spark, d).withColumn("parse_status", F.when(F.col("novel") % 4 == 3, "complete").otherwise("pass2_running"))
    out = library.to_index(novels, S.section_keys(spark, d).filter("doc_id % 2 = 0"), novels.filter("novel % 5 <> 0").select("uuid"))
    return out.select("novel", "uuid")


@query("""SELECT novel, coalesce(max(section_index), -1) AS last_section, coalesce(max(sequence_number), -1) AS last_sequence, coalesce(array_to_string(list_sort(list_distinct(list(section_index))), ','), '') AS finished
          FROM novels LEFT JOIN entries USING (novel) GROUP BY 1""")
def section_bounds(spark, d):
    out = library.section_bounds(S.novels(spark, d), S.dialogue_entries(spark, d))
    return out.withColumn("finished", F.array_join(F.col("finished").cast("array<string>"), ","))


@query("""SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'Unknown size' WHEN n < 1024 THEN format('{:.1f} B', n / 1.0) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0) WHEN n < 1073741824
          THEN format('{:.1f} MB', n / 1048576.0) WHEN n < 1099511627776 THEN format('{:.1f} GB', n / 1073741824.0) ELSE format('{:.1f} TB', n / 1099511627776.0) END AS size
          FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars * CAST(pow(512, doc_id % 5) AS BIGINT) END AS n FROM documents)""")
def size_texts(spark, d):
    size = F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") * F.pow(F.lit(512), F.col("doc_id") % 5).cast("long"))
    return S.table(spark, d, "documents").select("doc_id", T.size_text(size).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'Never' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown FROM events")
def date_texts(spark, d):
    return S.table(spark, d, "events").select("event_id", T.date_text(F.when(F.col("event_id") % 6 != 0, F.col("ts"))).alias("shown"))


@query(r"""SELECT doc_id, count(*) AS n, sha256(string_agg(k || ':' || length(s), ',' ORDER BY k)) AS sha FROM (SELECT doc_id, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k
          FROM (SELECT doc_id, unnest(found) AS s, unnest(range(len(found))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?[.!?]["”’'')\]]*(?:\s+|\z)|.+\z') AS found FROM documents))) WHERE regexp_matches(s, '\S') GROUP BY 1""")
def sentence_offsets(spark, d):
    """Number, places and lengths of the sentences of every document that has one."""
    found = S.table(spark, d, "documents").select("doc_id", segment.sentence_spans(F.col("text")).alias("s")).filter("size(s) > 0")
    shown = F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), F.length(x["text"]).cast("string")))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join(shown, ","), 256).alias("sha"))


@query("""SELECT doc_id, length(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS d200, length(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS d300,
          sha256(CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END) AS summary, sha256(left(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 600)) AS passage FROM documents""".replace("\\\\", "\\"))
def prompt_cuts(spark, d):
    """Cuts of a text for prompts: descriptions, summaries and passages."""
    t = F.col("text")
    return S.table(spark, d, "documents").select(
        "doc_id", F.length(T.capped(t, 200)).cast("long").alias("d200"), F.length(T.capped(t, 300)).cast("long").alias("d300"),
        F.sha2(T.capped(t, 150), 256).alias("summary"), F.sha2(T.passage(t), 256).alias("passage"),
    )


_KINDS = "CASE event_type WHEN 'click' THEN 'bookmark' WHEN 'purchase' THEN 'highlight' WHEN 'signup' THEN 'lookup' END"


def _items(spark, d):
    return S.reader_events(spark, d).withColumn("kind", F.expr(_KINDS)).filter("kind is not null").withColumnsRenamed({"ts": "created_at", "event_id": "id"})


@query(f"""SELECT novel, kind, event_id AS id FROM (SELECT *, {_KINDS} AS kind FROM reader_events) WHERE kind IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY novel, kind ORDER BY ts DESC, event_id DESC) <= 20""")
def sidebar_items(spark, d):
    """The newest twenty bookmarks, highlights and lookups of every novel."""
    return library.recent_items(_items(spark, d)).select("novel", "kind", "id")


@query("""SELECT novel, event_id AS id, row_number() OVER (PARTITION BY novel ORDER BY section_index, ts, event_id) AS place FROM reader_events WHERE event_type = 'click'""")
def bookmark_listing(spark, d):
    return library.ordered_bookmarks(_items(spark, d).filter("kind = 'bookmark'")).select("novel", "id", "place")


@query("""SELECT novel, section_index, string_agg('label ' || event_id, '|' ORDER BY event_id) AS labels FROM reader_events WHERE event_type = 'signup' GROUP BY ALL""")
def section_lookups(spark, d):
    """The lookups of every section."""
    items = _items(spark, d).filter("kind = 'lookup'").withColumn("label", F.concat(F.lit("label "), F.col("id").cast("string")))
    return library.section_labels(items).select("novel", "section_index", F.array_join("labels", "|").alias("labels"))


@query("""SELECT novel, character_id, min(section_index) AS first_section FROM (SELECT novel, section_index, unnest([CASE WHEN turn % 4 <> 3 THEN turn % 7 END, turn % 5, CASE WHEN turn % 2 = 0 THEN conv_id % 11 END]) AS character_id FROM entries)
          WHERE character_id IS NOT NULL GROUP BY ALL""")
def first_met(spark, d):
    """Where every character first speaks or is named; some lines have no speaker."""
    lines = S.dialogue_entries(spark, d).withColumns({
        "speaker_id": F.when(F.col("turn") % 4 != 3, F.col("turn") % 7), "associated": F.when(F.col("turn") % 2 == 0, F.array(F.col("turn") % 5, F.col("conv_id") % 11)).otherwise(F.array(F.col("turn") % 5)),
    })
    return library.first_met(lines)
