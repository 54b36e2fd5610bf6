"""Main text of web pages by nearest-URL page differencing.

Each page is paired with its neighbour in URL-path order within its host. All its visible lines, those of
menus, footers and adverts like those of the article, are aligned with its neighbour's by a longest common
subsequence, and lines that both share are deleted as template text. Structure speaks on two points only:
a shared line inside the page's article (``article``, ``main`` or ``role=main``) stays, as neighbours often
carry the same passage, and an element that its tag, class or id marks as furniture goes even where its
line is the page's own. If a page has an article, what is left outside it goes too.

Pairing moves page ids and paths only, alignment moves line hashes only. Hosts are no key of any
shuffle: pages are range-partitioned by (host, path, page_id), neighbours are read off each sorted
partition, and the two end rows of every partition are matched afterwards. A host with a third of
all pages is spread like any other.

Cases with a defined result: null or empty html has no text; null or odd urls form a host of their
own; repeated rows of a page_id are extracted one by one, paired as
one page (by its least host, path and lines); of several longest alignments the one that matches
later lines counts, and a text is shared wherever it stands on the page once one of its lines is aligned; a
very long page is aligned in memory that grows with its lines, not with their square; a page alone
in its host loses nothing to differencing; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut

# HTML elements by what they mean for extraction.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_FURNITURE = frozenset(
    "aside button datalist dialog footer form header head iframe input label menu meter nav noembed noframes noscript "
    "object optgroup option output progress script select style svg template textarea title canvas audio video".split()
)
#: What a reader never sees as text: no line of the page.
_UNSEEN = frozenset("datalist head iframe noembed noframes noscript object script select style svg template textarea title canvas audio video".split())
_MARKED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|share|sharing|sidebar|signup|skip|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])"
)
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _marked(tag: str, attrs: str, in_article: bool = False) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the page's article. A header inside the article holds its title."""
    values = {m[1].lower(): _html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
    role = values.get("role", "").lower()
    named = any(_MARKED.search(values.get(k, "")) for k in ("class", "id")) and tag not in ("body", "html", "main")
    hidden = "hidden" in values or values.get("aria-hidden") == "true"
    article = tag in ("article", "main") or role in ("main", "article")
    by_tag = tag in _FURNITURE and not (in_article and tag in ("header", "hgroup"))
    return by_tag or role in _ROLES or named or hidden, article


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, furniture, inside the article) of all visible lines of a page, in order.

    A furniture element within a line, such as a button, is a line of its own and does not break the other.
    """
    out: list[tuple[str, bool, bool]] = []
    parts: tuple[list[str], list[str]] = ([], [])
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: dict[str, int] = {}
    skipped = inside = hidden = 0
    at, end = 0, len(page)

    def close_line(furniture: bool) -> None:
        text = " ".join(_html.unescape("".join(parts[furniture])).split())
        if text:
            out.append((text, furniture, inside > 0))
        parts[furniture].clear()

    def add(text: str) -> None:
        if text and not hidden:
            parts[skipped > 0].append(text)

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        add(m["cdata"] or "")
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCKS:
            close_line(skipped > 0)
        elif tag == "br":
            add(" ")
        if m["close"]:
            while opened.get(tag):
                name, furniture, article, unseen = stack.pop()
                if furniture and skipped == 1:
                    close_line(True)
                opened[name] -= 1
                skipped -= furniture
                inside -= article
                hidden -= unseen
                if name == tag:
                    break
            continue
        if tag in _VOID or (m["attrs"].endswith("/") and tag not in _BLOCKS):
            continue
        furniture, article = _marked(tag, m["attrs"], inside > 0 and not skipped)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if not furniture:
                add(body)
            continue
        stack.append((tag, furniture, article and not furniture and not skipped, tag in _UNSEEN))
        opened[tag] = opened.get(tag, 0) + 1
        skipped += furniture
        inside += stack[-1][2]
        hidden += stack[-1][3]
    close_line(False)
    close_line(True)
    return out


def kept_lines(found: list[tuple[str, bool, bool]], shared: set[int]) -> list[str]:
    """The lines of a page's main text: not shared unless in the article, no furniture, and of the article if there is one."""
    left = [(t, a) for t, f, a in found if (a and not f) or (not f and line_hash(t) not in shared)]
    return [t for t, a in left if a] or [t for t, _ in left]


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``, by bit vectors: one addition per line of a."""
    place: dict[int, int] = {}
    for j, x in enumerate(b):
        place[x] = place.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return [0, *np.cumsum(bits == 0).tolist()]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``: halves of a, solved one after the other (Hirschberg)."""
    seen = set(a) & set(b)
    at = [k for k, x in enumerate(a) if x in seen]
    b = [x for x in b if x in seen]
    out: list[int] = []
    todo = [(at, b)]
    while todo:
        at, b = todo.pop()
        while at and b and a[at[-1]] == b[-1]:
            out.append(at[-1])
            at, b = at[:-1], b[:-1]
        if not at or not b:
            continue
        if len(at) == 1:
            out += at if a[at[0]] in b else []
            continue
        half = len(at) // 2
        one = _lengths([a[k] for k in at[:half]], b)
        two = _lengths([a[k] for k in reversed(at[half:])], b[::-1])
        cut_at = max(range(len(b) + 1), key=lambda j: one[j] + two[len(b) - j])
        todo += [(at[:half], b[:cut_at]), (at[half:], b[cut_at:])]
    return sorted(out)


def _key(pages: DataFrame) -> DataFrame:
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
        F.regexp_replace(F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "").alias("path"),
    )


def neighbours(pages: DataFrame) -> DataFrame:
    """(page_id, other): the page before it in (host, path) order, or after it for the first of a host."""
    one = _key(pages).groupBy("page_id").agg(F.min(F.struct("host", "path")).alias("x"))
    keys = one.select("page_id", F.col("x.host").alias("host"), F.col("x.path").alias("path"))
    # Strings make the order of the range partitions that of Python, by code point as by UTF-8 byte.
    ordered = keys.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    schema = "part int, at int, host string, page_id long, before long, after long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, None

        def rows(found):
            at, host, page, before, after = map(list, zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (page, before, after))],
                ["part", "at", "host", "page_id", "before", "after"],
            )

        for batch in batches:
            found = []
            for page, host in zip(batch.column("page_id").to_pylist(), batch.column("host").to_pylist(), strict=True):
                same = held is not None and held[1] == host
                if held is not None:
                    found.append((*held, page if same else None))
                held = (0 if n == 0 else 1, host, page, held[2] if same else None)
                n += 1
            if found:
                yield rows(found)
        if held is not None:
            yield rows([(held[0] if n == 1 else 2, *held[1:], None)])

    placed = cut(ordered.mapInArrow(run, schema))
    # Two rows of every partition at most: at 0 is the first, 2 the last one.
    ends = placed.filter("at != 1")
    w = Window.orderBy("part", "at")
    same = lambda f: F.when(f("host").over(w) == F.col("host"), f("page_id").over(w))
    ends = ends.select(
        "page_id", F.coalesce("before", same(F.lag)).alias("before"), F.coalesce("after", same(F.lead)).alias("after")
    )
    both = placed.filter("at = 1").select("page_id", "before", "after").unionByName(ends)
    return both.select("page_id", F.coalesce("before", "after").alias("other")).filter("other is not null")


def _hashes(pages: DataFrame) -> DataFrame:
    """(page_id, lines): hashes of a page's visible lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[line_hash(t) for t, _, _ in lines(h.as_py() or "")] for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["page_id", "lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, lines array<long>")


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, shared): hashes of a page's lines that align with lines of its neighbour."""
    own = cut(_hashes(pages).groupBy("page_id").agg(F.min("lines").alias("lines")))
    other = own.select(F.col("page_id").alias("other"), F.col("lines").alias("other_lines"))
    pairs = neighbours(pages).join(own, "page_id").join(other, "other").select("page_id", "lines", "other_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(sorted({a[k] for k in common_lines(a, b)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["page_id", "shared"])

    return pairs.mapInArrow(run, "page_id long, shared array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, and n_shared: its lines that differencing deleted.

    Pages are parsed a second time here, which costs less than keeping their text in between.
    """
    shared = shared_lines(pages).filter(F.size("shared") > 0).withColumnRenamed("page_id", "_id")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    joined = source.join(shared, F.col("page_id") == F.col("_id"), "left").select("page_id", "url", "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for page, same in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                found, same = lines(page.as_py() or ""), set(same or ())
                texts.append("\n\n".join(kept_lines(found, same)))
                gone.append(sum(line_hash(t) in same and (f or not a) for t, f, a in found) if same else 0)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes), pa.array(gone, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_shared"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
