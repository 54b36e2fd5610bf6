"""Images in markup, chunks of positions and places of texts, against plain loops."""

import html
import posixpath
import random
import time
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pytest

from prose.operators import enrich, ingest, requests


class Rewriter(HTMLParser):
    """Allowed elements and texts as a parser reads them; images by what is stored."""

    def __init__(self, document, stored):
        super().__init__(convert_charrefs=False)
        self.document, self.stored, self.out = document, stored, []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            attrs = dict(attrs)
            path = unquote(urlsplit(attrs.get("src") or "").path)
            tried = [path, path.lstrip("/"), posixpath.normpath(posixpath.join(posixpath.dirname(self.document), path)), posixpath.basename(path)]
            hit = next((self.stored[t] for t in tried if path and t in self.stored), None)
            if hit:
                self.out.append(f'<img src="{hit}" alt="{(attrs.get("alt") or "").replace(chr(34), "&quot;")}">')
        elif tag in ingest.ALLOWED:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if tag == "img":
            return
        if tag in ingest.ALLOWED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")


def test_images_equal_a_parsers(spark):
    rng = random.Random(4)
    stored = {"img/a b.png": "data:1", "t/img/c.png": "data:2", "cover.png": "data:3", "q&a.png": "data:4"}
    sources = ["img/a%20b.png", "img/c.png", "/cover.png?x=1#y", "../cover.png", "http://h/x/cover.png", "none.png", "", "q&amp;a.png", "./img/c.png"]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 8)):
            src, alt = rng.choice(sources), rng.choice(["", "A cat", "a > b", "it's", "x &amp; y"])
            q = '"' if "'" in alt else rng.choice("\"'")
            shapes = [f'<img src={q}{src}{q} alt={q}{alt}{q}>', f'<IMG\n alt={q}{alt}{q} class="k" SRC = "{src}"/>', f"<img data-src='z.png' src={src or 'none'}>", f'<img alt={q}{alt}{q}>']
            parts += [rng.choice(["<p>one</p>", "two &amp; ", "<table>t</table>", "<a href='#'>l</a>", "<em class=x>e</em>", "<!-- <img src='cover.png'> -->"]), rng.choice(shapes)]
        docs.append((k % 3, f"t/d{k}.html", "".join(parts)))
    images = [(b, name, data) for b in range(3) for name, data in stored.items()]
    got = ingest.linked_markup(spark.createDataFrame(docs, "book int, name string, html string"), spark.createDataFrame(images, "book int, image string, data string"))
    want = {}
    for _, name, page in docs:
        parser = Rewriter(name, stored)
        parser.feed(page)
        parser.close()
        want[name] = "".join(parser.out).strip()
    # A parser decodes references in attributes; the markup keeps them.
    assert {r.name: html.unescape(r.html) for r in got.collect()} == {n: html.unescape(x) for n, x in want.items()}
    assert sum("<img" in x for x in want.values()) > 30


def test_images_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, "a", None), (1, "b", ""), (1, "c", "x\x01y\x03z<img src=i.png>"), (2, "a", "<img src='i.png'>")], "book int, name string, html string")
    images = spark.createDataFrame([(1, "i.png", "d"), (1, "i.png", "d")], "book int, image string, data string")
    assert {(r.book, r.name): r.html for r in ingest.linked_markup(docs, images).collect()} == {(1, "a"): "", (1, "b"): "", (1, "c"): 'xyz<img src="d" alt="">', (2, "a"): ""}


@pytest.mark.parametrize("width", [7, 4096])
def test_chunks_of_positions(spark, width):
    rng = random.Random(width)
    chunks, entries = [], []
    for novel in range(6):
        for chunk in range(rng.randint(0, 30) if novel else 0):
            start = rng.randrange(400)
            chunks.append((novel, chunk, start, start + rng.randint(0, 60)))
        entries += [(novel, e, rng.randrange(-5, 500)) for e in range(40)] + [(novel, 5, 7)]
    want = set()
    for novel, e, pos in entries:
        own = [(not s <= pos < t, 0 if s <= pos < t else abs(pos - s), c) for n, c, s, t in chunks if n == novel]
        if own:
            want.add((novel, e, pos, min(own)[2]))
    df = enrich.chunk_of_position(spark.createDataFrame(entries, "novel int, entry int, pos int"), spark.createDataFrame(chunks, "novel int, chunk int, char_start int, char_end int"), ["novel"], width)
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_long_chapter_makes_no_pairs(spark):
    """50 000 positions and 20 000 chunks of one chapter: rows of the join are those of a bin."""
    n = 20_000
    chunks = spark.range(n).selectExpr("1 AS novel", "int(id) AS chunk", "int(id * 100) AS char_start", "int(id * 100 + 110) AS char_end")
    entries = spark.range(50_000).selectExpr("1 AS novel", "int(id) AS entry", "int(id * 41) AS pos")
    began = time.time()
    out = enrich.chunk_of_position(entries, chunks, ["novel"])
    wrong = out.filter(f"chunk <> case when pos % 100 < 10 and pos >= 100 and pos < {n * 100 + 10} then int(pos div 100) - 1 else least(int(pos div 100), {n - 1}) end").count()
    assert wrong == 0 and time.time() - began < 60


def fold(text, needles):
    cursor, out = 0, []
    for n in needles:
        at = -1
        if n:
            at = text.find(n, cursor)
            at = text.find(n) if at < 0 else at
            at = text.find(n[:48], cursor) if at < 0 else at
        out.append(at if at >= 0 else cursor)
        cursor = at + max(len(n), 1) if at >= 0 else cursor
    return out


def test_places_equal_the_fold(spark):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        text = "".join(rng.choices("ab é🙂", k=rng.randint(0, 300))) + "x" * rng.randint(0, 120)
        needles = []
        for _ in range(rng.randint(0, 25)):
            at = rng.randrange(len(text) + 1)
            piece = text[at : at + rng.choice([1, 3, 40, 47, 48, 49, 90])]
            needles.append(rng.choice([piece, piece, piece + "?", "q" + piece, "", None, piece[::-1]]))
        rows.append((k, text, needles))
    got = requests.located(spark.createDataFrame(rows, "k int, text string, needles array<string>")).collect()
    assert {r.k: r.positions for r in got} == {k: fold(t, n) for k, t, n in rows}
    none = spark.createDataFrame([(None, ["a", ""]), ("abc", None), ("abc", [])], "text string, needles array<string>")
    assert [r.positions for r in requests.located(none).collect()] == [[0, 0], [], []]


def test_misses_cost_no_search():
    """A chapter of ten million characters and ten thousand needles that it does not hold."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5_000)]
    text = " ".join(rng.choices(words, k=10_000_000 // 7))
    needles = [f"miss {k} " + "z" * 60 for k in range(10_000)] + [text[9_000_000:9_000_100], text[50:150]]
    began = time.time()
    got = requests.positions(text, needles)
    assert got[:10_000] == [0] * 10_000 and got[-2:] == [text.find(n) for n in needles[-2:]]
    assert time.time() - began < 60
