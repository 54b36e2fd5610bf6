import os
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from prose.llm import pages

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, blocks string, other string"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.page_id: r.text for r in pages.extract(df).collect()}


def test_article_without_furniture():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
    <nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><div id='cookie-notice'>cookies</div><aside>side</aside>
    <article><h1>Title &amp; more</h1><p>One<b> two</b>\n\t three&nbsp;four<!-- no --><p><b>bold.<br><p>last &lt;p&gt; &quot;x&quot;
    <form><input><button>go</button></form><div class="adverse">stays</div><section class="comments"><p>reader</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert pages.kept_lines(pages.lines(page), set()) == ["Title & more", "One two three four", "bold.", 'last <p> "x"', "stays"]
    assert [t for t, f, _ in pages.lines(page) if f] == ["menu", "buy", "cookies", "side", "go", "reader", "© me"]


def test_a_header_in_the_article_holds_its_title():
    page = "<header>site</header><article><header><h1>Title</h1></header><p>a <button>go</button>b</p><footer>f</footer></article>"
    assert pages.kept_lines(pages.lines(page), set()) == ["Title", "a b"]


@given(st.text(alphabet="<>/ab=\"'!-& p", max_size=60))
def test_any_markup_is_read(text):
    pages.lines(text)


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_lines_are_longest(a, b):
    assert_longest(pages.common_lines(a, b), a, b)


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def assert_longest(found, a, b):
    rest = iter(b)
    assert len(found) == longest(a, b) and found == sorted(found) and all(a[k] in rest for k in found)


def test_very_long_pages_are_aligned():
    a = [k % 977 for k in range(20_000)]
    b = [k % 977 for k in range(500, 20_300) if k % 50]
    found = pages.common_lines(a, b)
    assert len(found) > 19_000 and found == sorted(found)


def key(url):
    host = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", (url or "").lower())
    path = re.sub(r"[?#].*$", "", re.sub(r"^[a-z][a-z0-9+.-]*://[^/?#]*", "", (url or "").lower()))
    return (host[1] if host else "", path)


def by_hand(rows):
    """Brute force: sort, pair with the page before in the host (the first with the one after), align, delete."""
    order = sorted(rows, key=lambda r: (*key(r[1]), r[0]))
    out = {}
    for k, (page, url, html) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and key(order[j][1])[0] == key(url)[0]]
        own = pages.lines(html or "")
        a, b = ([t for t, _, _ in x] for x in (own, pages.lines(near[0][2] or "") if near else []))
        at = pages.common_lines([pages.line_hash(x) for x in a], [pages.line_hash(x) for x in b])
        assert len(at) == longest(a, b)
        shared = {a[k] for k in at}
        left = [(t, i) for t, f, i in own if not f and (i or t not in shared)]
        kept = [t for t, i in left if i] or [t for t, _ in left]
        out[page] = ("\n\n".join(kept), sum(t in shared and (f or not i) for t, f, i in own))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_all_pages_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    got = {r.page_id: (r.text, r.n_shared) for r in pages.extract(df).collect()}
    assert got == by_hand(rows)
    assert any(n for _, n in got.values())


def test_differencing_alone_finds_the_text_of_unmarked_pages(spark):
    """Without articles, classes or telling tags, menus and footers go because neighbours share them."""
    page = lambda k: f"<div><span>home</span></div><div>about</div><div>own {k}</div><div>more {k}</div><div>© us</div>"
    rows = [(k, f"http://h.x/a/{k}", page(k)) for k in range(1, 30)]
    got = extracted(spark, rows)
    assert got == {k: f"own {k}\n\nmore {k}" for k in range(1, 30)}


def test_differencing_deletes_shared_lines(spark):
    body = lambda *lines: "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    article = lambda x: f"<body><p>top</p><article><p>{x}</p><p>same</p></article></body>"
    rows = [
        (1, "http://h.x/a/1", body("top", "own 1", "end")), (2, "http://h.x/a/2?q=1", body("top", "own 2", "end")),
        (3, "http://other.x/a", body("top", "own 3")), (4, "http://k.x/1", article("A")), (5, "http://k.x/2", article("B")),
        (6, None, None), (7, "odd", ""),
    ]
    got = extracted(spark, rows + [rows[0]])
    assert got == {1: "own 1", 2: "own 2", 3: "top\n\nown 3", 4: "A\n\nsame", 5: "B\n\nsame", 6: "", 7: ""}
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_across_partitions(spark):
    df = spark.createDataFrame([(k, f"http://h.x/{k:04d}", "", "", "") for k in range(1, 200)], SCHEMA)
    got = {r.page_id: r.other for r in pages.neighbours(df.repartition(7)).collect()}
    assert got == {k: max(k - 1, 1) if k > 1 else 2 for k in range(1, 200)}
