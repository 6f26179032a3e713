import itertools
import random

import numpy as np

from lexloom.llm.html import N_FEATURES, blocks_of, extract_text, main_text, minimum_cut

NONE = np.zeros(N_FEATURES)
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="content"><header><a href="/">Site</a></header>
<nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><header><h1>The &amp;lt;title&gt;</h1></header><p>First <b>bold</b>
 line<br>goes&nbsp;on.<p>Second &eacute; one.<ul><li>point one<li>point two</ul><script>var x = "</p>";</script><div class="ad">Buy now</div>
<blockquote>Quoted words.</blockquote><form><p>Your mail</p><input></form><p>Last.</article>
<section id="comments"><p>Nice article, says a reader at length, and goes on and on.</p></section></main>
<aside><p>Related things.</p></aside><footer>&copy; me</footer><!-- <p>no</p> -->"""


def test_page():
    assert main_text(PAGE, NONE) == "\n\n".join(["The &lt;title>", "First bold line goes on.", "Second é one.", "point one", "point two", "Quoted words.", "Last."])


def test_pages_without_meaning_follow_the_classifier():
    weights = np.zeros(N_FEATURES)
    weights[1], weights[0], weights[3] = 2.0, -8.0, -4.0
    page = "<div><a>x</a> <a>y</a></div><div><div>" + "</div><div>".join(f"A long enough paragraph number {i}, that says something about it." for i in range(4)) + "</div></div><div>(c)</div>"
    assert main_text(page, weights).count("paragraph") == 4 and "(c)" not in main_text(page, weights) and "x" not in main_text(page, weights).split()


def test_odd_pages():
    for page in (None, "", "<", "<p", "&amp", "<p>a", "</p>a</div>", "<script>never closed <p>x", "<a href='x>y", "<!-- open", "<p class=\"a>b", "\x00<p>\x00", "<br><hr/><p/>x", "<table><tr><td>a<td>b<tr><td>c</table>"):
        main_text(page, NONE)
    assert [b.text for b in blocks_of("<table><tr><td>a<td>b<tr><td>c</table>d")] == ["a", "b", "c", "d"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep, NONE) == "x" and len(blocks_of("<p>a" * 20_000)) == 20_000
    assert len(main_text("<li>a<p>" * 20_000, np.ones(N_FEATURES)).split()) == 20_000


def test_void_elements_do_not_part_words():
    assert main_text("<p>super<wbr>cali<img src=x>fragil<br>istic</p>", NONE) == "supercalifragil istic"


def test_a_name_alone_does_not_empty_a_page():
    assert main_text('<div class="legal-text"><p>All of it.</p><p>And more.</p></div>', NONE) == "All of it.\n\nAnd more."
    assert main_text('<div class="widget">All of it.</div><footer>no</footer>', NONE) == "All of it."
    assert main_text('<div class="widget">Away.</div><article>This.</article>', NONE) == "This."
    assert main_text("<nav>Home</nav><footer>me</footer>", NONE) == ""


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 8)
        a, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(i, j, rng.random() * 1.5) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda x: sum(a[i] if not x[i] else b[i] for i in range(n)) + sum(c for i, j, c in edges if x[i] != x[j])  # noqa: E731, B023
        assert abs(cost(minimum_cut(a, b, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_query(spark):
    rows = [(i, f"u{i}", PAGE, "x") for i in range(20)] + [(90, None, None, "x"), (91, "u", "", "x"), (92, "u", PAGE, "x"), (92, "u", PAGE, "x"), (93, "u", "<article>" + "<p>word &amp; word</p>" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in extract_text(docs).collect()}
    assert extract_text(docs).count() == len(rows)
    assert got[0].text == got[92].text == main_text(PAGE, NONE) and got[0].n_chars == len(got[0].text)
    assert (got[90].text, got[90].n_chars, got[90].url, got[91].text) == ("", 0, None, "") and got[93].text == "\n\n".join(["word & word"] * 50_000)
    assert extract_text(docs.limit(0)).count() == 0
