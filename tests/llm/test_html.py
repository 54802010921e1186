import itertools
import time

import numpy as np

from postloom.llm import html_text as m

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div id="cookie-banner">We use cookies <button>OK</button></div><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<main><article><header><h1>Title here</h1><p class="byline">By X</p></header><p>First para with <b>bold</b> &amp; <a href=q>link</a>
text.</p><div class="ad-slot">Buy now!</div><p>Sh is.</p><ul><li>one<li>two</ul><form><input name=q><label>Subscribe</label></form><p>Last &nbsp; para.<br>
<section id="comments"><article class="comment"><p>Nice article and so on, I like this.</p></article></section></article>
<aside class="sidebar"><p>Popular posts list here with long text to read, indeed.</p></aside></main><footer>(c) 2020</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_main_text():
    assert m.main_text(PAGE) == "Title here\nBy X\nFirst para with bold & link text.\nSh is.\none\ntwo\nLast para."


def test_page_without_marks():
    page = "<div><a href=a>Home</a> <a href=b>News</a></div><div><p>This is a long paragraph of a page without marks, which goes on for a while.</p><p>Short one.</p><p>And another long paragraph follows here with many words.</p></div><div><a href=q>Privacy</a> | <a href=z>Terms</a></div>"
    assert m.main_text(page).split("\n")[1] == "Short one." and "Home" not in m.main_text(page) and "Terms" not in m.main_text(page)


LONG = "This is a sentence of the article that goes on for quite a while, so that nobody takes it for a menu."


def labels_by_sign(page):
    read = m.read_page(page)
    found = m.settings(read)
    home = any(f in (m._HOME_TAG, m._HOME_MARK) for f in found)
    return "\n".join(b.text for b in read.blocks if m.evidence(b, found[b.element], home) > 0)


def test_cut_decides_where_single_blocks_mislead():
    short = f"<div><p>{LONG}</p><p>Not so</p><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>"
    menu = "<ul>" + "".join(f"<li><a href=x>Topic {i}</a></li>" for i in range(4)) + "<li>All about us and our many good friends</li>" + "".join(f"<li><a href=y>More {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<html><body>{menu}{short}</body></html>"
    want = "\n".join([LONG, "Not so", LONG, "Yes", LONG])
    assert m.main_text(page) == want != labels_by_sign(page)
    assert "Not so" not in labels_by_sign(page) and "All about us" in labels_by_sign(page)


def test_wrappers_do_not_empty_an_article():
    article = f"<article><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></article>"
    want = f"A title\n{LONG}\n{LONG}"
    for name in ("layout has-sidebar", "content with-comments", "content-notice-board", "site-content has-sidebar", "page no-ads", "sidebar", "popup-modal"):
        side = '<div class="left-sidebar"><p>Popular posts list with some words.</p></div>'
        assert m.main_text(f'<body><div class="{name}">{article}{side}</div></body>') == want, name
    marked = f'<body><div class="widget-area sidebar"><p>{LONG}</p><p>{LONG}</p></div><p><a href=x>Home</a></p></body>'
    assert m.main_text(marked) == f"{LONG}\n{LONG}"
    comments = f'<body><main><p>{LONG}</p><p>{LONG}</p></main><ol class="comment-list"><li class=comment><article><p>{LONG}</p></article></ol></body>'
    assert m.main_text(comments) == f"{LONG}\n{LONG}"


def test_attributes_of_any_length_and_marks_of_other_names():
    value = "a > b " * 3000
    page = f'<body><article><p title="{value}" data-hidden="false">{LONG}</p><p class=\'x\' title=don\'t>{LONG}</p><math><mi>E = m</mi></math></article></body>'
    assert m.main_text(page) == f"{LONG}\n{LONG}\nE = m"
    assert m.main_text(f"<p>{LONG} 1 < 2 <!-- left > open") == f"{LONG} 1 < 2"


def test_many_odd_signs_take_linear_time():
    at = time.perf_counter()
    m.main_text("<p>" + "<d " * 40_000)
    m.main_text("<p>" + "<a b=' \" " * 40_000)
    m.main_text("<p>x</p>" + "".join(f"<div class=c{i % 7}><p>words {i} of a block.</p><a href=x>l</a></div>" for i in range(8_000)))
    assert time.perf_counter() - at < 20


def test_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        e = [float(x) for x in rng.normal(size=n)]
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels, e=e, edges=edges):
            return sum(x if x > 0 and not l else -x if x <= 0 and l else 0 for x, l in zip(e, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert abs(cost(m.min_cut(e, edges)) - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-9


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b"), (None, "u", PAGE), (4, "u", "<script>x"), (5, "u", "<div>" * 2000 + "deep words of text." + "<a href=\"" * 500), (4, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = m.extract_main_text(df).collect()
    assert len(out) == 7 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert [r["text"] for r in out if r["page_id"] in (1, 2, 4)] == [""] * 4
    assert m.extract_main_text(df.limit(0)).count() == 0


def test_headers_inside_articles_stay():
    prose = "This is a long paragraph of plain prose that an article would hold, with many words in it and an end. " * 3
    for mark in ("entry-header", "article-header", "post-header"):
        page = f'<header class="site-header"><a href="/">Home</a></header><article><header class="{mark}"><h1>Rain</h1><p>The standfirst.</p></header><p>{prose}</p></article>'
        assert m.main_text(page) == f"Rain\nThe standfirst.\n{prose.strip()}"
    for mark in ("form-group", "video-widget", "meta-analysis", "alert"):
        assert m.main_text(f'<article><h1>Title of it</h1><p>{prose}</p><div class="{mark}"><p>{prose}</p></div></article>').count(prose.strip()) == 2
    assert m.main_text("<div><h1>Recipe</h1><ul><li>Flour<li>Two eggs</ul></div>") == "Recipe\nFlour\nTwo eggs"
    assert m.main_text("<p>One short line.</p>") == "One short line." and m.main_text("<nav><a href=x>Menu</a></nav>") == ""
