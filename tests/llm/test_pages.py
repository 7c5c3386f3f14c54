"""Pages whose names look like those of menus, and articles in parts."""

import pytest

from lexiloom.llm import htmltext


def texts(spark, shell, n=8):
    rows = [(k, f"https://a.example/{k}", shell.replace("#", str(k)), "s") for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slot string")
    return {r.page_id: r.text for r in htmltext.extract_pages(df).collect()}


@pytest.mark.parametrize("wrapper", ['class="content no-sidebar"', 'id="page" class="has-sidebar"', 'class="sidebar"'])
def test_wrappers_named_after_sidebars(spark, wrapper):
    shell = f'<body><div {wrapper}><article><h1>H #</h1><p>Text number # of the page</p></article></div><div class="comment-list"><p>Nice #!</p></div></body>'
    assert texts(spark, shell) == {k: f"H {k}\nText number {k} of the page" for k in range(8)}


def test_names_that_mark_everything_mark_nothing():
    assert htmltext.extract('<body><div class="sidebar"><p>All there is</p></div></body>', None) == "All there is"


def test_headings_and_sections_with_ids_of_their_subject():
    page = '<article><h2 id="side-effects">Side</h2><p id="search">One</p><h2 id="related-work">Work</h2><section id="search-methods"><p>Two</p></section><div class="share-buttons">Share</div><div id="comments"><article>Nice</article></div></article>'
    assert htmltext.extract(page, None) == "Side\nOne\nWork\nTwo"


@pytest.mark.parametrize("outer", ["article", "div"])
def test_articles_in_parts_stay_whole(spark, outer):
    shell = f'<body><nav>Menu</nav><{outer}><h1>Head #</h1><div class="lead"><p>Lead # in a few words</p></div><div class="body"><p>{"Body # with many more words. " * 9}</p></div></{outer}><p>Same on every page</p></body>'
    got = texts(spark, shell)
    for k in range(8):
        assert got[k].split("\n")[:3] == [f"Head {k}", f"Lead {k} in a few words", (f"Body {k} with many more words. " * 9).strip()]


BOXED = '<body><nav>Menu</nav><article><h1>Head #</h1><p>Body # with words of its own</p><div class="box"><p>Thank you for reading us</p></div><p>End of #</p></article></body>'


def test_texts_of_the_template_go(spark):
    assert texts(spark, BOXED, 10) == {k: f"Head {k}\nBody {k} with words of its own\nEnd of {k}" for k in range(10)}


def optional_parts(k):
    one = '<div class="one"><p>First box</p></div>' if k % 10 < 6 else ""
    two = '<div class="two"><p>Second box</p></div>' if k % 10 > 3 else ""
    both = two + one if k % 10 == 5 else one + two
    return f"<body><article><h1>Head {k}</h1><p>Body {k}</p>{both}<p>End {k}</p></article></body>"


def test_classes_need_equal_vectors(spark, monkeypatch):
    """Two boxes on 60 % of the pages each: by their vectors they are two ordered classes; without vectors they would be one that breaks."""
    rows = [(k, f"https://a.example/{k}", optional_parts(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract_pages(df).collect()} == {k: f"Head {k}\nBody {k}\nEnd {k}" for k in range(20)}
    vectors = htmltext.F.xxhash64
    monkeypatch.setattr(htmltext.F, "xxhash64", lambda *c: htmltext.F.lit(0).cast("bigint"))
    without = {r.page_id: r.text for r in htmltext.extract_pages(df).collect()}
    monkeypatch.setattr(htmltext.F, "xxhash64", vectors)
    assert "First box" in without[0] and "Second box" in without[9]


def test_classes_out_of_order_or_across_others_are_broken():
    import numpy as np

    frame = np.zeros(6, htmltext.FRAME)
    frame["cls"] = [0, 0, 0, 1, 1, 2]
    sizes = np.array([3, 2, 1])
    broken = lambda *found: htmltext.broken_classes(list(found), frame, sizes)
    assert broken(0, 1, 3, 4, 2) == set() and broken(0, 1, 2, 5) == set()
    assert broken(1, 0, 2) == {0} and broken(0, 1) == {0} and broken(0, 3, 1, 4, 2) == {1}


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(k, f"https://a.example/{k}", "<article><h1>Same</h1><p>Everywhere the same article</p></article>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in htmltext.extract_pages(df).collect()} == {"Same\nEverywhere the same article"}


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<svg>" * 50_000 + "x", "<a " * 100_000, "<p>x</b>" * 40_000, '<div class="menu">' * 30_000 + "<article>x</article>" * 3_000])
def test_long_and_deep_pages(page):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    blocks, elements = htmltext.parse(page)
    assert time.perf_counter() - began < 20
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert blocks or page.startswith("<a ")


def test_headings_that_articles_share_stay(spark):
    """Twelve pages of a host, each with its own text under the same headings; those over nothing of the page's own go."""
    word = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows, wanted = [], {}
    for k in range(12):
        article = f"<h1>Title {k}</h1><h2>Introduction</h2><p>{word(k, 40)}</p><h2>Data</h2><h3>Table</h3><table><tr><th>Name</th></tr><tr><td>{word(k + 50, 9)}</td></tr></table><h2>Conclusion</h2><p>{word(k + 100, 30)}</p><h2>More to read</h2><p>The same on every page.</p>"
        rows.append((k, f"http://one.example/{k}", f"<html><body><div class='menu'><a>Home</a></div><article>{article}</article><div class='footer'>All rights</div></body></html>"))
        wanted[k] = "\n".join([f"Title {k}", "Introduction", word(k, 40), "Data", "Table", "Name", word(k + 50, 9), "Conclusion", word(k + 100, 30)])
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == wanted


def test_only_blocks_break_lines():
    page = "<article><p>a <ruby>b<rt>c</rt></ruby> <label>d</label> <my-term>e</my-term><x-y z='1'>f</x-y> <math><mi>g</mi></math> <object>h</object> <noscript>i</noscript></p><app-box class='advert'><p>gone</p></app-box><center>j</center><p>k</article>"
    blocks, _ = htmltext.parse(page)
    assert [b.text for b in blocks if not b.aside] == ["a bc d ef g h i", "j", "k"]
