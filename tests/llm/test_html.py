"""Main text of pages."""

import html as H
import re

from tessera.llm import html_density as D


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


LONG = "This is a rather long paragraph of plain text, with several clauses and no link at all in it."
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(20)) + "</ul></nav>"


def test_article_without_the_rest():
    body = (f"{NAV}<header class='top'>Site name</header><!-- <p>no</p> --><div class='cookie-banner'>We use cookies</div>"
            f"<article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><div class='ad'>Buy now</div>"
            f"<p>a <a href='#'>link</a> inside<br>after</p><form><input value=x>Sign up</form><pre>x  \n y</pre></article>"
            f"<aside>{LONG}</aside><section id='comments'><h2>Comments</h2><p>{LONG}</p></section><footer>&copy; me</footer><script>var a='<p>x</p>';</script>")
    assert D.extract(page(body)) == f"Head & line\n{LONG}\nShort.\none\ntwo\na link inside\nafter\nx y"


def test_no_article_element():
    body = f"<div id='menu'><a href='/'>home</a></div><div id='content'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class='footer'>legal</div>"
    assert D.extract(page(body)) == f"Head\n{LONG}\n{LONG}"


def test_article_split_over_sibling_blocks():
    div, text = f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", "\n".join([LONG] * 3)
    links = "<div>" + "".join(f'<a href="/{i}">link {i}</a> ' for i in range(20)) + "</div>"
    assert D.extract(page(f"<h1>Head</h1>{div}{div}")) == f"Head\n{text}\n{text}"
    assert D.extract(page(f"{NAV}{links}<h1>Head</h1>{div}<h2>More</h2>loose <a href='#'>end</a><div>short</div>{div}<p>Last.</p><div>by me</div>{links}")) == \
        f"Head\n{text}\nMore\nloose end\nshort\n{text}\nLast."
    assert D.extract(page(f"<div>{links}<h1>Head</h1>{div}{links * 9}{div}</div>")) == f"Head\n{text}\n{text}"
    assert D.extract(page(f"{NAV}<article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p><p>{LONG}</p></article>")) == "\n".join([LONG] * 4)


def test_class_words_do_not_remove_the_article():
    text = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head\n{LONG}\n{LONG}"
    for name in ("no-sidebar", "layout-with-sidebar", "has-header", "comments-open", "page widget-area", "sidebar", "legal"):
        for inner in (f"<article>{text}</article>", f"<main>{text}</main>", f"<div class='content'>{text}</div>", text):
            assert D.extract(page(f"{NAV}<div class='{name}'>{inner}</div><div class='footer'>me</div>")) == want, (name, inner)
    parts = f"<h2 class='section-header'>Part</h2><section class='legal'><p>{LONG}</p></section><section id='discussion'><h2>Talk</h2><p>{LONG}</p></section><div class='related'><p>{LONG}</p></div>"
    assert D.extract(page(f"<article>{text}{parts}<div class='related'><a href='/'>other</a></div><div class='ad'>Buy</div></article>")) == \
        f"{want}\nPart\n{LONG}\nTalk\n{LONG}\n{LONG}"
    # What is noise stays noise, long as it may be.
    comments = f"<div id='comments'>{f'<p>{LONG}</p>' * 9}</div>"
    assert D.extract(page(f"<article>{text}</article>{comments}<div class='page-header'>Site</div>")) == want
    assert D.extract(page(f"<div class='no-sidebar'><div class='content'>{text}</div><div class='sidebar'><p>{LONG}</p></div></div>")) == want


def test_lists_of_links_in_the_article():
    links = "<ol>" + "".join(f'<li><a href="/{i}">Work {i}</a></li>' for i in range(9)) + "</ol>"
    listed = "\n".join(f"Work {i}" for i in range(9))
    assert D.extract(page(f"{NAV}<article>{links}<h1>Head</h1><p>{LONG}</p>{links}<ul class='menu'><li><a href='/'>home</a></ul></article>")) == \
        f"{listed}\nHead\n{LONG}\n{listed}"
    assert D.extract(page(f"<div>{links}<h1>Head</h1><p>{LONG}</p><p>{LONG}</p><h2>References</h2>{links}</div>")) == f"Head\n{LONG}\n{LONG}\nReferences\n{listed}"


def test_broken_markup():
    assert D.extract(page(f"<article><h1>One</h1><p><b>Two<br><p>{LONG}<p>Three</article>")) == f"One\nTwo\n{LONG}\nThree"
    assert D.extract(f"<html><body>{NAV}<article><p>{LONG}") == LONG
    assert D.extract(f"<article><p>{LONG} 1 < 2 &lt; &eacute;&#233;&#x20AC;&nbsp;end") == f"{LONG} 1 < 2 < éé€ end"
    assert D.extract("<p title='a>b'>x</p><script>never closed <p>y") == "x"
    assert D.extract("just text\n  here") == "just text here"
    for odd in ("", "<", "<>", "</p>", "<p>", "<!--", "<script>", "<a", "&", "<br/>", "<div/><p>", "<" * 2000, "<b>" * 3000 + "x" + "</i>" * 3000):
        assert isinstance(D.extract(odd), str)


def test_deep_and_long_page():
    text = "\n".join(f"{LONG} {i}" for i in range(5000))
    deep = "<div>" * 500 + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</div>" * 500
    assert D.extract(page(NAV + deep)) == text


def test_pages_equal_their_articles(spark, t):
    got = {r.page_id: r for r in D.extract_pages(t.pages).collect()}
    pages = t.pages.collect()
    assert len(got) == len(pages)
    for r in pages:
        a = r.html[r.html.find("<article>") + 9:]
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:p|h1|br)>", a[:a.find("</article>")])]
        assert got[r.page_id].text == "\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", 3), (1, "u", "", "x", 3), (None, None, f"<p>{LONG}", "x", 3), (2, "u", f"<p>{LONG}", "x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(r.text for r in D.extract_pages(df).collect()) == ["", "", LONG, LONG]
    assert D.extract_pages(df.limit(0)).count() == 0


def test_broken_pages_take_linear_time():
    """Ends that match nothing, deep inline nesting, tags and quotes that never end."""
    import time

    article = "<article><p>The main text of the page stands here, and is long enough to be kept.</p></article>"
    forms = {"ends": "<b>" * 80_000 + "</i>" * 80_000, "nested": "<span>" * 80_000 + "<p>" * 80_000, "open": "<a " * 300_000, "quotes": "<a \">\"" * 140_000,
             "marks": "<!" * 400_000, "cells": "<table><tr><td>" * 60_000, "lists": "<ul><li>x" * 100_000, "blanks": "<p class" + " " * 1_000_000 + "x>y"}
    for name, form in forms.items():
        times = []
        for part in (form[:len(form) // 2], form):
            began = time.process_time()
            text = D.extract(article + part)
            times.append(time.process_time() - began)
            assert "main text of the page" in text, name
        assert times[1] < 3 * times[0] + 1 and times[1] < 12, (name, times)


def test_a_tag_that_its_quotes_never_end():
    assert D.extract("<article><p>One text</p><p title=\"broken>two</p><p>three</p></article>") == "One text\ntwo\nthree"
