from __future__ import annotations

import html
import re
import time

from pyspark.sql import functions as F

from vellum.llm import html_text, queries

LONG = "Words of the story go on and on, with commas, for quite a while before they end. "


def test_articles_of_the_table_come_out_whole(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op8_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id].html
        inner = page[page.index("<article>") :].partition("</article>")[0]
        want = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert r.text == " ".join(html.unescape(want).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_articles_come_out_whole_without_their_tag(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") :].partition("</article>")[0]
        want = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert html_text.extract(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == " ".join(html.unescape(want).split())


def test_class_words_do_not_remove_the_core():
    story = f"<div class='share-story'><p>{LONG * 3}</p><p>{LONG * 3}</p></div>"
    want = " ".join((LONG * 6).split())
    assert html_text.extract(f"<article>{story}</article>") == want
    assert html_text.extract(f"<body><nav>a b c</nav>{story}<div class=ad>Buy this now, or later, at a fair price.</div></body>") == want
    assert html_text.extract(f"<body><div id=related-post class=widget><div class=body>{LONG * 6}</div><div class=share>Share it</div></div><footer>x</footer></body>") == want
    plain = f"<div><h1>T</h1><p>{LONG * 6}</p><p>{LONG}</p></div>"
    assert html_text.extract(f"<body>{plain}{story}</body>") == " ".join(f"T {LONG * 7}".split())
    assert html_text.extract(f"<body><section class=comments><p>{LONG * 9}</p></section>{plain}</body>") == " ".join(f"T {LONG * 7}".split())


def test_no_markup_in_the_text():
    assert html_text.extract("<p class=it's>one</p><p x=\"a>b\">two</p><p y='>' z=a'b>three<br/>four</p><a href=x/>five</a>") == "one two three four five"
    assert html_text.extract("<p>one</p><p class='open>two</p>") == "one two"
    assert html_text.extract("<p>one</p><p class") == html_text.extract("<p>one</p><!-- two") == html_text.extract("<p>one</p><!doc") == "one"


def test_broken_pages_take_linear_time():
    million = 10**6
    pages = ["<a " * million, "<p x='" * million, '<p x="' * million, "<" * million, "<!" * million, "<!--" * million, "</p" * million, "<a =" * million + ">", "<p><table>" + "<b>" * 200_000 + "<h1></h1>" * 100_000, "<b>" * 200_000 + "</i>" * 200_000]
    pages += ["<div class=ad>" * 100_000 + LONG * 9, "<li>" * 200_000 + LONG, "<style>" * 200_000, "<b x" + "=" * million]
    for page in pages:
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 8, page[:12]


def test_boilerplate_goes_without_article_marks():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) "<p>no</p>";</script></head><body>
      <div class="site-header">Top</div><div id="cookie-notice">We use cookies.</div><ul class="nav"><li><a href=x>One</a><li><a href=y>Two</a></ul>
      <div class="content"><h2>Head &amp; shoulders</h2><p>{LONG * 3}<p>A <b>bold</b>word &#x41;&eacute;.<br>Next<div>{LONG}</div><form><input><p>Form</p></form><table><tr><td>c1<td>c2</table></div>
      <aside>Side</aside><section id="comments"><p>{LONG}</p></section><div class="ad">Buy</div><footer><p>Foot</p></footer></body>"""
    got = html_text.extract(page)
    assert got == " ".join(f"Head & shoulders {LONG * 3}A boldword Aé. Next {LONG} c1 c2".split())


def test_wrappers_and_comments():
    page = f"""<body class="has-sidebar"><div class="page with-sidebar header-wrap"><div class="siteHeader">Top</div><main><article><h1>T</h1><p>{LONG}</p><div class="share-buttons">Share</div>
      <section class="reader-comments"><article><p>{LONG}</p></article></section></article></main><div class="sidebar"><p>{LONG}</p></div></div></body>"""
    assert html_text.extract(page) == f"T {LONG.strip()}"
    assert html_text.extract(f'<div class="no-comments"><p>{LONG}</p></div>') == LONG.strip()


def test_broken_and_empty_pages():
    assert html_text.extract("") == html_text.extract("<html><body></body>") == html_text.extract("<script>x") == ""
    assert html_text.extract("just text &lt;b&gt;") == "just text <b>"
    assert html_text.extract("<p>a<p>b</div></p>c") == "a b c"
    assert html_text.extract("<article>a <!-- b --> c <![CDATA[d]]></article>") == "a c"
    assert html_text.extract("<article><a href='>'>x</a> < 3 & y</article>") == "x < 3 & y"
    deep = "<div>" * 30_000 + LONG + "</div>" * 30_000
    assert html_text.extract(deep) == LONG.strip()
    assert html_text.extract("<div class=ad>" * 30_000 + LONG) == "" and html_text.extract("<div class=ad>" * 30_000 + f"<main>{LONG}") == LONG.strip()
    assert html_text.extract("<" * 50_000) == "<" * 50_000
    assert len(html_text.extract("<article>" + "<p>w</p>" * 100_000)) == 199_999


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, "v", "<p>x\n y</p>"), (None, "w", "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = html_text.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in rows) == [(0, "w", "x", 1), (1, "u", "", 0), (2, "", "", 0), (2, "v", "x y", 3)]
    assert html_text.main_text(pages.limit(0)).collect() == []
