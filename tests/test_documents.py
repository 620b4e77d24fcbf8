"""HTML and JSON."""

import pytest
from pyspark.sql import functions as F

from serialloom.functions import html, json_docs

CHAPTER = """<html><head><title>T &amp; U</title><style>.k9 { display: none } .loud { color: red }</style><script>var a="</p>";</script></head><body>
<p>above</p><div id="c"><p>The tide was out.<p class="k9">read this elsewhere</p><section class="promo"><span>buy a boat</span></section><p>Nobody <i>else</i> came.</p><p>  </p></div><p>below</p></body></html>"""
NOVEL = """<html><head><meta property="og:novel:novel_name" content="Test Novel"><meta property="og:novel:author" content="Ann"><meta property="og:novel:status" content="Ongoing"><meta name="d" content="e"></head>
<body><a href="/n/chapter-1.html">Chapter 1 - One</a><a href="/n/chapter-2.html">Chapter 2: Two</a><a href="/n/chapter-1.html">Chapter 1 - One</a><a href="/about">About</a><input name="mypostid" value=" 77 "></body></html>"""


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(1, "https://x.org/b/", CHAPTER), (2, "https://x.org/b/", NOVEL), (3, "https://x.org", None), (4, "u", "")], "id int, url string, html string")


def test_paragraphs_of_a_container(pages):
    got = html.with_page(pages, "#c").select("id", html.paragraphs(F.col("page")).alias("p"), html.visible_paragraphs(F.col("page")).alias("v")).orderBy("id").collect()
    assert got[0].p == ["The tide was out.", "read this elsewhere", "Nobody else came."]
    assert got[0].v == ["The tide was out.", "Nobody else came."]
    assert [r.p for r in got[1:]] == [None, None, None]


def test_metadata_and_titles(pages):
    got = html.with_page(pages).select("id", html.page_meta(F.col("page")).alias("m"), html.hidden_input(F.col("page"), "mypostid").alias("i")).orderBy("id").collect()
    assert got[0].m.title == "T & U" and got[0].m.status_hint == "unknown"
    assert (got[1].m.title, got[1].m.author, got[1].m.status_hint, got[1].i) == ("Test Novel", "Ann", "ongoing", "77")
    assert got[2].m.title is None


def test_links(pages):
    got = html.chapter_links(html.with_page(pages), "chapter-").orderBy("id", "pos").select("number", "title", "link_url").collect()
    assert [(r.number, r.title) for r in got] == [(1, "One"), (2, "Two"), (1, "One")]
    assert got[0].link_url == "https://x.org/n/chapter-1.html"


def test_a_filter_on_a_page_does_not_parse_it_twice(pages):
    df = html.with_page(pages).filter(F.col("page.title").isNotNull()).select("page.title")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_novel_document(col):
    doc = '{"title":" T ","status":"completed","cover":"","genres":[{"name":"Sea"},{"name":" "},{"name":"Mystery"}],"authors":[{"name":"Bo","role":"editor"},{"name":"Mara Lind","role":"author"}]}'
    r = col(json_docs.novel_document, [doc])[0]
    assert (r.title, r.author, r.cover_url, r.genre, r.status_hint) == ("T", "Mara Lind", None, "Sea, Mystery", "completed")


def test_fractional_numbers_are_dropped(col):
    doc = '{"items":[{"number":12,"title":"a"},{"number":12.5,"title":"b"},{"number":13,"title":null},{"number":0}]}'
    r = col(json_docs.chapter_page, [doc])[0]
    assert [c.number for c in r.chapters] == [12, 13] and r.total == 4 and r.chapters[1].title == "Chapter 13"


def test_chapter_documents(col):
    docs = ['{"number":3,"title":"Chapter 3: X","body":"<em>a</em>\\n\\nb"}', '{"locked":true,"body":"x"}', '{"title":"t"}', "no json"]
    got = col(lambda c: json_docs.chapter_document(c, F.lit(9).cast("bigint")), docs)
    assert (got[0].outcome, got[0].number, got[0].title, got[0].paragraphs) == ("ok", 3, "X", ["a", "b"])
    assert [g.outcome for g in got[1:]] == ["error"] * 3 and got[1].message == "locked" and got[2].number == 9


def test_search(col):
    bare = '[{"slug":"other","title":"Harbour Light"},{"slug":"harbour-lights","title":"Harbour  Lights!"}]'
    assert col(lambda c: json_docs.slug_by_title(c, F.lit("harbour lights")), [bare, '{"items":' + bare + "}", "[]"]) == ["harbour-lights", "harbour-lights", None]


def test_embedded_list(col):
    page = '<script>window.chapters = [{"title":"a","url":"/1"},{"title":"b","url":"/2","visible":0},{"title":"c","url":"/3","visible":1}]; window.x = 1;</script>'
    got = col(lambda c: json_docs.visible_entries(html.embedded_json(c)), [page])[0]
    assert [r.title for r in got] == ["a", "c"]
