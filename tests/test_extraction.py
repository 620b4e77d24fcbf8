"""Selectors, hidden classes, embedded lists and site profiles."""

import random

import pytest
from pyspark.sql import functions as F

from serialloom.functions import extraction, html, json_docs
from serialloom.functions.tree import Tree, compiled

PAGE = """<html lang="en"><body><div id="a" class="x y"><p>one<p class="k">two <b>bold</b><ul><li>l1<li>l2</ul></div>
<section class="x"><div><p data-n="5">three</p></div><a href="/profile/7" rel="nofollow me">Ann</a></section><script>p { "</p>" }</script></body></html>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("p", ["one", "two bold", "three"]),
        ("#a p", ["one", "two bold"]),
        (".x.y > p.k", ["two bold"]),
        ("section > p", []),
        ("section p, li", ["l1", "l2", "three"]),
        ("[data-n]", ["three"]),
        ("p[data-n='5']", ["three"]),
        ('a[href^="/profile/"]', ["Ann"]),
        ("a[href*=file][rel~=me]", ["Ann"]),
        ("a[href$='/7']", ["Ann"]),
        ("a[href^='']", []),
        ("html body .x > div > *", ["three"]),
        ("div div p", []),
    ],
)
def test_selectors(selector, texts):
    tree = Tree(PAGE)
    assert [tree.text(i) for i in tree.select(selector)] == texts


@pytest.mark.parametrize("bad", ["", "p >", "> p", "p,", "p:first-child", "p + a", "a > > b", ".x p[", "#a*"])
def test_selectors_that_are_not_understood(bad):
    with pytest.raises(ValueError, match="selector"):
        compiled(bad)


def test_a_descendant_is_found_at_any_depth():
    """Against a plain search over all chains of ancestors."""
    rng = random.Random(1)
    for _ in range(60):
        text, depth = "", 0
        for _ in range(30):
            if depth and rng.random() < 0.45:
                text += "</div>"
                depth -= 1
            else:
                text += f'<div class="{rng.choice("abc")}">'
                depth += 1
        tree = Tree(text)
        cls = [a["class"] for a in tree.attrs]

        def chain(i, tree=tree):
            return [] if tree.parent[i] < 0 else [*chain(tree.parent[i]), tree.parent[i]]

        want = [i for i in range(len(cls)) if cls[i] == "c" and any(cls[k] == "b" and tree.parent[k] >= 0 and cls[tree.parent[k]] == "a" for k in chain(i))]
        assert list(tree.select(".a > .b .c")) == want
        assert all(tree.ends[i] == max([j for j in range(len(cls)) if i in [*chain(j), j]]) + 1 for i in range(len(cls)))


STYLE = ".a1, .b2 { display: none } .c3 p{display:none}\n.loud{color:red} @media x { .d4 , p.q { display : none } }"


def test_classes_of_grouped_and_nested_rules_are_hidden(spark, col):
    want = {"a1", "b2", "c3", "d4"}
    assert set(col(html.hidden_classes, [STYLE])[0]) == want == Tree(f"<style>{STYLE}</style>").hidden()
    page = f'<style>{STYLE}</style><div class="chapter-inner"><p>real</p><p class="a1">decoy</p><p class="x b2">decoy</p><p class="c3">decoy</p><p class="loud">loud</p></div>'
    read = html.with_page(spark.createDataFrame([(page,)], "html string"), ".chapter-inner", fields=("paragraphs", "style"))
    assert read.select(html.visible_paragraphs(F.col("page")).alias("p")).first().p == ["real", "loud"]


def test_the_first_json_value_of_a_script(col):
    pages = [
        '<script>window.chapters = [{"title":"a];b","url":"/1"},{"title":"q\\"]","url":"/2"}]; window.more = [1];</script>',
        '<script>window.chapters=[{"title":"no semicolon","url":"/1"}]</script><p>[1]',
        "<script>window.chapters = [];</script>",
        "<p>[1]</p>",
        '<script>window.chapters = [{"title":',
    ]
    got = col(lambda c: json_docs.visible_entries(html.embedded_json(c)), pages)
    assert [g if g is None else [r.title for r in g] for g in got] == [["a];b", 'q"]'], ["no semicolon"], [], None, None]


LABELLED = """<html><head><meta property="og:title" content=" Tide Tables "><meta name="twitter:creator" content="Ann Lind"><meta property="og:image" content="https://i/x.png"><title>no | site</title></head>
<body><span class="label">Fantasy</span><span class="label"> Ongoing </span><span class="label">completed</span></body></html>"""
LABELLED_BARE = """<html><head><title>Tide | Tables | A Site</title></head><body><h1>other</h1><a href="/profile/1">Bo</a><span class="label">hiatus</span></body></html>"""
LABELLED_EMPTY = """<meta property="og:title" content=""><title>Tide | Site</title>"""
CHAPTER = """<style>.z9,.z8{display:none}</style><div class="chapter-inner"><p>It rained.<p class="z8">stolen</p><div><p> All day. </p></div><p> </p></div><p>below</p>"""
SERIES = """<meta property="og:title" content="Salt"><meta property="og:image" content="/img/noimagefound.jpg"><a href="https://x/profile/9/">Cy</a><span class="rnd_stats">Completed</span><input type="hidden" id="mypostid" value=" 42 "><span class="cnt_toc">(1,205)</span>"""
BADGE = """<meta property="og:title" content="Brine by Dee - 310 Chapters"><h1 class="novel-title"> Brine </h1><p class="novel-author">Author: <a>Dee</a></p><b class="status-badge">Active</b><h1 class="chapter-title">Chapter 12 - 12: Low Water</h1>"""
COUNTED = """<meta property="og:novel:novel_name" content="Kelp"><meta property="og:title" content="x"><meta property="og:novel:status" content="2"><meta property="og:novel:genre" content="Sea, Fog"><div data-total-chapters=" 77 "></div>"""
NOT_COUNTED = """<title>Reef</title><div data-total-chapters="many"></div><div class="txt"><p>a</p></div>"""


def test_site_variants_from_rows(spark):
    pages = [
        (1, "https://www.royalroad.com/fiction/1", LABELLED), (2, "https://royalroad.com/fiction/2", LABELLED_BARE), (3, "https://royalroad.com/fiction/3", LABELLED_EMPTY), (4, "https://royalroad.com/c/4", CHAPTER),
        (5, "https://www.scribblehub.com/series/5", SERIES), (6, "https://LightNovelWorld.org/novel/6", BADGE), (7, "https://freewebnovel.com/novel/7", COUNTED), (8, "https://freewebnovel.com/novel/8", NOT_COUNTED),
        (9, "https://my.site/9", COUNTED), (10, "https://www.novgo.net/10", COUNTED), (11, "https://royalroad.com/11", None), (12, "no url", COUNTED), (13, "https://novgo.net/13", ""),
    ]
    df = spark.createDataFrame([(*p, "own") for p in pages], "id int, url string, html string, host string")
    more = spark.createDataFrame([(1, "mine", "MY.site", False, "/c-", None, None), (2, "late", "royalroad.com", False, None, None, None)], extraction.PROFILES)
    rules = extraction.site_rules(spark, *extraction.general_rules("mine"))
    got = {r.id: r for r in extraction.extract(extraction.with_profile(df, extraction.site_profiles(spark, more)), rules).collect()}
    assert [got[i].profile for i in sorted(got)] == ["royalroad"] * 4 + ["scribblehub", "lightnovelworld", "freewebnovel", "freewebnovel", "mine", None, "royalroad", None, "novgo"]
    show = lambda i, *names: tuple(got[i][n] for n in names)
    five = ("title", "author", "cover_url", "genre", "status_hint")
    assert show(1, *five) == ("Tide Tables", "Ann Lind", "https://i/x.png", None, "ongoing")
    assert show(2, *five) == ("Tide | Tables", "Bo", None, None, "unknown")
    assert show(3, *five) == (None, None, None, None, "unknown")  # an empty tag decides
    assert show(4, "body") == (["It rained.", "All day."],)
    assert show(5, *five, "post_id", "total") == ("Salt", "Cy", None, None, "completed", "42", 1205)
    assert show(6, *five, "chapter_title", "total") == ("Brine", "Dee", None, None, "ongoing", "Low Water", 310)
    assert show(7, *five, "total") == ("Kelp", None, None, "Sea, Fog", "completed", 77)
    assert show(8, "title", "total", "body") == ("Reef", None, ["a"])
    assert show(9, "title", "status_hint", "total") == ("Kelp", "completed", None)
    for i in (10, 11, 12, 13):
        assert show(i, *five, "body") == (None, None, None, None, "unknown", None)


def test_rules_are_checked_when_they_are_made():
    with pytest.raises(ValueError, match="selector"):
        extraction.rule("p", "title", "h1:hover")
    with pytest.raises(ValueError, match="cleaning"):
        extraction.rule("p", "title", "h1", clean="shout")


def test_a_page_is_read_once_and_only_for_what_is_asked(spark):
    df = spark.createDataFrame([(1, "https://novgo.net/1", COUNTED)], "id int, url string, html string")
    out = extraction.extract(extraction.with_profile(df, extraction.site_profiles(spark)), extraction.site_rules(spark)).filter("title IS NOT NULL").select("title", "genre")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert html.with_page(df, fields=("title",)).select("page.*").columns == ["title"]


def test_many_hosts_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, "https://novgo.net/1")], "id int, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = extraction.with_profile(df, extraction.site_profiles(spark), most=3)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.first().profile == "novgo"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sites_from_files_and_their_contents(spark, tmp_path):
    from serialloom.operators.paging import listed_chapters
    from serialloom.sources import config

    (tmp_path / "a.ini").write_text("[site]\nname = mine\nhost = My.site\nchapter_marker = /c/chapter-\ncontent_selector = main .prose\nmax_toc_pages = 2\n")
    (tmp_path / "b.ini").write_text("[site]\nname = bad\nhost = bad.site\nchapter_marker = x\ncontent_selector = p:hover\n")
    with pytest.warns(UserWarning, match="bad"):
        profiles, rules = extraction.from_files(config.profiles(spark, str(tmp_path)))
    toc = lambda *numbers: "".join(f'<a href="/c/chapter-{n}">Chapter {n}: T{n}</a>' for n in numbers) + '<a href="/about">x</a><a href="/c/chapter-x">y</a>'
    pages = [(1, 1, "https://my.site/b", toc(1, 2)), (1, 2, "https://my.site/b", toc(2, 3)), (1, 3, "https://my.site/b", toc(4)), (2, 1, "https://my.site/d", toc()), (3, 1, "https://other.site/", toc(1)), (4, 1, "https://novgo.net/e", '<a href="chapter-5">no slash</a><a href="/e/chapter-9">Chapter 9</a>')]
    df = extraction.with_profile(spark.createDataFrame(pages, "novel_id bigint, page bigint, url string, html string"), extraction.site_profiles(spark, profiles))
    got = sorted((r.novel_id, r.number, r.title, r.url) for r in listed_chapters(df).collect())
    assert got == [(1, n, f"T{n}", f"https://my.site/c/chapter-{n}") for n in (1, 2, 3)] + [(4, 9, "Chapter 9", "https://novgo.net/e/chapter-9")]
    chapter = spark.createDataFrame([("https://my.site/c/1", "<title>T</title><main><div class='prose'><p>a<p> b</div></main><p>c")], "url string, html string")
    row = extraction.extract(extraction.with_profile(chapter, profiles), rules).first()
    assert (row.title, row.body) == ("T", ["a", "b"])
