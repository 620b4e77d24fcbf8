import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serialloom.functions import status, text, urls

T = st.text(alphabet="aZ09 -:|–—.é陷 \n", max_size=12)


def test_normalize_title(col):
    assert col(text.normalize_title, ["Harbour Lights", "harbour-lights", "Nine Bells: X!", "长夜灯火", None]) == ["harbourlights", "harbourlights", "ninebellsx", "长夜灯火", None]


def test_sanitize_filename(col):
    given_ = ["Sea/Fog:Bell?1", "Low Water. ", "CON", "nul.epub", "   ", "???", "com1.x", "ok"]
    assert col(text.sanitize_filename, given_) == ["Sea_Fog_Bell_1", "Low Water", "_CON", "_nul.epub", "untitled", "untitled", "_com1.x", "ok"]


def test_clean_chapter_title(col):
    given_ = ["Chapter 1 - Low Tide", "Chapter 38: Two Lanterns", "Chapter 3 – Dash", "Chapter 5", "Prologue", "Chapter 15", "Chapter 9 -", "潮水与灯塔", "Chapter 77 Ropes", "Chapter12x"]
    assert col(text.clean_chapter_title, given_) == ["Low Tide", "Two Lanterns", "Dash", "Chapter 5", "Prologue", "Chapter 15", "Chapter 9 -", "潮水与灯塔", "Ropes", "x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["Chapter", "chapter", "CHAPTER"]), st.integers(0, 9999), st.sampled_from([" ", "  ", ""]), st.sampled_from(["-", ":", "|", "–", "—", ""]), st.from_regex(r"[A-Za-zé陷]{1,6}( [a-z]{1,5})?", fullmatch=True)), min_size=20, max_size=40))
def test_clean_chapter_title_leaves_the_name(col, parts):
    """Mark, number, spaces and one separator go, the name stays; a name that has no mark stays whole."""
    marked = [f"{mark} {n}{space}{sep} {name}" for mark, n, space, sep, name in parts]
    names = [p[-1] for p in parts]
    assert col(text.clean_chapter_title, marked) == names
    assert col(text.clean_chapter_title, [f" Part {n} " for n in names]) == [f"Part {n}" for n in names]


def test_site_titles(col):
    assert col(text.strip_chapter_mark, ["Chapter 208. Salt in the wind", "Chapter Foo", "12 - x", "Title"]) == ["Salt in the wind", "Foo", "x", "Title"]
    assert col(lambda c: text.strip_number_colon(text.clean_chapter_title(c)), ["Chapter 1 - 1: Fog Bell"]) == ["Fog Bell"]
    assert col(text.strip_site_suffix, ["A | Free Web Novel", "A | B"]) == ["A", "A | B"]
    assert col(text.page_chapter_title, ["Book - Chapter 7: A Lamp on the Pier | Free Web Novel", "Book - Chapter 5"]) == ["A Lamp on the Pier", "Chapter 5"]
    assert col(lambda c: text.display_title(c, F.lit(8)), ["Chapter 7", None]) == ["Chapter 7", "Chapter 8"]
    assert col(text.strip_number_mark, ["12. Foo", "12.", "x"]) == ["Foo", "12.", "x"]


def test_counts_and_authors(col):
    assert col(text.count_in_tail, ["A - B - 742 chapters", "none"]) == [742, None]
    assert col(text.digits_only, ["(2,046)", ""]) == [2046, None]
    assert col(text.after_colon, ["Author: Ann", "Bo"]) == ["Ann", "Bo"]
    assert col(text.real_cover, ["x/noimagefound.jpg", "y.jpg"]) == [None, "y.jpg"]


def test_gate_stubs(col):
    long = "prose " * 400 + "log in to continue"
    assert col(text.is_gate_stub, ["This chapter requires a FREE account", "A short note.", long, None]) == [True, False, False, False]


def test_markup_and_paragraphs(col):
    assert col(text.strip_inline_markup, ["<em>a</em> < b <notatag> <br/>c"]) == ["a < b <notatag> c"]
    assert col(text.body_paragraphs, ["one\n\n <i>two</i> \n「こ」"]) == [["one", "two", "「こ」"]]
    assert col(text.xml_escape, ["a & <b>"]) == ["a &amp; &lt;b&gt;"]
    assert col(text.cover_filename, ["image/png; q=1", "text/html", "image/jpeg"]) == ["cover.png", None, "cover.jpg"]


def test_listed_numbers(spark):
    df = spark.createDataFrame([([3, 1, 2],), (list(range(1, 21)),)], "n array<bigint>").select(text.listed_numbers(F.col("n")).alias("t"))
    assert [r.t for r in df.collect()] == ["1, 2, 3", ", ".join(map(str, range(1, 16))) + ", … (+5 more)"]


def test_urls(col):
    assert col(urls.chapter_number, ["/novel/chapter-38-a.html", "chapter-1", "/about", "/chapter-house/chapter-12", "/chapter-99999999999"]) == [38, 1, None, None, None]
    assert col(urls.slug, ["https://x.org/novel/harbour-lights/chapter-1", "https://x.org/other/a", "not a url"]) == ["harbour-lights", None, None]
    assert col(urls.base_url, ["https://x.org/a/?q=1#z", "https://x.org/a//"]) == ["https://x.org/a", "https://x.org/a"]
    assert col(lambda c: urls.on_host(c, "x.org"), ["https://www.X.org/a", "https://x.org", "https://x.org.evil", "not a url"]) == [True, True, False, False]
    assert col(lambda c: urls.resolve(F.lit("https://x.org/a/b"), c), ["../c", "https://y.org/", None]) == ["https://x.org/c", "https://y.org/", None]


def test_paths(col):
    assert col(lambda c: urls.book_path(F.lit(None).cast("string"), c), ["N"]) == ["Unknown Author/N/N.epub"]
    assert col(lambda c: urls.book_path(F.lit("A/B"), c, F.lit(2)), ["Harbour: Night?"]) == ["A_B/Harbour_ Night_/Harbour_ Night_ - Vol 02.epub"]


def test_status(col):
    assert col(status.status_hint, ["releasing", " Ongoing ", "completed", "hiatus", "cancelled", "dropped", ""]) == ["ongoing", "ongoing", "completed", "unknown", "unknown", "unknown", "unknown"]
    assert col(status.parse_state, ["live", "x"]) == ["live", "backfilling"]
    assert col(status.outcome, [404, 410, 200, 503], "int") == ["not_found", "not_found", "ok", "error"]
    assert col(status.is_retryable, [429, 404], "int") == [True, False]
    assert col(status.retry_after, ["30", " 5 ", "Wed, 21 Oct"]) == [30, 5, None]
    assert col(lambda c: status.backoff_ms(c, 1000, 30_000), [0, 1, 2, 9], "int") == [2000, 4000, 8000, 30_000]


def test_delays(spark):
    df = spark.createDataFrame([([False, False, True],)], "o array<boolean>").select(status.next_delays(F.col("o"), 1000, 3000).alias("d"))
    assert df.first().d == pytest.approx([2000, 3000, 2550])
