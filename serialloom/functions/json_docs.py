"""JSON documents of an API: novels, chapter lists, chapters and search results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .status import status_hint
from .text import body_paragraphs, display_title, normalize_title, null_if_empty, trim_all
from .urls import MAX_NUMBER

NOVEL = "title string, status string, cover string, genres array<struct<name:string>>, authors array<struct<name:string,role:string>>"
PAGE = "items array<struct<number:double,title:string,visible:int,url:string>>, total bigint"
CHAPTER = "number double, title string, body string, locked boolean"
HITS = "array<struct<slug:string,title:string>>"


def field(x: Column) -> Column:
    """A string, trimmed; null for nothing."""
    return null_if_empty(trim_all(x))


def whole_number(n: Column) -> Column:
    """A chapter's number: finite, whole, 1 at least and within 32 bits. Others are dropped, never rounded."""
    ok = n.isNotNull() & ~F.isnan(n) & (n >= 1) & (n <= MAX_NUMBER) & (n == F.floor(n))
    return F.when(ok, n.try_cast("bigint"))


def author_name(authors: Column) -> Column:
    """The one whose role is author, or else the first; null if that one has no name."""
    chosen = F.coalesce(F.get(F.filter(authors, lambda a: a["role"] == "author"), F.lit(0)), F.get(authors, F.lit(0)))
    return field(chosen["name"])


def genre_names(genres: Column) -> Column:
    names = F.filter(F.transform(genres, lambda g: field(g["name"])), lambda n: n.isNotNull())
    return null_if_empty(F.array_join(names, ", "))


def novel_document(doc: Column) -> Column:
    d = F.from_json(doc, NOVEL)
    return F.struct(field(d["title"]).alias("title"), author_name(d["authors"]).alias("author"), field(d["cover"]).alias("cover_url"), genre_names(d["genres"]).alias("genre"), F.coalesce(status_hint(d["status"]), F.lit("unknown")).alias("status_hint"))


def chapter_page(doc: Column) -> Column:
    """struct<chapters: array<struct<number, title>>, total>; the total is the list's length where it is missing."""
    d = F.from_json(doc, PAGE)
    good = F.filter(d["items"], lambda i: whole_number(i["number"]).isNotNull())
    rows = F.transform(good, lambda i: F.struct(whole_number(i["number"]).alias("number"), display_title(i["title"], whole_number(i["number"])).alias("title")))
    return F.struct(F.coalesce(rows, F.array().cast("array<struct<number:bigint,title:string>>")).alias("chapters"), F.coalesce(d["total"], F.size(d["items"]).cast("bigint"), F.lit(0)).alias("total"))


def chapter_document(doc: Column, number: Column) -> Column:
    """struct<outcome, number, title, paragraphs, message>. A locked chapter may open later; one without a body is an error too."""
    d = F.from_json(doc, CHAPTER)
    n = F.coalesce(whole_number(d["number"]), number)
    body = body_paragraphs(d["body"])
    bad = F.when(d.isNull(), "not a document").when(F.coalesce(d["locked"], F.lit(False)), "locked").when(d["body"].isNull() | (F.size(body) == 0), "no body")
    return F.struct(F.when(bad.isNull(), "ok").otherwise("error").alias("outcome"), n.alias("number"), display_title(d["title"], n).alias("title"), F.when(bad.isNull(), body).alias("paragraphs"), bad.alias("message"))


def search_hits(doc: Column) -> Column:
    """A bare array, or the items of an envelope."""
    return F.when(F.startswith(F.ltrim(doc), F.lit("[")), F.from_json(doc, HITS)).otherwise(F.from_json(doc, f"items {HITS}")["items"])


def slug_by_title(doc: Column, title: Column) -> Column:
    """The first hit whose title is the same but for case and punctuation."""
    same = F.filter(search_hits(doc), lambda h: normalize_title(h["title"]) == normalize_title(title))
    return F.get(same, F.lit(0))["slug"]


def visible_entries(array: Column) -> Column:
    """Entries of an embedded list that are not hidden."""
    rows = F.from_json(array, "array<struct<title:string,url:string,visible:int>>")
    return F.filter(rows, lambda r: F.coalesce(r["visible"], F.lit(1)) != 0)
