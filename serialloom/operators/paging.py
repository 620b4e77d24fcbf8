"""Paged lists: which pages a reader would have asked for, as rules over pages that are there.

A reader of a paged list stops by what it has seen so far. Over all novels at
once that is a prefix of each novel's pages, found without a loop: what is new on
a page are the numbers whose first page it is, and what has been seen by a page
is a running count over *pages*, which are few, never over their links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import with_page
from ..functions.text import clean_chapter_title
from ..functions.urls import chapter_number, resolve


def _in_a_row(pages: DataFrame) -> DataFrame:
    """pages 1, 2, ... of each novel up to the first that is not there."""
    w = Window.partitionBy("novel_id").orderBy("page")
    return pages.withColumn("__at", F.row_number().over(w)).filter(F.col("page") == F.col("__at")).drop("__at")


def _until_stop(pages: DataFrame, stop: Column) -> DataFrame:
    """pages up to and with the first for which ``stop`` holds."""
    before = Window.partitionBy("novel_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("__stop", F.coalesce(stop, F.lit(False))).withColumn("__past", F.coalesce(F.bool_or("__stop").over(before), F.lit(False))).filter("NOT __past").drop("__past", "__stop")


def paged_scan(links: DataFrame, max_pages: int = 500, needed: int | None = None) -> DataFrame:
    """The links that a walk over a list's pages keeps: novel_id, number, and page, pos, title, url of the first place of each number.

    links: novel_id, page (from 1), pos, number, title, url. The walk ends
    before a page without links (or one that is not there), and with a page
    that brings no new number, one by which ``needed`` numbers are in hand, or
    the last that is allowed.
    """
    # within a prefix of pages, a number is new where it comes first at all
    first = links.groupBy("novel_id", "number").agg(F.min(F.struct("page", "pos", "title", "url")).alias("f")).select("novel_id", "number", "f.*")
    news = first.groupBy("novel_id", "page").agg(F.count("*").alias("new"))
    pages = links.select("novel_id", "page").distinct().join(news, ["novel_id", "page"], "left").na.fill(0, ["new"])
    so_far = F.sum("new").over(Window.partitionBy("novel_id").orderBy("page"))
    pages = _in_a_row(pages).withColumn("seen", so_far)
    stop = (F.col("new") == 0) | (F.col("page") >= max_pages)
    if needed is not None:
        stop = stop | (F.col("seen") >= needed)
    last = _until_stop(pages, stop).groupBy("novel_id").agg(F.max("page").alias("last"))
    return first.join(last, "novel_id").filter(F.col("page") <= F.col("last")).select("novel_id", "number", "page", "pos", "title", "url")


def newest_first(links: DataFrame, totals: DataFrame, max_pages: int = 1000) -> DataFrame:
    """Links of lists that begin with the newest, numbered from the oldest: links of the pages that are asked for, with number.

    links: novel_id, page (from 1), pos and more; totals: novel_id and total,
    null or 0 where it is not known. The first page sets the size of a page.
    The reader ends before a page without links, and with one that is short, by
    which the total is in hand, or that is the last allowed. A page past the
    total is never asked for.
    """
    sizes = links.groupBy("novel_id", "page").agg(F.count("*").alias("size"))
    known = totals.select("novel_id", F.coalesce("total", F.lit(0)).alias("total"))
    upto = Window.partitionBy("novel_id").orderBy("page")
    pages = _in_a_row(sizes).join(known, "novel_id", "left").na.fill(0, ["total"])
    pages = pages.withColumn("through", F.sum("size").over(upto)).withColumn("page_size", F.first("size").over(upto))
    stop = ((F.col("total") > 0) & (F.col("through") >= F.col("total"))) | (F.col("size") < F.col("page_size")) | (F.col("page") >= max_pages)
    asked = _until_stop(pages, stop)
    count = asked.groupBy("novel_id").agg(F.max("through").alias("__count"))
    asked = asked.join(count, "novel_id").select("novel_id", "page", (F.col("through") - F.col("size")).alias("__before"), "__count")
    # a link's place is that of its page and that in its page
    place = F.row_number().over(Window.partitionBy("novel_id", "page").orderBy("pos"))
    met = links.withColumn("__place", place).join(asked, ["novel_id", "page"])
    return met.withColumn("number", (F.col("__count") - F.col("__before") - F.col("__place") + 1).cast("bigint")).drop("__place", "__before", "__count")


def newest_window(links: DataFrame, totals: DataFrame) -> DataFrame:
    """The first page alone, numbered so that it ends at the total; from 1 where the total is less than the page, or not known."""
    page = links.filter("page = 1")
    size = page.groupBy("novel_id").agg(F.count("*").alias("__size"))
    met = page.withColumn("__place", F.row_number().over(Window.partitionBy("novel_id").orderBy("pos"))).join(size, "novel_id").join(totals.select("novel_id", F.coalesce("total", F.lit(0)).alias("__total")), "novel_id", "left")
    start = F.greatest(F.coalesce("__total", F.lit(0)) - F.col("__size") + 1, F.lit(1))
    return met.withColumn("number", (start + F.col("__size") - F.col("__place")).cast("bigint")).drop("__place", "__size", "__total")


def arrived(entries: DataFrame) -> DataFrame:
    """One row for each novel and number of an API's list: the one that arrived first (offset, pos)."""
    others = [c for c in entries.columns if c not in ("novel_id", "number")]
    return entries.groupBy("novel_id", "number").agg(F.min_by(F.struct(*others), F.struct("offset", "pos")).alias("f")).select("novel_id", "number", "f.*")


def listed_chapters(pages: DataFrame, needed: int | None = None) -> DataFrame:
    """novel_id, number, title and url of the chapters that a walk over a site's pages of contents finds.

    pages: novel_id, page (from 1), url (the novel's), html, and from its profile chapter_marker and max_pages.
    """
    read = with_page(pages.filter("chapter_marker IS NOT NULL").withColumnRenamed("page", "at"), fields=("links",))
    links = read.select("novel_id", F.col("at").alias("page"), "url", "chapter_marker", "max_pages", F.posexplode("page.links").alias("pos", "link")).filter(F.contains("link.href", F.col("chapter_marker")))
    links = links.withColumn("link_url", resolve(F.col("url"), F.col("link.href")))
    links = links.select("novel_id", "page", "pos", "max_pages", chapter_number(F.col("link_url")).alias("number"), clean_chapter_title(F.col("link.text")).alias("title"), F.col("link_url").alias("url")).filter("number IS NOT NULL")
    # a page beyond the profile's last is one that is not there
    near = links.filter(F.col("page") <= F.coalesce("max_pages", F.lit(500)))
    return paged_scan(near, needed=needed, max_pages=1 << 31).select("novel_id", "number", "title", "url")
