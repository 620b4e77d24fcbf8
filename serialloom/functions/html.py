"""HTML to typed columns. One Arrow function reads a page once and returns what later steps ask for.

Pages are read by the standard library's parser into a tree (see :mod:`.tree`),
with the recovery that pages need: a paragraph ends where the next block begins,
void tags have no content, script and style are raw text and not part of any
text. What is where on a site's pages is data: see :mod:`.extraction`.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .status import status_hint
from .text import clean_chapter_title, null_if_empty, trim_all
from .tree import Tree, compiled
from .urls import chapter_number, resolve

#: What a page can be asked for.
FIELDS = {
    "title": "string",
    "h1": "string",
    "meta": "map<string,string>",
    "names": "map<string,string>",
    "links": "array<struct<href:string,text:string,classes:string>>",
    "paragraphs": "array<struct<text:string,classes:array<string>>>",
    "inputs": "map<string,string>",
    "style": "string",
}


def _first_text(tree: Tree, selector: str) -> str | None:
    return next((tree.text(i) for i in tree.select(selector)), None)


def _named(tree: Tree, selector: str, key: str, value: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for i in tree.select(selector):
        found.setdefault(tree.attrs[i][key], tree.attrs[i].get(value, ""))
    return found


def _paragraphs(tree: Tree, container: str | None, paragraph: str) -> list[dict]:
    within = None
    if container:
        within = next(tree.select(container), None)
        if within is None:
            return []
    return [{"text": tree.text(i), "classes": tree.attrs[i].get("class", "").split()} for i in tree.select(paragraph, within)]


def read_page(html: str, container: str | None = None, paragraph: str = "p", fields: Iterable[str] = tuple(FIELDS)) -> dict:
    """container, paragraph: selectors; paragraphs are those in the first container, or all."""
    tree = Tree(html)
    how = {
        "title": lambda: _first_text(tree, "title"),
        "h1": lambda: _first_text(tree, "h1"),
        "meta": lambda: _named(tree, "meta[property]", "property", "content"),
        "names": lambda: _named(tree, "meta[name]", "name", "content"),
        "links": lambda: [{"href": tree.attrs[i]["href"], "text": tree.text(i), "classes": tree.attrs[i].get("class", "")} for i in tree.select("a[href]")],
        "paragraphs": lambda: _paragraphs(tree, container, paragraph),
        "inputs": lambda: {(a.get("name") or a.get("id") or ""): a.get("value", "") for i in reversed([*tree.select("input")]) for a in [tree.attrs[i]]},
        "style": lambda: "".join(tree.text(i) for i in tree.select("style")),
    }
    return {f: how[f]() for f in fields}


def page_reader(container: str | None = None, paragraph: str = "p", fields: Iterable[str] = tuple(FIELDS)):
    """A function for a column of pages. Not deterministic by name, so that a filter on its result does not run it twice."""
    fields = tuple(fields)
    for selector in (container, paragraph):  # a bad one is refused here, not on an executor
        if selector:
            compiled(selector)
    none = {f: {} if t.startswith("map") else [] if t.startswith("array") else "" if f == "style" else None for f, t in FIELDS.items()}

    @F.pandas_udf("struct<" + ",".join(f"{f}:{FIELDS[f]}" for f in fields) + ">")
    def read(html: pd.Series) -> pd.DataFrame:
        rows = [none if x is None else read_page(x, container, paragraph, fields) for x in html]
        return pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in fields})

    return read.asNondeterministic()


def with_page(pages: DataFrame, container: str | None = None, paragraph: str = "p", fields: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    return pages.withColumn("page", page_reader(container, paragraph, fields)("html")).drop("html")


def text_or_null(s: Column) -> Column:
    return null_if_empty(trim_all(s))


def page_meta(page: Column) -> Column:
    """struct<title, author, cover_url, genre, status_hint>: named tags first, then the general ones."""
    m = page["meta"]
    title = F.coalesce(m["og:novel:novel_name"], m["og:title"], trim_all(page["title"]))
    return F.struct(
        null_if_empty(title).alias("title"),
        null_if_empty(m["og:novel:author"]).alias("author"),
        null_if_empty(m["og:image"]).alias("cover_url"),
        null_if_empty(m["og:novel:genre"]).alias("genre"),
        F.coalesce(status_hint(m["og:novel:status"]), F.lit("unknown")).alias("status_hint"),
    )


def chapter_links(pages: DataFrame, marker: str, url_col: str = "url") -> DataFrame:
    """number, title, url and pos of links whose address holds ``marker`` and a chapter number. pages has page and a URL."""
    links = pages.select(*[c for c in pages.columns if c != "page"], F.posexplode("page.links").alias("pos", "link")).filter(F.contains(F.col("link.href"), F.lit(marker)))
    links = links.withColumn("link_url", resolve(F.col(url_col), F.col("link.href")))
    number = chapter_number(F.col("link_url"))
    return links.withColumn("number", number).withColumn("title", clean_chapter_title(F.col("link.text"))).filter("number IS NOT NULL").drop("link")


def paragraphs(page: Column) -> Column:
    """Texts of paragraphs, trimmed, without blank ones; null if there are none, which is an error of the page."""
    found = F.filter(F.transform(page["paragraphs"], lambda p: trim_all(p["text"])), lambda t: t != "")
    return F.when(F.size(found) > 0, found)


def hidden_classes(style: Column) -> Column:
    """Classes in the selector of any rule that mentions both display and none, one of several or nested ones too."""
    hiding = F.filter(F.split(style, "\\}"), lambda r: F.contains(r, F.lit("display")) & F.contains(r, F.lit("none")))
    # what stands before the last {, as a rule may stand in another
    tokens = F.flatten(F.transform(hiding, lambda r: F.split(F.coalesce(F.get(F.reverse(F.split(r, "\\{")), F.lit(1)), F.lit("")), r"[,\s]+")))
    return F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit(".")) & (F.length(t) > 1)), lambda t: F.substring(t, 2, 1 << 30))


def visible_paragraphs(page: Column) -> Column:
    """As :func:`paragraphs`, without those of a hidden class."""
    hidden = hidden_classes(page["style"])
    shown = F.filter(page["paragraphs"], lambda p: ~F.arrays_overlap(p["classes"], hidden))
    found = F.filter(F.transform(shown, lambda p: trim_all(p["text"])), lambda t: t != "")
    return F.when(F.size(found) > 0, found)


def hidden_input(page: Column, name: str) -> Column:
    return text_or_null(page["inputs"][name])


def links_of_class(page: Column, name: str) -> Column:
    return F.filter(page["links"], lambda x: F.array_contains(F.split(x["classes"], r"\s+"), name))


def embedded_json(html: Column, variable: str = "window.chapters") -> Column:
    """A page from the first [ behind a variable's name on; null without. A JSON reader takes the array and leaves what follows it."""
    at = F.instr(html, variable)
    behind = F.substring(html, at, F.lit(1 << 30))
    start = F.instr(behind, "[")
    return F.when((at > 0) & (start > 0), F.substring(behind, start, F.lit(1 << 30)))
