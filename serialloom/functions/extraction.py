"""What is where on a site's pages, as rows of data: one Arrow function reads a page by the rules of its profile.

A rule names a field and a selector, and whether it wants the text or an
attribute. Rules of a field are tried by rank. The first element that a selector
finds counts; an attribute that is there decides even if it is empty, a text only
if there is one. ``every`` takes all elements (labels, paragraphs); ``visible``
leaves out those of a class that the page's style hides; ``within`` names a
container, the first of its kind, outside of which nothing is looked at.

Profiles are rows too: hosts (with their www. form or without) and what their
pages are read by, the first by rank for a host.
"""

from __future__ import annotations

import json
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .status import first_known
from .text import after_colon, clean_chapter_title, count_in_tail, digits_only, head_before_bar, null_if_empty, real_cover, strip_number_colon, trim_all
from .tree import Tree, compiled
from .urls import host

RULES = "profile string, field string, rank int, within string, selector string, attribute string, every boolean, visible boolean, clean string"
PROFILES = "rank int, profile string, host string, with_www boolean, chapter_marker string, page_param string, max_pages int"
#: How a value is cleaned; without a name it is trimmed.
CLEAN = {
    "head": head_before_bar,
    "behind_colon": after_colon,
    "tail_count": lambda v: count_in_tail(v).cast("string"),
    "digits": lambda v: digits_only(v).cast("string"),
    "whole": lambda v: trim_all(v).try_cast("bigint").cast("string"),
    "cover": real_cover,
    "chapter": clean_chapter_title,
    "numbered_chapter": lambda v: strip_number_colon(clean_chapter_title(v)),
}
FIELDS = ("title", "author", "cover_url", "genre", "status_hint", "total", "post_id", "chapter_title", "lang")
LISTS = ("body",)


def rule(profile: str, field: str, selector: str, rank: int = 1, attribute: str | None = None, clean: str | None = None, within: str | None = None, every: bool = False, visible: bool = False) -> tuple:
    """A row of RULES. A selector or a cleaning that is not known is refused."""
    for s in (selector, within):
        if s is not None:
            compiled(s)
    if clean is not None and clean not in CLEAN:
        raise ValueError(f"there is no cleaning {clean!r}; there are {', '.join(CLEAN)}")
    return (profile, field, rank, within, selector, attribute, every, visible, clean)


def _meta(profile: str, field: str, name: str, rank: int = 1, clean: str | None = None, key: str = "property") -> tuple:
    return rule(profile, field, f'meta[{key}="{name}"]', rank, "content", clean)


# The hosts of known sites, and where their pages hold what.
SITES = (
    (1, "chikari", "chikari.moe", True, None, None, None),
    (2, "freewebnovel", "freewebnovel.com", True, None, None, None),
    (3, "lightnovelworld", "lightnovelworld.org", True, None, None, None),
    (4, "royalroad", "royalroad.com", True, None, None, None),
    (5, "scribblehub", "scribblehub.com", True, None, None, None),
    (6, "novgo", "novgo.net", False, "/chapter-", "page", 500),
)
GENERAL = (
    ("title", "og:novel:novel_name", 1),
    ("title", "og:title", 2),
    ("author", "og:novel:author", 1),
    ("cover_url", "og:image", 1),
    ("genre", "og:novel:genre", 1),
    ("status_hint", "og:novel:status", 1),
)
SITE_RULES = (
    _meta("royalroad", "title", "og:title"),
    rule("royalroad", "title", "title", 2, clean="head"),
    rule("royalroad", "title", "h1", 3),
    _meta("royalroad", "author", "twitter:creator", key="name"),
    rule("royalroad", "author", 'a[href^="/profile/"]', 2),
    _meta("royalroad", "cover_url", "og:image"),
    rule("royalroad", "status_hint", "span.label", every=True),
    rule("royalroad", "body", "p", within=".chapter-inner", every=True, visible=True),
    _meta("scribblehub", "title", "og:title"),
    rule("scribblehub", "author", 'a[href*="/profile/"]'),
    _meta("scribblehub", "cover_url", "og:image", clean="cover"),
    rule("scribblehub", "status_hint", "span.rnd_stats", every=True),
    rule("scribblehub", "post_id", "#mypostid", attribute="value"),
    rule("scribblehub", "total", ".cnt_toc", clean="digits"),
    rule("scribblehub", "body", "p", within="#chp_raw", every=True),
    rule("lightnovelworld", "title", "h1.novel-title"),
    rule("lightnovelworld", "author", "p.novel-author", clean="behind_colon"),
    _meta("lightnovelworld", "cover_url", "og:image"),
    rule("lightnovelworld", "status_hint", ".status-badge"),
    _meta("lightnovelworld", "total", "og:title", clean="tail_count"),
    rule("lightnovelworld", "chapter_title", "h1.chapter-title", clean="numbered_chapter"),
    rule("lightnovelworld", "body", "p", within="#chapterText", every=True),
    rule("freewebnovel", "total", "[data-total-chapters]", attribute="data-total-chapters", clean="whole"),
)


def general_rules(profile: str, container: str | None = None, paragraph: str = "p") -> list[tuple]:
    """Rules of a site that describes itself in general tags, with the container of its prose."""
    found = [_meta(profile, field, name, rank) for field, name, rank in GENERAL]
    return [*found, rule(profile, "title", "title", 3), *([rule(profile, "body", paragraph, within=container, every=True)] if container else [])]


def site_rules(spark: SparkSession, *more: tuple) -> DataFrame:
    rows = [*SITE_RULES, *general_rules("freewebnovel", ".txt"), *general_rules("novgo", "#chapter-content"), *more]
    return spark.createDataFrame(rows, RULES)


def site_profiles(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """The known sites, and behind them others (of PROFILES); a host that several name is the first one's."""
    own = spark.createDataFrame(list(SITES), PROFILES)
    return own if more is None else own.unionByName(more.withColumn("rank", F.col("rank") + len(SITES) + 1))


def from_files(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles and rules of sites that files describe (see :func:`serialloom.sources.config.profiles`).

    Such a site describes itself in general tags. A file whose selectors are not understood is left out with a warning.
    """
    profiles, rules = [], []
    for r in found.orderBy("rank").collect():  # a row for each file
        try:
            rules += general_rules(r["name"], r["content_selector"], r["paragraph_selector"])
        except ValueError as e:
            warnings.warn(f"profile {r['name']}: {e}", stacklevel=2)
            continue
        profiles.append((r["rank"], r["name"], r["host"], False, r["chapter_marker"], r["toc_page_param"], r["max_toc_pages"]))
    spark = found.sparkSession
    return spark.createDataFrame(profiles, PROFILES), spark.createDataFrame(rules, RULES)


def by_host(profiles: DataFrame) -> DataFrame:
    """One row for each host that is served, its www. form apart."""
    named = profiles.withColumn("host", F.lower("host"))
    both = named.withColumn("host", F.explode(F.when(F.col("with_www"), F.array("host", F.concat(F.lit("www."), "host"))).otherwise(F.array("host"))))
    return both.groupBy("host").agg(F.min_by(F.struct("profile", "chapter_marker", "page_param", "max_pages"), "rank").alias("p")).select("host", "p.*")


def with_profile(rows: DataFrame, profiles: DataFrame, url: str = "url", most: int = 100_000) -> DataFrame:
    """rows with the profile of their URL's host (null for a host that none serves); a table of up to ``most`` hosts is broadcast, a larger one joined by its key."""
    served = by_host(profiles).withColumnRenamed("host", "__host")
    served = F.broadcast(served) if served.count() <= most else served
    return rows.withColumn("__host", host(F.col(url))).join(served, "__host", "left").drop("__host")


@lru_cache(256)
def _rules(text: str) -> tuple[dict, ...]:
    return tuple(json.loads(text))


def _values(tree: Tree, r: dict) -> list[str | None]:
    within = None
    if r.get("within") is not None:
        within = next(tree.select(r["within"]), None)
        if within is None:
            return []
    hidden = tree.hidden() if r.get("visible") else ()
    found = []
    for i in tree.select(r["selector"], within):
        if hidden and not hidden.isdisjoint(tree.attrs[i].get("class", "").split()):
            continue
        found.append(tree.text(i) if r.get("attribute") is None else tree.attrs[i].get(r["attribute"]))
        if not r.get("every"):
            break
    return found


def read_by_rules(html: str, rules: str) -> list[list[str | None]]:
    """What each of some rules (a JSON list) finds on a page."""
    tree = Tree(html)
    return [_values(tree, r) for r in _rules(rules)]


def _read():
    @F.pandas_udf("array<array<string>>")
    def run(html: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([None if h is None or r is None else read_by_rules(h, r) for h, r in zip(html, rules, strict=True)], dtype=object)

    return run.asNondeterministic()


def _cleaned(value: Column, how: Column) -> Column:
    out = F.when(how.isNull(), trim_all(value))
    for name, f in CLEAN.items():
        out = out.when(how == name, f(value))
    return out


def extract(pages: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """pages (with html and profile) with a column for each field, and lists; null where nothing was found. The status is unknown then.

    Rules are grouped by profile and joined to the pages; a page is read once.
    """
    r = F.struct("rank", "field", "within", "selector", "attribute", "every", "visible", "clean")
    grouped = rules.groupBy("profile").agg(F.array_sort(F.collect_list(r)).alias("__rules"))  # a site's rules are few
    grouped = F.broadcast(grouped) if grouped.count() <= most else grouped
    met = pages.join(grouped, "profile", "left")
    met = met.withColumn("__found", _read()("html", F.to_json("__rules"))).withColumn("__each", F.arrays_zip(F.col("__rules").alias("rule"), F.col("__found").alias("values")))

    def of(field: str) -> Column:
        mine = F.filter("__each", lambda z: z["rule"]["field"] == field)
        first = lambda z: F.get(z["values"], F.lit(0))
        decides = F.filter(mine, lambda z: F.when(z["rule"]["attribute"].isNotNull(), first(z).isNotNull()).otherwise(F.coalesce(trim_all(first(z)) != "", F.lit(False))))
        return null_if_empty(F.get(F.transform(decides, lambda z: _cleaned(first(z), z["rule"]["clean"])), F.lit(0)))

    def every(field: str) -> Column:
        mine = F.filter("__each", lambda z: z["rule"]["field"] == field)
        return F.flatten(F.transform(mine, lambda z: F.coalesce(z["values"], F.array().cast("array<string>"))))

    columns = {f: of(f) for f in FIELDS if f not in ("status_hint", "total")}
    columns["total"] = of("total").try_cast("bigint")
    columns["status_hint"] = first_known(F.coalesce(every("status_hint"), F.array().cast("array<string>")))
    for f in LISTS:
        texts = F.filter(F.transform(every(f), trim_all), lambda t: t != "")
        columns[f] = F.when(F.size(texts) > 0, texts)
    own = [c for c in pages.columns if c not in columns]
    return met.select(*own, *[columns[f].alias(f) for f in (*FIELDS, *LISTS)])
