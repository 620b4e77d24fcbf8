"""URLs, slugs and output paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import null_if_empty, sanitize_filename, trim_all

UNKNOWN_AUTHOR = "Unknown Author"
MAX_NUMBER = 4294967295


def host(url: Column) -> Column:
    """The host, null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare_host(url: Column) -> Column:
    """The host without one leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def on_host(url: Column, name: str) -> Column:
    return F.coalesce(bare_host(url) == name.lower(), F.lit(False))


def base_url(url: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def slug(url: Column) -> Column:
    """The path segment behind the first "novel" or "novels"; null without one."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    return F.when(F.get(parts, F.lit(0)).isin("novel", "novels"), F.get(parts, F.lit(1)))


def chapter_number(url: Column) -> Column:
    """The digits right behind the first "chapter-"; null without, or beyond 32 bits."""
    digits = F.regexp_extract(url, r"^(?s).*?chapter-([0-9]*)", 1)
    n = null_if_empty(digits).try_cast("bigint")
    return F.when(n <= MAX_NUMBER, n)


def query_value(text: Column) -> Column:
    return F.url_encode(text)


def canonical_url(root: str, slug_col: Column) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/novel/"), slug_col)


def read_url(root: str, slug_col: Column, number: Column) -> Column:
    return F.concat(canonical_url(root, slug_col), F.lit("/chapter-"), number.cast("string"))


def list_request(url: Column, page: Column, post_id: Column) -> Column:
    """struct<url, body>: the form that asks a series' site for a page of its list; null for what is no URL."""
    return F.when(host(url).isNotNull(), F.struct(F.concat(F.lit("https://"), host(url), F.lit("/wp-admin/admin-ajax.php")).alias("url"), F.concat(F.lit("action=wi_getreleases_pagination&pagenum="), page.cast("string"), F.lit("&mypostid="), post_id).alias("body")))


def resolve(base: Column, href: Column) -> Column:
    """Relative to absolute; null where that fails. Spark has no such function, so it is an Arrow one."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b, h) if b is not None and h is not None else None
        except ValueError:
            return None

    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([one(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(base, href)


def author_part(author: Column) -> Column:
    clean = trim_all(F.coalesce(author, F.lit("")))
    return F.when(clean == "", F.lit(UNKNOWN_AUTHOR)).otherwise(sanitize_filename(clean))


def book_path(author: Column, title: Column, volume: Column | None = None) -> Column:
    """author/title/title[ - Vol NN].epub; no volume, no suffix."""
    name = sanitize_filename(title)
    suffix = F.lit("") if volume is None else F.coalesce(F.format_string(" - Vol %02d", volume), F.lit(""))
    if volume is not None:
        suffix = F.when(volume.isNull(), F.lit("")).otherwise(F.format_string(" - Vol %02d", volume))
    return F.concat_ws("/", author_part(author), name, F.concat(name, suffix, F.lit(".epub")))
