"""A list that an API gives out page by page, as a Spark data source.

``spark.read.format("paged_api")`` with options

- ``url``: with ``{key}``, ``{order}``, ``{limit}`` and ``{offset}``; what it gives
  is an object with ``items`` and, if known, ``total``
- ``keys``: one a line, each a list of its own
- ``limit``: items asked for at once (500)
- ``needed``: the newest so many usable items only
- ``window``: one page of the newest so many

gives key, ord (asc or desc), offset, n_items and body, one row for each page.

A whole list is read oldest first and in parallel: its first page tells the
total and how many items a page really has, and every further offset is a
partition of its own. With ``needed``, pages are read from the newest on, one
behind the other within a partition of its key, until so many items have a
usable number: no page is asked for that the reader does not need. A filter on
``key`` reaches the source where spark.sql.python.filterPushdown.enabled is set
(option ``push``, which :func:`read_lists` sets by it), so that other lists are
not asked for at all.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.json_docs import chapter_page
from ..functions.status import RETRYABLE
from ..functions.urls import MAX_NUMBER

SCHEMA = "key string, ord string, offset bigint, n_items int, body string"


def get(url: str, tries: int = 4, pause_s: float = 0.5) -> str:
    """A page's text; states that pass are tried again after a pause that doubles, a page that is not there is empty."""
    for left in range(tries - 1, -1, -1):
        try:
            with urlopen(url, timeout=30) as answer:
                return answer.read().decode()
        except HTTPError as e:
            if e.code in (404, 410):
                return ""
            if e.code not in RETRYABLE or not left:
                raise
        except URLError:
            if not left:
                raise
        time.sleep(pause_s)
        pause_s *= 2
    raise AssertionError


def usable(item: object) -> bool:
    """Whether an item has a number that a chapter may have."""
    n = item.get("number") if isinstance(item, dict) else None
    return isinstance(n, (int, float)) and not isinstance(n, bool) and math.isfinite(n) and 1 <= n <= MAX_NUMBER and n == math.floor(n)


@dataclass
class Page:
    offset: int
    body: str
    items: list
    total: int


def read_page(url: str, key: str, order: str, limit: int, offset: int) -> Page:
    body = get(url.format(key=quote(key, safe=""), order=order, limit=limit, offset=offset))
    found = json.loads(body) if body else {}
    items = found.get("items") or []
    total = found.get("total")
    return Page(offset, body, items, len(items) if total is None else int(total))


@dataclass
class Part(InputPartition):
    key: str
    offset: int | None  # None: from the newest on
    limit: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.keys = [k for k in options.get("keys", "").splitlines() if k]
        self.limit = int(options.get("limit", 500))
        self.needed = int(options["needed"]) if "needed" in options else None
        self.window = int(options["window"]) if "window" in options else None

    def partitions(self) -> list[Part]:
        if self.window is not None:
            return [Part(k, None, self.window) for k in self.keys]
        if self.needed is not None:
            return [Part(k, None, self.limit) for k in self.keys]
        parts = []
        for k in self.keys:
            first = read_page(self.url, k, "asc", self.limit, 0)
            if step := min(self.limit, len(first.items)):
                parts += [Part(k, at, self.limit) for at in range(0, max(first.total, 1), step)]
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        if part.offset is not None:
            p = read_page(self.url, part.key, "asc", part.limit, part.offset)
            if p.items:
                yield (part.key, "asc", part.offset, len(p.items), p.body)
            return
        at = have = 0
        while True:
            p = read_page(self.url, part.key, "desc", part.limit, at)
            if not p.items:
                return
            yield (part.key, "desc", at, len(p.items), p.body)
            # the next offset follows from what came, usable or not
            at += min(part.limit, len(p.items))
            have += sum(map(usable, p.items))
            if self.window is not None or have >= (self.needed or 0) or at >= p.total:
                return


class FilteredReader(Reader):
    """Spark takes such a reader only where the pushdown is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(attribute=("key",), value=v):
                    self.keys = [k for k in self.keys if k == v]
                case In(attribute=("key",), value=vs):
                    self.keys = [k for k in self.keys if k in vs]
                case _:
                    yield f


class PagedApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        return (FilteredReader if options.get("push") == "true" else Reader)(options)


def read_lists(spark: SparkSession, url: str, keys: list[str], **options: int) -> DataFrame:
    """The pages of these lists; options as above."""
    spark.dataSource.register(PagedApi)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    reader = spark.read.format("paged_api").option("url", url).option("keys", "\n".join(keys)).option("push", push)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def entries(pages: DataFrame, key: Column | str = "key") -> DataFrame:
    """key, offset, pos, number and title of the usable items of pages; parsed by Spark."""
    page = pages.select(F.col(key) if isinstance(key, str) else key.alias("key"), "offset", F.posexplode(chapter_page(F.col("body"))["chapters"]).alias("pos", "c"))
    return page.select("key", "offset", "pos", "c.number", "c.title")
