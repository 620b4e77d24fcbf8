"""The library: five tables, in memory or on disk, where a version names the files that count (see :mod:`.ledger`)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, normalize_title, split_body
from . import ledger
from .schemas import TABLES


#: Whatever is refused about a library, by a change or by its commit.
LibraryError = ledger.LedgerError


@dataclass(frozen=True)
class Library:
    novels: DataFrame
    sources: DataFrame
    chapters: DataFrame
    chapter_gaps: DataFrame
    meta: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Library:
        return Library(**{k: spark.createDataFrame([], v) for k, v in TABLES.items()})

    @staticmethod
    def of(spark: SparkSession, **rows) -> Library:
        """A library in memory, from lists of tuples."""
        return Library(**{k: spark.createDataFrame(rows.get(k, []), v) for k, v in TABLES.items()})

    def with_(self, **tables: DataFrame) -> Library:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in TABLES}


def open_library(spark: SparkSession, folder: str, version: int | None = None) -> Library:
    """The last version, or an older one; an empty library where there is none. Columns that an older file lacks are null."""
    found = ledger.version_at(spark, folder, version)
    return Library.empty(spark) if found is None else Library(**ledger.tables_at(spark, folder, found))


def save_library(library: Library, folder: str) -> int:
    """All tables anew, as one version: for a first load or a restore. A pass over a part of it is a :class:`ledger.Pass`."""
    now = ledger.begin(library.novels.sparkSession, folder)
    for table, df in library.tables().items():
        now.replace(table, df)
    return now.commit("save")


def violations(lib: Library) -> DataFrame:
    """rule and n: how many rows break each of the library's constraints."""
    dup = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    orphan = lambda df, key: df.join(lib.novels.select(F.col("id").alias(key)), key, "left_anti")
    rules = {
        "novels.id is unique": dup(lib.novels, "id"),
        "sources.id is unique": dup(lib.sources, "id"),
        "sources.url is unique": dup(lib.sources, "url"),
        "chapters are unique": dup(lib.chapters, "novel_id", "number"),
        "gaps are unique": dup(lib.chapter_gaps, "novel_id", "number"),
        "meta.key is unique": dup(lib.meta, "key"),
        "sources have a novel": orphan(lib.sources, "novel_id"),
        "chapters have a novel": orphan(lib.chapters, "novel_id"),
        "gaps have a novel": orphan(lib.chapter_gaps, "novel_id"),
    }
    out = None
    for rule, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def select_novel(novels: DataFrame, selector: str) -> DataFrame:
    """A number is always an id; anything else is a title, case of A to Z aside."""
    if selector.lstrip("+-").isdigit() and len(selector) - len(selector.lstrip("+-")) <= 1:
        return novels.filter(F.col("id") == int(selector))
    return novels.filter(ascii_lower(F.col("title")) == ascii_lower(F.lit(selector)))


def same_title(novels: DataFrame, title: Column | str) -> DataFrame:
    want = F.lit(title) if isinstance(title, str) else title
    return novels.filter(normalize_title(F.col("title")) == normalize_title(want))


def sources_of(lib: Library, novel_id: int) -> DataFrame:
    return lib.sources.filter(F.col("novel_id") == novel_id).orderBy("priority")


def sources_with_titles(sources: DataFrame, novels: DataFrame) -> DataFrame:
    """Every source with its novel's title, by novel and priority."""
    return sources.join(novels.select(F.col("id").alias("novel_id"), F.col("title").alias("novel_title")), "novel_id")


def source_ids(sources: DataFrame, urls: DataFrame) -> DataFrame:
    """url and source_id (null for one that no source has) of each of some URLs."""
    return urls.select("url").join(sources.select("url", F.col("id").alias("source_id")), "url", "left")


def novel_meta(novels: DataFrame, sources: DataFrame) -> DataFrame:
    """What a site says of a novel, as it is held: title, author, cover_url, genre, status_hint and source_url, the primary's."""
    first = sources.groupBy("novel_id").agg(F.min_by("url", "priority").alias("source_url"))
    return novels.join(first, novels["id"] == F.col("novel_id"), "left").select("id", "title", "author", "cover_url", "genre", "status_hint", F.coalesce("source_url", F.lit("")).alias("source_url"))


def chapters_of(lib: Library, novel_id: int, number: int | None = None) -> DataFrame:
    rows = lib.chapters.filter(F.col("novel_id") == novel_id)
    rows = rows if number is None else rows.filter(F.col("number") == number)
    return rows.select("novel_id", "number", "title", split_body(F.col("body")).alias("paragraphs"), "source_id").orderBy("number")


def meta_get(lib: Library, key: str) -> str | None:
    row = lib.meta.filter(F.col("key") == key).select("value").first()
    return row and row[0]


def meta_set(lib: Library, key: str, value: str) -> Library:
    row = lib.meta.sparkSession.createDataFrame([(key, value)], lib.meta.schema)
    return lib.with_(meta=lib.meta.filter(F.col("key") != key).unionByName(row))


def log_tail(log: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` lines of a log with columns pos and value, in order."""
    return log.orderBy(F.desc("pos")).limit(n).orderBy("pos")


def last_sync_line(log: DataFrame, marker: str = "sync complete") -> DataFrame:
    return log.filter(F.contains("value", F.lit(marker))).orderBy(F.desc("pos")).limit(1)
