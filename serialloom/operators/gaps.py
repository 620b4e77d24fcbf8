"""Gap algebra: what is expected, what is there, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["novel_id", "number"]


def expected_numbers(have: DataFrame) -> DataFrame:
    """1 to the largest number of each novel; none for a novel without a positive one."""
    top = have.groupBy("novel_id").agg(F.max("number").alias("top")).filter("top >= 1")
    return top.select("novel_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "top")).alias("number"))


def missing(target: DataFrame, have: DataFrame) -> DataFrame:
    """target without have. An anti join: a null number in ``have`` hides nothing."""
    return target.select(*KEY).distinct().join(have.select(*KEY), KEY, "left_anti")


def unfilled_gaps(gaps: DataFrame, chapters: DataFrame) -> DataFrame:
    return gaps.join(chapters.select(*KEY), KEY, "left_anti")


def first_missing(gaps: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` smallest missing numbers of each novel; 0 for all."""
    if not limit:
        return gaps
    w = Window.partitionBy("novel_id").orderBy("number")
    return gaps.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def union_of_sources(discovered: DataFrame) -> DataFrame:
    return discovered.select(*KEY).distinct()


def dedupe(discovered: DataFrame, *, last: bool, order: str = "pos") -> DataFrame:
    """One row per (novel, source, number): a page's scan keeps the first, a map that is filled in order the last."""
    w = Window.partitionBy("novel_id", "source_id", "number").orderBy(F.desc(order) if last else F.asc(order))
    return discovered.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def number_visible(entries: DataFrame) -> DataFrame:
    """Positions among visible entries, from 1; an entry without the flag is visible."""
    w = Window.partitionBy("novel_id").orderBy("pos")
    return entries.filter(F.coalesce("visible", F.lit(1)) != 0).withColumn("number", F.row_number().over(w).cast("bigint"))


def number_reversed(entries: DataFrame, start: int = 1) -> DataFrame:
    """Newest first in, numbered from ``start`` (1 at least) oldest first."""
    w = Window.partitionBy("novel_id").orderBy(F.desc("pos"))
    return entries.withColumn("number", (F.row_number().over(w) + max(start, 1) - 1).cast("bigint"))


def generated(counts: DataFrame, url_of) -> DataFrame:
    """number and url for 1 to n of each novel; nothing for n < 1."""
    rows = counts.filter("n >= 1").select("novel_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("number"))
    return rows.withColumn("url", url_of(F.col("number")))


def newest(discovered: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("novel_id", "source_id").orderBy(F.desc("number"))
    return discovered.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def contiguity(have: DataFrame, discovered: DataFrame) -> DataFrame:
    """novel_id, max_have, min_new and contiguous: whether what is new begins right behind what is there.

    Two aggregates and a join on the novel; nothing is sorted.
    """
    top = have.groupBy("novel_id").agg(F.max("number").alias("max_have"))
    met = discovered.select(*KEY).join(top, "novel_id", "left").withColumn("max_have", F.coalesce("max_have", F.lit(0)))
    out = met.groupBy("novel_id").agg(F.max("max_have").alias("max_have"), F.min(F.when(F.col("number") > F.col("max_have"), F.col("number"))).alias("min_new"))
    return out.withColumn("contiguous", F.coalesce(F.col("min_new") <= F.col("max_have") + 1, F.lit(True)))
