"""Listings: one row per novel, from aggregates that are joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import GATE_PHRASES, ascii_lower, listed_numbers, overlap_key
from .gaps import unfilled_gaps


def gap_summary(gaps: DataFrame, most: int = 15) -> DataFrame:
    """novel_id, n_gaps and the numbers, the first ``most`` of them spelled out. Only those are gathered; the rest is a count."""
    first = Window.partitionBy("novel_id").orderBy("number")  # a rank up to a limit is cut down before the shuffle
    listed = gaps.select("novel_id", "number").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= most).groupBy("novel_id").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    out = gaps.groupBy("novel_id").agg(F.count("*").alias("n_gaps")).join(listed, "novel_id")
    more = F.when(F.col("n_gaps") > most, F.concat(F.lit(", … (+"), (F.col("n_gaps") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return out.select("novel_id", "n_gaps", F.concat(listed_numbers(F.col("numbers"), most), more).alias("listed"))


def novel_rollup(novels: DataFrame, sources: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each novel with its chapter count, source count and primary; novels without any have 0 and null."""
    held = chapters.groupBy("novel_id").agg(F.count("*").alias("n_chapters"), F.max("number").alias("last_number"))
    own = sources.groupBy("novel_id").agg(F.count("*").alias("n_sources"), F.min_by("id", "priority").alias("primary_source"))
    met = novels.join(held, novels["id"] == held["novel_id"], "left").drop("novel_id").join(own, F.col("id") == own["novel_id"], "left").drop("novel_id")
    return met.na.fill(0, ["n_chapters", "n_sources"])


def nested_sources(sources: DataFrame) -> DataFrame:
    """novel_id and its sources, in order of priority."""
    own = sources.groupBy("novel_id").agg(F.array_sort(F.collect_list(F.struct("priority", "id", "source_name", "url", "last_seen_chapter"))).alias("sources"))
    return own


def subscription_lines(novels: DataFrame, sources: DataFrame, chapters: DataFrame, gaps: DataFrame, gaps_only: bool = False) -> DataFrame:
    """novel_id, line, gap_line (null without gaps) and source_lines, as the listing shows them."""
    roll = novel_rollup(novels, sources, chapters).select("id", "title", "author", "export_pending", "derived_state", "n_chapters")
    open_gaps = gap_summary(unfilled_gaps(gaps, chapters))
    met = roll.join(open_gaps, F.col("id") == F.col("novel_id"), "inner" if gaps_only else "left").drop("novel_id").join(nested_sources(sources), F.col("id") == F.col("novel_id"), "left")
    seen = lambda s: F.coalesce(F.concat(F.lit("last seen ch."), s["last_seen_chapter"].cast("string")), F.lit("not yet synced"))
    role = lambda s: F.when(s["priority"] == 1, "primary").otherwise("fallback")
    line = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit("  "), "title", F.lit(" — "), F.coalesce("author", F.lit("Unknown Author")), F.lit("  ["), F.col("n_chapters").cast("string"), F.lit(" chapters, "), "derived_state", F.when(F.col("export_pending"), ", export pending").otherwise(""), F.lit("]"))
    gap_line = F.concat(F.col("n_gaps").cast("string"), F.lit(" unavailable at source (404): ch. "), "listed")
    lines = F.transform("sources", lambda s: F.concat(F.lit("["), role(s), F.lit("] "), s["source_name"], F.lit(" — "), s["url"], F.lit(" ("), seen(s), F.lit(")")))
    return met.select(F.col("id").alias("novel_id"), line.alias("line"), gap_line.alias("gap_line"), F.coalesce(lines, F.array().cast("array<string>")).alias("source_lines"))


def paragraph_overlap(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """novel_id, number and the share of remote paragraphs (each counted) that the stored copy has too; 0 for no paragraphs."""
    a = stored.select("novel_id", "number", F.transform("paragraphs", overlap_key).alias("mine"))
    met = remote.select("novel_id", "number", F.transform("paragraphs", overlap_key).alias("other")).join(a, ["novel_id", "number"])
    hits = F.size(F.filter("other", lambda p: F.array_contains("mine", p)))
    return met.select("novel_id", "number", F.when(F.size("other") == 0, F.lit(0.0)).otherwise(hits / F.greatest(F.size("other"), F.lit(1))).alias("overlap"))


def status_lines(novels: DataFrame, sources: DataFrame, chapters: DataFrame, gaps: DataFrame) -> DataFrame:
    """novel_id, line and gap_line: the short listing."""
    roll = novel_rollup(novels, sources, chapters)
    met = roll.join(gap_summary(unfilled_gaps(gaps, chapters)), F.col("id") == F.col("novel_id"), "left").drop("novel_id")
    line = F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), "title", F.lit(" — "), F.col("n_chapters").cast("string"), F.lit(" chapters ["), "derived_state", F.when(F.col("export_pending"), ", export pending").otherwise(""), F.lit("]"))
    return met.select(F.col("id").alias("novel_id"), line.alias("line"), F.concat(F.lit("gaps: "), "listed").alias("gap_line"))


def list_ends(discovered: DataFrame) -> DataFrame:
    """novel_id, source_id, n and the first and last entry of each list: first_number, first_title, last_number, last_title. Of equal numbers the first title by pos counts."""
    at = F.struct("number", "pos")
    ends = discovered.groupBy("novel_id", "source_id").agg(F.countDistinct("number").alias("n"), F.min_by(F.struct("number", "title"), at).alias("a"), F.max_by(F.struct("number", "title"), F.struct("number", (-F.col("pos")).alias("pos"))).alias("z"))
    return ends.select("novel_id", "source_id", "n", F.col("a.number").alias("first_number"), F.col("a.title").alias("first_title"), F.col("z.number").alias("last_number"), F.col("z.title").alias("last_title"))


def list_lines(ends: DataFrame) -> DataFrame:
    """The lines of a list's summary."""
    entry = lambda what, e: F.concat(F.lit(f"  {what} ch."), F.col(f"{e}_number").cast("string"), F.lit(" "), F.coalesce(f"{e}_title", F.lit("")))
    return ends.select("novel_id", "source_id", F.array(F.concat(F.col("n").cast("string"), F.lit(" chapters discovered.")), entry("first:", "first"), entry("last: ", "last")).alias("lines"))


def profile_lines(profiles: DataFrame) -> DataFrame:
    """rank and line of each profile, as they are tried."""
    return profiles.select("rank", F.concat("host", F.lit(" — "), "profile").alias("line")).orderBy("rank")


def config_lines(spark: SparkSession, config) -> DataFrame:
    """key and value of each setting, in order."""
    from dataclasses import fields

    return spark.createDataFrame([(i, f.name, str(getattr(config, f.name))) for i, f in enumerate(fields(config))], "pos int, key string, value string").orderBy("pos")


def timestamp_text(t: Column) -> Column:
    """A time as logs show it, in the session's zone."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


_BLOCK = 1024


def stored_against_remote(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """novel_id, n_stored, n_common, n_only_stored, stored_last, remote_last and samples (the first, middle and last number on both sides).

    Numbers are marked by one grouping over both sides. The middle one is found by
    counts of blocks of numbers, which list their common numbers (``_BLOCK`` at
    most), so that no novel is sorted as a whole and both sides are read once.
    """
    side = lambda df, s, r: df.select("novel_id", "number", F.lit(s).alias("s"), F.lit(r).alias("r"))
    each = side(stored, 1, 0).unionByName(side(remote, 0, 1)).groupBy("novel_id", "number").agg(F.max("s").alias("s"), F.max("r").alias("r"))
    each = each.withColumn("common", F.when(F.col("s") + F.col("r") == 2, F.col("number"))).withColumn("block", F.floor(F.col("number") / _BLOCK))
    of = lambda c, x: F.max(F.when(c, x))
    number = F.col("number")
    by_block = each.groupBy("novel_id", "block").agg(F.sum("s").alias("n_stored"), F.count("common").alias("n_common"), of(F.col("s") == 1, number).alias("stored_last"), of(F.col("r") == 1, number).alias("remote_last"), F.sort_array(F.collect_list("common")).alias("listed"))
    novel = Window.partitionBy("novel_id")
    held = by_block.withColumn("through", F.sum("n_common").over(novel.orderBy("block"))).withColumn("place", F.floor(F.sum("n_common").over(novel) / 2) - F.col("through") + F.col("n_common"))
    middle = F.when((F.col("place") >= 0) & (F.col("place") < F.col("n_common")), F.get("listed", F.col("place").cast("int")))
    ends = [F.min(F.get("listed", F.lit(0))).alias("first"), F.max(middle).alias("middle"), F.max(F.get("listed", F.col("n_common").cast("int") - 1)).alias("last")]
    met = held.groupBy("novel_id").agg(F.sum("n_stored").alias("n_stored"), F.sum("n_common").alias("n_common"), F.max("stored_last").alias("stored_last"), F.max("remote_last").alias("remote_last"), *ends)
    return met.select("novel_id", "n_stored", "n_common", (F.col("n_stored") - F.col("n_common")).alias("n_only_stored"), "stored_last", "remote_last", F.when(F.col("n_common") > 0, F.array("first", "middle", "last")).alias("samples"))


def compare_samples(against: DataFrame, stored: DataFrame, remote: DataFrame, enough: float = 0.6) -> DataFrame:
    """novel_id, number, overlap and verdict (same, stub, different) of the sampled chapters. stored, remote: paragraphs by novel and number."""
    picked = against.select("novel_id", F.explode(F.array_distinct("samples")).alias("number"))
    mine = stored.join(picked, ["novel_id", "number"], "left_semi")
    met = paragraph_overlap(mine, remote.join(picked, ["novel_id", "number"], "left_semi")).join(mine.select("novel_id", "number", "paragraphs"), ["novel_id", "number"])
    said = ascii_lower(F.array_join("paragraphs", " "))
    gate = (F.size("paragraphs") <= 4) & (F.contains(said, F.lit(GATE_PHRASES[0])) | F.contains(said, F.lit(GATE_PHRASES[1])))
    return met.select("novel_id", "number", "overlap", F.when(F.col("overlap") >= enough, "same").when(gate, "stub").otherwise("different").alias("verdict"))
