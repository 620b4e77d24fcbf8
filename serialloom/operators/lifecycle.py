"""States from observed activity, and what follows from them. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import DAY


def seconds(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def quiet(latest: Column, now: Column, grace_days: int) -> Column:
    """Nothing new for the grace period; never anything counts as quiet since 1970."""
    return seconds(now) - F.coalesce(seconds(latest), F.lit(0)) >= grace_days * DAY


def last_fetch(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("novel_id").agg(F.max("fetched_at").alias("latest"))


def last_sync(sources: DataFrame) -> DataFrame:
    return sources.groupBy("novel_id").agg(F.max("last_synced_at").alias("last_synced"))


def reevaluate(novels: DataFrame, chapters: DataFrame, now, grace_days: int = 30) -> DataFrame:
    """novels, with live titles that are labelled completed and quiet as likely_complete."""
    when = F.lit(now).cast("timestamp")
    met = novels.join(last_fetch(chapters), novels["id"] == F.col("novel_id"), "left")
    over = (F.col("derived_state") == "live") & (F.col("status_hint") == "completed") & quiet(F.col("latest"), when, grace_days)
    return met.select(*[{"derived_state": F.when(over, "likely_complete").otherwise(F.col("derived_state")), "updated_at": F.when(over, when).otherwise(F.col("updated_at"))}.get(c, F.col(c)).alias(c) for c in novels.columns])


def recheck_skipped(state: Column, last_synced: Column, now: Column, days: int = 7) -> Column:
    """A title that is likely complete is left alone until the window is over; one never synced is not skipped."""
    return (state == "likely_complete") & F.coalesce(seconds(now) - seconds(last_synced) < days * DAY, F.lit(False))


def due(novels: DataFrame, sources: DataFrame, now, days: int = 7) -> DataFrame:
    met = novels.join(last_sync(sources), novels["id"] == F.col("novel_id"), "left").drop("novel_id")
    return met.filter(~recheck_skipped(F.col("derived_state"), F.col("last_synced"), F.lit(now).cast("timestamp"), days))


def export_wanted(prev: Column, new: Column, newly_fetched: Column, upgraded: Column, pending: Column, auto_export: bool = True, auto_append: bool = True) -> Column:
    caught_up = (prev == "backfilling") & (new == "live")
    changed = (newly_fetched > 0) | (upgraded > 0)
    return (F.lit(auto_export) & caught_up) | (F.lit(auto_append) & changed & prev.isin("live", "likely_complete")) | pending


def purged(chapters: DataFrame, novels: DataFrame, now, days: int = 30) -> DataFrame:
    """The chapters that retention deletes: exported long enough ago, of titles that are likely complete."""
    cutoff = seconds(F.lit(now).cast("timestamp")) - days * DAY
    old = F.coalesce(F.col("exported") & F.col("exported_at").isNotNull() & (seconds(F.col("exported_at")) <= cutoff), F.lit(False))
    over = novels.filter("derived_state = 'likely_complete'").select(F.col("id").alias("novel_id"))
    return chapters.filter(old).join(over, "novel_id", "left_semi")


def retain(chapters: DataFrame, novels: DataFrame, now, days: int = 30) -> DataFrame:
    """chapters without what retention deletes, in one pass over them."""
    cutoff = seconds(F.lit(now).cast("timestamp")) - days * DAY
    old = F.coalesce(F.col("exported") & F.col("exported_at").isNotNull() & (seconds(F.col("exported_at")) <= cutoff), F.lit(False))
    over = novels.filter("derived_state = 'likely_complete'").select(F.col("id").alias("novel_id"), F.lit(True).alias("over"))
    return chapters.join(over, "novel_id", "left").filter(~(old & F.coalesce("over", F.lit(False)))).select(*chapters.columns)


def set_state(novels: DataFrame, ids: list[int], state: str, now) -> DataFrame:
    hit = F.col("id").isin(ids)
    return novels.withColumn("derived_state", F.when(hit, state).otherwise(F.col("derived_state"))).withColumn("updated_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")))


def set_pending(novels: DataFrame, ids: list[int], pending: bool) -> DataFrame:
    """Does not touch updated_at."""
    return novels.withColumn("export_pending", F.when(F.col("id").isin(ids), F.lit(pending)).otherwise(F.col("export_pending")))
