"""Reconciliation of ranked sources: one set-based pass over all novels at once.

Every outcome is a row already, so the walk over sources that stops at the
first success is the least rank of an ``ok`` outcome, an aggregate with a
map-side half. All joins are on (novel_id, number), and hot novels spread
over partitions by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_gate_stub
from ..session import keep
from .gaps import KEY, contiguity


def with_priority(discovered: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources are few per novel and joined by their key."""
    return discovered.join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id")


def ranked_pick(candidates: DataFrame) -> DataFrame:
    """The row of the first ``ok`` outcome by priority for each (novel, number)."""
    others = [c for c in candidates.columns if c not in (*KEY, "priority")]
    won = candidates.filter("outcome = 'ok'").groupBy(*KEY).agg(F.min_by(F.struct("priority", *others), "priority").alias("w"))
    return won.select(*KEY, "w.*")


def attempts(candidates: DataFrame) -> DataFrame:
    """For each (novel, number): ok_rank, primary_404 and primary_ok among the outcomes that the walk reaches."""
    ok = F.min(F.when(F.col("outcome") == "ok", F.col("priority")))
    out = candidates.groupBy(*KEY).agg(
        ok.alias("ok_rank"),
        F.bool_or((F.col("priority") == 1) & (F.col("outcome") == "not_found")).alias("primary_404"),
        F.count("*").alias("tried"),
    )
    # priority 1 comes first, so its outcome is always reached
    return out.withColumn("primary_ok", F.coalesce(F.col("ok_rank") == 1, F.lit(False)))


def divergence(discovered: DataFrame) -> DataFrame:
    """Novels whose sources end at different numbers: hi, lo and each source's end, by priority."""
    ends = discovered.groupBy("novel_id", "source_id", "priority").agg(F.max("number").alias("top"))
    out = ends.groupBy("novel_id").agg(F.count("*").alias("n"), F.max("top").alias("hi"), F.min("top").alias("lo"), F.array_sort(F.collect_list(F.struct("priority", "source_id", "top"))).alias("e"))
    detail = F.array_join(F.transform("e", lambda x: F.concat(x["source_id"].cast("string"), F.lit("="), x["top"].cast("string"))), ", ")
    return out.filter("n > 1 AND hi <> lo").select("novel_id", "hi", "lo", detail.alias("detail"))


def upgrade_candidates(chapters: DataFrame, gaps: DataFrame, primary_offers: DataFrame) -> DataFrame:
    """Chapters not from the primary that it offers in this pass, gaps aside. primary_offers: novel_id, number, source_id."""
    offers = primary_offers.select(*KEY, F.col("source_id").alias("primary_id"))
    met = chapters.join(offers, KEY).filter(~F.col("source_id").eqNullSafe(F.col("primary_id")))
    return met.join(gaps.select(*KEY), KEY, "left_anti")


@dataclass(frozen=True)
class SyncResult:
    chapters: DataFrame
    gaps: DataFrame
    sources: DataFrame
    novels: DataFrame
    report: DataFrame
    failures: DataFrame
    upgrades: DataFrame


def sync_pass(novels: DataFrame, sources: DataFrame, chapters: DataFrame, gaps: DataFrame, discovered: DataFrame, fetched: DataFrame, now, limit: int = 0, errors: DataFrame | None = None) -> SyncResult:
    """One pass. discovered holds both modes; a novel that is backfilling, or whose window does not reach what it has, takes 'full'.

    Sources in ``errors`` were not discovered in that mode. A stub is taken on
    a first fetch, but never replaces anything.
    """
    ranked = _of_sources(_dedupe_modes(discovered), sources)
    if errors is not None:
        ranked = ranked.join(errors.select("novel_id", "source_id", "mode"), ["novel_id", "source_id", "mode"], "left_anti")
    window = contiguity(chapters, ranked.filter("mode = 'latest'"))
    mode = novels.select(F.col("id").alias("novel_id"), "derived_state").join(window.select("novel_id", "contiguous"), "novel_id", "left")
    mode = keep(mode.select("novel_id", F.when((F.col("derived_state") == "backfilling") | ~F.coalesce("contiguous", F.lit(True)), "full").otherwise("latest").alias("mode")), "mode")
    # joined by the novel alone, by which the rows may be dealt already
    takes = mode.select("novel_id", (F.col("mode") == "full").alias("whole"))
    seen = ranked.join(takes, "novel_id").filter(F.when(F.col("whole"), F.col("mode") == "full").otherwise(F.col("mode") == "latest")).drop("whole")
    numbers = keep(_numbers(seen, fetched, chapters, gaps, limit), "numbers")
    when = F.lit(now).cast("timestamp")
    new = numbers.filter("n").select(*KEY, F.coalesce("won.title", F.lit("")).alias("title"), F.array_join("won.paragraphs", "\n\n").alias("body"), "won.source_id", when.alias("fetched_at"), F.lit(False).alias("exported"), F.lit(None).cast("timestamp").alias("exported_at"))
    up = numbers.filter("what IS NOT NULL")
    fresh = up.filter("what = 'upgraded'").select(*KEY, F.col("main.source_id").alias("n_source"), F.col("main.title").alias("n_title"), F.array_join("main.paragraphs", "\n\n").alias("n_body"))
    held2 = replace_content(chapters.unionByName(new), fresh)
    gaps2 = gaps.join(numbers.filter("first_ok").select(*KEY), KEY, "left_anti").unionByName(numbers.filter("g_new").select(*KEY).withColumn("detected_at", when))
    failures = numbers.filter("x").select(*KEY)
    counts = numbers.groupBy("novel_id").agg(
        F.count_if("t").alias("target"),
        F.count_if(F.expr("t AND NOT h AND NOT g")).alias("open"),
        F.count_if("n").alias("newly_fetched"),
        F.count_if(F.expr("n AND ok_rank <> 1")).alias("from_fallback"),
        F.count_if(F.expr("what = 'upgraded'")).alias("upgraded"),
        F.count_if("x").alias("failed"),
        F.array_sort(F.collect_list(F.when(F.expr("g AND NOT h"), F.col("number")))).alias("gaps"),
    )
    state = novels.select(F.col("id").alias("novel_id"), F.col("derived_state").alias("was")).join(counts, "novel_id", "left").join(mode, "novel_id")
    state = state.na.fill(0, ["target", "open", "newly_fetched", "from_fallback", "upgraded", "failed"])
    done = (F.col("target") > 0) & (F.col("open") == 0)
    to = F.when(F.col("was") == "backfilling", F.when(done, "live").otherwise("backfilling")).when(F.col("newly_fetched") > 0, "live").otherwise(F.col("was"))
    report = state.select("novel_id", F.col("was").alias("prev_state"), to.alias("new_state"), "mode", "target", "newly_fetched", "from_fallback", "upgraded", "failed", F.coalesce("gaps", F.array().cast("array<bigint>")).alias("gaps"))
    moved = report.filter("prev_state <> new_state").select(F.col("novel_id").alias("id"), "new_state")
    novels2 = novels.join(moved, "id", "left").withColumn("updated_at", F.when(F.col("new_state").isNotNull(), when).otherwise(F.col("updated_at"))).withColumn("derived_state", F.coalesce("new_state", "derived_state")).select(*novels.columns)
    return SyncResult(held2, gaps2, source_progress(sources, seen, now), novels2, report, failures, up.select(*KEY, "what"))


def _of_sources(discovered: DataFrame, sources: DataFrame) -> DataFrame:
    """``discovered`` with the priority of its source; a source that the novel does not have is left out."""
    rows = discovered.unionByName(sources.select("novel_id", F.col("id").alias("source_id"), "priority", F.lit(True).alias("own")), allowMissingColumns=True)
    of = Window.partitionBy("novel_id", "source_id")
    rows = rows.withColumn("priority", F.max("priority").over(of)).withColumn("known", F.max("own").over(of))
    return rows.filter("known AND own IS NULL").drop("known", "own")


def _numbers(seen: DataFrame, fetched: DataFrame, chapters: DataFrame, gaps: DataFrame, limit: int) -> DataFrame:
    """What the pass decides, a row for each number of each novel: the flags t (in the target), h (held in the end), n (new), g (a gap in the end), g_new
    (one that was none), first_ok (fetched from the primary) and x (failed); ok_rank, won (what is taken), main (what the primary gave) and what (of an upgrade).

    Unions and groups whose keys begin with the novel in place of joins, so that inputs dealt by it are shuffled no more.
    """
    got = F.struct("outcome", "title", "paragraphs")
    each = seen.select("novel_id", "source_id", "number", "priority", "title", F.lit(True).alias("listed"))
    each = each.unionByName(fetched.filter("number IS NOT NULL").select("novel_id", "source_id", "number", got.alias("got")), allowMissingColumns=True)
    best = F.min_by("got", F.when(F.col("got.outcome") == "ok", 0).when(F.col("got").isNotNull(), 1))
    each = each.groupBy("novel_id", "source_id", "number").agg(F.max("listed").alias("t"), F.max("priority").alias("priority"), F.max("title").alias("title"), best.alias("got")).filter("t")
    facts = each.unionByName(chapters.select(*KEY, F.col("source_id").alias("by"), F.lit(True).alias("had")), allowMissingColumns=True)
    facts = facts.unionByName(gaps.select(*KEY, F.lit(True).alias("gap")), allowMissingColumns=True)
    ok, first = F.col("got.outcome") == "ok", F.col("priority") == 1
    taken = F.struct("source_id", F.coalesce("got.title", "title").alias("title"), F.col("got.paragraphs").alias("paragraphs"))
    offer = F.struct("source_id", F.col("got").isNotNull().alias("asked"), F.col("got.outcome").alias("outcome"), F.col("got.title").alias("title"), F.col("got.paragraphs").alias("paragraphs"))
    no = lambda c: F.coalesce(c, F.lit(False))
    met = facts.groupBy(*KEY).agg(
        F.count("got").alias("tried"),
        F.min(F.when(ok, F.col("priority"))).alias("ok_rank"),
        F.bool_or(first & (F.col("got.outcome") == "not_found")).alias("gone"),
        F.min_by(taken, F.when(ok, F.col("priority"))).alias("won"),
        F.min_by(offer, F.when(first, F.col("source_id"))).alias("main"),
        F.max("by").alias("by"),
        *[no(F.max(c)).alias(f"is_{c}") for c in ("t", "had", "gap")],
    )
    lacking = F.col("is_t") & ~F.col("is_had")
    if limit:
        met = met.withColumn("rn", F.row_number().over(Window.partitionBy("novel_id", lacking).orderBy("number")))
        lacking &= F.col("rn") <= limit
    met = met.withColumn("wanted", lacking)
    walked = F.col("wanted") & (F.col("tried") > 0)
    met = met.select("*", no(walked & F.col("ok_rank").isNotNull()).alias("n"), no(walked & (F.col("ok_rank") == 1)).alias("first_ok"), no(walked & F.col("gone")).alias("p404"), no(walked & F.col("ok_rank").isNull() & ~no(F.col("gone"))).alias("x"))
    met = met.withColumn("h", F.col("is_had") | F.col("n")).withColumn("g1", F.col("is_gap") & ~F.col("first_ok") | F.col("p404") & ~F.col("first_ok"))
    # an upgrade: held from elsewhere, no gap, offered and fetched
    holder = F.when(F.col("n"), F.col("won.source_id")).otherwise(F.col("by"))
    asked = F.col("h") & ~F.col("g1") & no(F.col("main.asked")) & ~holder.eqNullSafe(F.col("main.source_id"))
    stub = is_gate_stub(F.array_join("main.paragraphs", " "))
    what = F.when((F.col("main.outcome") == "ok") & ~stub, "upgraded").when((F.col("main.outcome") == "not_found") | (F.col("main.outcome") == "ok"), "gap").otherwise("error")
    met = met.withColumn("what", F.when(asked, what))
    met = met.withColumn("g", F.col("g1") | no(F.col("what") == "gap"))
    return met.select(*KEY, F.col("is_t").alias("t"), "h", "n", "g", (F.col("g") & ~F.col("is_gap")).alias("g_new"), "first_ok", "x", "ok_rank", F.when(F.col("n"), F.col("won")).alias("won"), F.when(F.col("what").isNotNull(), F.col("main")).alias("main"), "what")


def _dedupe_modes(discovered: DataFrame) -> DataFrame:
    """Later rows win, within each mode: an aggregate, which is summed before it is shuffled."""
    key = ["novel_id", "source_id", "mode", "number"]
    others = [c for c in discovered.columns if c not in key]
    return discovered.groupBy(*key).agg(F.max_by(F.struct(*others), "pos").alias("last")).select(*key, "last.*")


def replace_content(chapters: DataFrame, fresh: DataFrame) -> DataFrame:
    """New title, body and source for the chapters in ``fresh`` (n_title, n_body, n_source); they are to be exported again, their fetch time stays."""
    met = chapters.join(fresh, KEY, "left")
    hit = F.col("n_body").isNotNull()
    changed = {"title": F.coalesce("n_title", "title"), "body": F.coalesce("n_body", "body"), "source_id": F.when(hit, F.col("n_source")).otherwise(F.col("source_id")), "exported": F.when(hit, F.lit(False)).otherwise(F.col("exported")), "exported_at": F.when(~hit, F.col("exported_at"))}
    return met.select(*[changed.get(c, F.col(c)).alias(c) for c in chapters.columns])


def source_progress(sources: DataFrame, seen: DataFrame, now) -> DataFrame:
    """last_seen_chapter and last_synced_at of the sources that gave anything in this pass."""
    top = seen.groupBy(F.col("source_id").alias("id")).agg(F.max("number").alias("top"))
    met = sources.join(top, "id", "left")
    return met.withColumn("last_synced_at", F.when(F.col("top").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_synced_at"))).withColumn("last_seen_chapter", F.coalesce("top", "last_seen_chapter")).select(*sources.columns)
