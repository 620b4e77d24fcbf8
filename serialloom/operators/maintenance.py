"""Changes to the library, each a rewrite of the tables that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STUB_MAX_CHARS, ascii_lower, is_gate_stub, normalize_title, split_body
from ..functions.urls import bare_host, slug
from ..sources.library import Library, LibraryError, same_title
from .gaps import KEY, unfilled_gaps
from .reconcile import replace_content

HIGH_WATER = "novels.next_id"


def _next_id(lib: Library, table: DataFrame, key: str) -> int:
    """Beyond every id that was ever given: the mark in meta outlives deleted rows."""
    mark = lib.meta.filter(F.col("key") == key).first()
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return max(top + 1, int(mark["value"]) if mark else 1)


def _append(df: DataFrame, *rows: tuple) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def _marked(lib: Library, key: str, value: int) -> DataFrame:
    return _append(lib.meta.filter(F.col("key") != key), (key, str(value)))


def subscribe(lib: Library, title: str, source_name: str, url: str, now, author: str | None = None, cover_url: str | None = None, genre: str | None = None, status_hint: str = "unknown", force: bool = False) -> tuple[Library, int]:
    """A new novel with a primary source. A known URL, or the same title and author, is refused; so is a like title unless forced."""
    if not lib.sources.filter(F.col("url") == url).isEmpty():
        raise LibraryError(f"already subscribed: {url}")
    twin = (ascii_lower(F.col("title")) == ascii_lower(F.lit(title))) & (F.coalesce("author", F.lit("")) == (author or ""))
    if not lib.novels.filter(twin).isEmpty():
        raise LibraryError(f"a novel of this title and author is there: {title}")
    if not force and not same_title(lib.novels, title).isEmpty():
        raise LibraryError(f"a novel of a like title is there: {title}")
    novel, source = _next_id(lib, lib.novels, HIGH_WATER), _next_id(lib, lib.sources, "sources.next_id")
    out = lib.with_(
        novels=_append(lib.novels, (novel, title, author, cover_url, genre, status_hint, "backfilling", False, now, now)),
        sources=_append(lib.sources, (source, novel, source_name, url, 1, None, None)),
        meta=_marked(lib, HIGH_WATER, novel + 1),
    )
    return out.with_(meta=_marked(out, "sources.next_id", source + 1)), novel


def next_priorities(sources: DataFrame) -> DataFrame:
    return sources.groupBy("novel_id").agg((F.coalesce(F.max("priority"), F.lit(0)) + 1).alias("next_priority"))


def add_source(lib: Library, novel_id: int, source_name: str, url: str, now) -> Library:
    """Behind the others. A title with unfilled gaps goes back to backfilling."""
    if not lib.sources.filter(F.col("url") == url).isEmpty():
        raise LibraryError(f"already a source: {url}")
    row = next_priorities(lib.sources.filter(F.col("novel_id") == novel_id)).first()
    source = _next_id(lib, lib.sources, "sources.next_id")
    out = lib.with_(sources=_append(lib.sources, (source, novel_id, source_name, url, row["next_priority"] if row else 1, None, None)))
    out = out.with_(meta=_marked(out, "sources.next_id", source + 1))
    if not unfilled_gaps(lib.chapter_gaps.filter(F.col("novel_id") == novel_id), lib.chapters).isEmpty():
        hit = F.col("id") == novel_id
        out = out.with_(novels=out.novels.withColumn("derived_state", F.when(hit, "backfilling").otherwise(F.col("derived_state"))).withColumn("updated_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))))
    return out


def reorder(sources: DataFrame, chosen: Column) -> DataFrame:
    """Priorities by novel: the chosen source first, the others behind it in their order."""
    w = Window.partitionBy("novel_id").orderBy(F.when(chosen, 0).otherwise(1), "priority")
    return sources.withColumn("priority", F.row_number().over(w).cast("bigint"))


def promote_source(lib: Library, novel_id: int, source_id: int) -> Library:
    """Makes a source the primary; what was held from the old primary counts as its own, so that nothing is fetched again."""
    own = lib.sources.filter(F.col("novel_id") == novel_id)
    rows = {r["id"]: r["priority"] for r in own.select("id", "priority").collect()}  # one novel's sources
    if source_id not in rows:
        raise LibraryError(f"source {source_id} is not one of novel {novel_id}")
    old = min(rows, key=rows.get)
    if old == source_id:
        return lib
    moved = reorder(own, F.col("id") == source_id).unionByName(lib.sources.filter(F.col("novel_id") != novel_id))
    mine = (F.col("novel_id") == novel_id) & (F.col("source_id") == old)
    return lib.with_(sources=moved, chapters=lib.chapters.withColumn("source_id", F.when(mine, F.lit(source_id).cast("bigint")).otherwise(F.col("source_id"))))


def resolve_source(lib: Library, novel_id: int, arg: str) -> int:
    """A source by its URL, or else by its name, case aside; one that is not clear is refused."""
    own = lib.sources.filter(F.col("novel_id") == novel_id)
    found = own.filter(F.col("url") == arg).collect() or own.filter(ascii_lower(F.col("source_name")) == arg.lower()).orderBy("priority").collect()
    if len(found) == 1:
        return found[0]["id"]
    options = ", ".join(f"{r['source_name']} ({r['url']})" for r in own.orderBy("priority").collect())
    raise LibraryError(f"'{arg}' matches {len(found)} sources; there are {options}")


def repoint_source(lib: Library, source_id: int, source_name: str, url: str) -> Library:
    """Another URL under the same id."""
    if not lib.sources.filter((F.col("url") == url) & (F.col("id") != source_id)).isEmpty():
        raise LibraryError(f"another source has {url}")
    hit = F.col("id") == source_id
    return lib.with_(sources=lib.sources.withColumn("url", F.when(hit, url).otherwise(F.col("url"))).withColumn("source_name", F.when(hit, source_name).otherwise(F.col("source_name"))))


def insert_absent(chapters: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters with those of ``new`` that were not there, and these."""
    added = new.join(chapters.select(*KEY), KEY, "left_anti").dropDuplicates(KEY).select(*chapters.columns)
    return chapters.unionByName(added), added


def retitle(chapters: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New titles (n_title by novel and number) where they differ; those chapters are to be exported again. Also returns them."""
    met = chapters.join(titles.select(*KEY, "n_title"), KEY, "left").withColumn("hit", F.coalesce(F.col("n_title") != F.col("title"), F.lit(False)))
    new = {"title": F.when(F.col("hit"), F.col("n_title")).otherwise(F.col("title")), "exported": F.col("exported") & ~F.col("hit"), "exported_at": F.when(~F.col("hit"), F.col("exported_at"))}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in chapters.columns]), met.filter("hit").select(*KEY, "n_title")


def primary_titles(chapters: DataFrame, sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """novel_id, number and n_title of stored chapters whose primary source could be read again; others keep their titles."""
    primary = sources.groupBy("novel_id").agg(F.min_by("id", "priority").alias("source_id"))
    read = fetched.filter("outcome = 'ok' AND title IS NOT NULL").join(primary, ["novel_id", "source_id"], "left_semi")
    return read.select(*KEY, F.col("title").alias("n_title")).join(chapters.select(*KEY), KEY, "left_semi")


def retitle_pass(chapters: DataFrame, sources: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters with the titles that their primary sources have now, and which of them changed."""
    return retitle(chapters, primary_titles(chapters, sources, fetched))


def record_gaps(gaps: DataFrame, new: DataFrame, now) -> DataFrame:
    return gaps.unionByName(new.select(*KEY).distinct().join(gaps.select(*KEY), KEY, "left_anti").withColumn("detected_at", F.lit(now).cast("timestamp")))


def clear_gaps(gaps: DataFrame, filled: DataFrame) -> DataFrame:
    return gaps.join(filled.select(*KEY), KEY, "left_anti")


def refresh_metadata(novels: DataFrame, meta: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """author, cover, genre and label as seen now, nulls too; the title stays. Also returns the authors that changed."""
    got = meta.select(F.col("novel_id").alias("id"), F.col("author").alias("n_author"), F.col("cover_url").alias("n_cover"), F.col("genre").alias("n_genre"), F.col("status_hint").alias("n_hint"), F.lit(True).alias("hit"))
    met = novels.join(got, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    pick = lambda n, c: F.when(F.col("hit"), F.col(n)).otherwise(F.col(c))
    new = {"author": pick("n_author", "author"), "cover_url": pick("n_cover", "cover_url"), "genre": pick("n_genre", "genre"), "status_hint": pick("n_hint", "status_hint"), "updated_at": F.when(F.col("hit"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    changed = met.filter(F.col("hit") & ~F.col("author").eqNullSafe(F.col("n_author"))).select("id", F.col("author").alias("was"), F.col("n_author").alias("now"))
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in novels.columns]), changed


def mark_exported(chapters: DataFrame, novels: DataFrame, now) -> DataFrame:
    """All chapters of these novels (novel_id) as exported now, those that were so before too."""
    met = chapters.join(novels.select("novel_id").distinct().withColumn("hit", F.lit(True)), "novel_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    new = {"exported": F.col("exported") | F.col("hit"), "exported_at": F.when(F.col("hit"), F.lit(now).cast("timestamp")).otherwise(F.col("exported_at"))}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in chapters.columns])


def unsubscribe(lib: Library, novel_id: int) -> Library:
    """The novel and all that hangs on it. Its id is not given again."""
    rest = lambda df: df.filter(F.col("novel_id") != novel_id)
    out = lib.with_(meta=_marked(lib, HIGH_WATER, _next_id(lib, lib.novels, HIGH_WATER)))
    return out.with_(novels=lib.novels.filter(F.col("id") != novel_id), sources=rest(lib.sources), chapters=rest(lib.chapters), chapter_gaps=rest(lib.chapter_gaps))


def repair_targets(chapters: DataFrame, most: int = STUB_MAX_CHARS) -> DataFrame:
    """Short chapters (a cheap test first) that are gates in place of prose."""
    return chapters.filter(F.char_length("body") < most).filter(is_gate_stub(F.array_join(split_body(F.col("body")), " ")))


def repair_plan(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """novel_id, number, outcome (repaired or skipped), reason and the copy to take, for each target.

    candidates: novel_id, number, source_id, priority, outcome, title and
    paragraphs. The first by priority is taken that is no gate and longer than
    what is held; if none is, the reason is that of the last one refused.
    """
    new = F.array_join("paragraphs", " ")
    met = targets.select(*KEY, F.char_length(F.array_join(split_body(F.col("body")), " ")).alias("held")).join(candidates, KEY, "left")
    reason = F.when(F.col("source_id").isNull(), "no source lists it").when(F.col("outcome") != "ok", F.concat(F.lit("fetch: "), F.col("outcome"))).when(is_gate_stub(new), "placeholder").when(F.char_length(new) <= F.col("held"), "not longer than what is held")
    met = met.withColumn("reason", reason)
    copy = F.struct("priority", "source_id", "title", "paragraphs")
    out = met.groupBy(*KEY).agg(F.min_by(F.when(F.col("reason").isNull(), copy), F.when(F.col("reason").isNull(), F.col("priority"))).alias("took"), F.max_by("reason", F.struct(F.coalesce("priority", F.lit(0)), "reason")).alias("reason"))
    good = F.col("took").isNotNull()
    return out.select(*KEY, F.when(good, "repaired").otherwise("skipped").alias("outcome"), F.when(~good, F.col("reason")).alias("reason"), F.col("took.source_id").alias("n_source"), F.col("took.title").alias("n_title"), F.array_join("took.paragraphs", "\n\n").alias("n_body"))


def repair(chapters: DataFrame, plan: DataFrame, dry_run: bool = False) -> DataFrame:
    if dry_run:
        return chapters
    return replace_content(chapters, plan.filter("outcome = 'repaired'").select(*KEY, "n_source", "n_title", "n_body"))


def migration_plan(sources: DataFrame, novels: DataFrame, catalogue: DataFrame, old_host: str, url_of) -> DataFrame:
    """What becomes of each source on a host that went away: moved, not_found or undetermined.

    catalogue: slug, title and reachable (false: that lookup failed and says
    nothing). A source moves to the entry at its slug if its title agrees, or
    else to one of its novel's title; another title at the slug is no match. A
    new URL that another row has, or a lookup that failed, decides nothing.
    """
    mine = sources.filter(bare_host(F.col("url")) == old_host).join(novels.select(F.col("id").alias("novel_id"), "title"), "novel_id")
    mine = mine.select(F.col("id").alias("source_id"), "novel_id", "url", "priority", slug(F.col("url")).alias("slug"), normalize_title(F.col("title")).alias("key"))
    cat = catalogue.select(F.col("slug").alias("c_slug"), normalize_title(F.col("title")).alias("c_key"), F.coalesce("reachable", F.lit(True)).alias("reachable"))
    at_slug = cat.groupBy(F.col("c_slug").alias("slug")).agg(F.first("c_key").alias("slug_key"), F.bool_and("reachable").alias("reachable"))
    by_title = cat.filter("reachable").groupBy(F.col("c_key").alias("key")).agg(F.min("c_slug").alias("title_slug"))
    met = mine.join(at_slug, "slug", "left").join(by_title, "key", "left")
    direct = F.coalesce((F.col("slug_key") == F.col("key")) & F.col("reachable"), F.lit(False))
    to = F.when(direct, F.col("slug")).otherwise(F.col("title_slug"))
    met = met.withColumn("to", to).withColumn("new_url", F.when(F.col("to").isNotNull(), url_of(F.col("to")))).withColumn("via_title_search", ~direct & F.col("to").isNotNull())
    taken = sources.select(F.col("url").alias("new_url"), F.col("id").alias("taken_by"))
    met = met.join(taken, "new_url", "left")
    failed = F.col("slug").isNull() | ~F.coalesce("reachable", F.lit(True)) | (F.col("taken_by").isNotNull() & (F.col("taken_by") != F.col("source_id")))
    outcome = F.when(failed, "undetermined").when(F.col("to").isNotNull(), "moved").otherwise("not_found")
    return met.select("source_id", "novel_id", "url", outcome.alias("outcome"), F.when(outcome == "moved", F.col("new_url")).alias("new_url"), F.when(outcome == "moved", F.col("via_title_search")).otherwise(F.lit(False)).alias("via_title_search"), "priority")


def apply_migration(lib: Library, plan: DataFrame, new_name: str) -> Library:
    """Moves sources in place; where a primary is gone, the next source that is alive becomes primary."""
    moved = plan.filter("outcome = 'moved'").select(F.col("source_id").alias("id"), "new_url")
    src = lib.sources.join(moved, "id", "left")
    src = src.withColumn("source_name", F.when(F.col("new_url").isNotNull(), new_name).otherwise(F.col("source_name"))).withColumn("url", F.coalesce("new_url", "url")).select(*lib.sources.columns)
    dead = plan.filter("outcome = 'not_found'").select(F.col("source_id").alias("id"), F.lit(True).alias("dead"))
    met = src.join(dead, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    first = Window.partitionBy("novel_id").orderBy("priority").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.min_by("id", F.when(~F.col("dead"), F.col("priority"))).over(Window.partitionBy("novel_id"))
    met = met.withColumn("old", F.first("id").over(first)).withColumn("old_dead", F.first("dead").over(first)).withColumn("lead", lead)
    met = met.withColumn("chosen", F.when(F.col("old_dead") & F.col("lead").isNotNull(), F.col("lead")).otherwise(F.col("old")))
    new = reorder(met, F.col("id") == F.col("chosen"))
    swaps = met.filter("old <> chosen").select("novel_id", F.col("old").alias("source_id"), "chosen").distinct()
    held = lib.chapters.join(swaps, ["novel_id", "source_id"], "left").withColumn("source_id", F.coalesce("chosen", "source_id")).select(*lib.chapters.columns)
    return lib.with_(sources=new.select(*lib.sources.columns), chapters=held)
