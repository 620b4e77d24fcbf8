"""The library's tables, changes to them, lifecycle, repair, migration and export."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from serialloom.operators import export, gaps, lifecycle, maintenance, reports
from serialloom.sources import config
from serialloom.sources.library import Library, LibraryError, open_library, same_title, save_library, select_novel, violations

T0, NOW = dt.datetime(2001, 1, 1), dt.datetime(2001, 12, 1)
STUB = "This chapter requires a free account to read."


@pytest.fixture
def lib(spark):
    return Library.of(
        spark,
        novels=[(1, "First", "Ann", None, None, "ongoing", "live", False, T0, T0), (5, "Second", "Bo", None, None, "completed", "likely_complete", False, T0, T0)],
        sources=[(1, 1, "a", "u1", 1, None, None), (2, 5, "b", "u2", 1, 3, T0), (3, 1, "c", "u3", 2, None, None), (4, 1, "d", "u4", 3, None, None)],
        chapters=[(1, 1, "t", "real text", 1, T0, False, None), (5, 1, "t", "x", 2, T0, True, T0), (5, 2, "t", STUB, 2, T0, True, T0)],
        chapter_gaps=[(5, 3, T0), (5, 2, T0)],
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_snapshots(lib, spark, tmp_path):
    assert rows(open_library(spark, str(tmp_path)).novels, "id") == []
    save_library(lib, str(tmp_path))
    again = open_library(spark, str(tmp_path))
    assert rows(again.novels, "id", "title") == [(1, "First"), (5, "Second")]
    assert rows(gaps.unfilled_gaps(again.chapter_gaps, again.chapters), "novel_id", "number") == [(5, 3)]
    save_library(maintenance.unsubscribe(again, 5), str(tmp_path))
    assert rows(open_library(spark, str(tmp_path)).chapters, "novel_id") == [(1,)]


def test_a_bad_snapshot_is_refused(lib, tmp_path):
    bad = lib.with_(sources=lib.sources.unionByName(lib.sources.withColumn("id", F.col("id") + 10)))
    assert violations(bad).filter("n > 0").collect()[0].rule == "sources.url is unique"
    with pytest.raises(LibraryError):
        save_library(bad, str(tmp_path))


def test_subscribe_and_ids(lib):
    out, new = maintenance.subscribe(lib, "Third", "a", "u9", NOW)
    assert new == 6
    gone = maintenance.unsubscribe(out, 6)
    _, again = maintenance.subscribe(gone, "Fourth", "a", "u9", NOW)
    assert again == 7
    for args in (("X", "a", "u1"), ("first", "a", "u10", NOW, "Ann")):
        with pytest.raises(LibraryError):
            maintenance.subscribe(lib, *args, *([NOW] if len(args) == 3 else []))
    with pytest.raises(LibraryError):
        maintenance.subscribe(lib, "fi-rst", "a", "u11", NOW, force=False)
    assert rows(same_title(lib.novels, "FIRST!"), "id") == [(1,)]


def test_selectors(lib):
    assert rows(select_novel(lib.novels, "5"), "id") == [(5,)]
    assert rows(select_novel(lib.novels, "sEcond"), "id") == [(5,)]
    assert rows(select_novel(lib.novels, "other"), "id") == []


def test_sources(lib):
    out = maintenance.add_source(lib, 5, "n", "u8", NOW)
    assert rows(out.sources.filter("novel_id = 5"), "priority", "url") == [(1, "u2"), (2, "u8")]
    assert rows(out.novels, "id", "derived_state")[1] == (5, "backfilling")
    done = maintenance.promote_source(lib, 1, 4)
    assert rows(done.sources.filter("novel_id = 1"), "priority", "source_name") == [(1, "d"), (2, "a"), (3, "c")]
    assert rows(done.chapters.filter("novel_id = 1"), "source_id") == [(4,)]
    assert maintenance.promote_source(lib, 1, 1) is lib
    with pytest.raises(LibraryError):
        maintenance.promote_source(lib, 1, 2)
    assert maintenance.resolve_source(lib, 1, "C") == 3 and maintenance.resolve_source(lib, 1, "u4") == 4
    with pytest.raises(LibraryError, match="matches 0 sources"):
        maintenance.resolve_source(lib, 1, "zzz")
    with pytest.raises(LibraryError):
        maintenance.repoint_source(lib, 3, "x", "u1")


def test_chapter_changes(lib):
    new = lib.chapters.filter("novel_id = 1").unionByName(lib.chapters.filter("novel_id = 1").withColumn("number", F.lit(2).cast("bigint")))
    merged, added = maintenance.insert_absent(lib.chapters, new)
    assert rows(added, "number") == [(2,)] and merged.count() == 4
    titles = lib.chapters.select("novel_id", "number", F.when(F.col("number") == 2, "new").otherwise("t").alias("n_title"))
    out, hit = maintenance.retitle(lib.chapters, titles)
    assert rows(hit, "novel_id", "number") == [(5, 2)]
    assert rows(out.filter("number = 2"), "title", "exported") == [("new", False)]
    assert rows(maintenance.record_gaps(lib.chapter_gaps, lib.chapters, NOW), "novel_id", "number") == [(1, 1), (5, 1), (5, 2), (5, 3)]


def test_metadata(lib, spark):
    meta = spark.createDataFrame([(1, None, "c", None, "completed")], "novel_id bigint, author string, cover_url string, genre string, status_hint string")
    out, changed = maintenance.refresh_metadata(lib.novels, meta, NOW)
    assert rows(changed, "id", "was", "now") == [(1, "Ann", None)]
    assert out.filter("id = 1").first().status_hint == "completed"


def test_lifecycle(lib):
    assert rows(lifecycle.purged(lib.chapters, lib.novels, NOW), "novel_id", "number") == [(5, 1), (5, 2)]
    assert rows(lifecycle.retain(lib.chapters, lib.novels, NOW), "novel_id") == [(1,)]
    assert lifecycle.purged(lib.chapters, lib.novels, T0 + dt.timedelta(days=29)).isEmpty()
    live = lifecycle.set_state(lib.novels, [5], "live", T0)
    assert rows(lifecycle.reevaluate(live, lib.chapters, NOW), "id", "derived_state") == [(1, "live"), (5, "likely_complete")]
    assert rows(lifecycle.reevaluate(live, lib.chapters, T0), "id", "derived_state") == [(1, "live"), (5, "live")]
    assert rows(lifecycle.due(lib.novels, lib.sources, T0 + dt.timedelta(days=6)), "id") == [(1,)]
    assert rows(lifecycle.due(lib.novels, lib.sources, T0 + dt.timedelta(days=7)), "id") == [(1,), (5,)]


def test_repair(lib, spark):
    targets = maintenance.repair_targets(lib.chapters)
    assert rows(targets, "novel_id", "number") == [(5, 2)]
    cand = lambda *r: spark.createDataFrame(list(r), "novel_id bigint, number bigint, source_id bigint, priority bigint, outcome string, title string, paragraphs array<string>")
    real = "A real chapter that is a good deal longer than the gate was, as chapters are."
    plan = maintenance.repair_plan(targets, cand((5, 2, 8, 1, "ok", "t", [STUB + STUB]), (5, 2, 9, 2, "ok", "t", [real])))
    assert rows(plan, "outcome", "n_source") == [("repaired", 9)]
    fixed = maintenance.repair(lib.chapters, plan)
    assert rows(fixed.filter("number = 2"), "body", "exported") == [(real, False)]
    assert maintenance.repair(lib.chapters, plan, dry_run=True) is lib.chapters
    assert rows(maintenance.repair_plan(targets, cand((5, 2, 8, 1, "ok", "t", [STUB]))), "outcome", "reason") == [("skipped", "placeholder")]
    assert rows(maintenance.repair_plan(targets, cand((5, 2, 8, 1, "ok", "t", ["short"]))), "reason") == [("not longer than what is held",)]
    assert rows(maintenance.repair_plan(targets, cand()), "reason") == [("no source lists it",)]


def test_migration(spark):
    novel = lambda i, t: (i, t, None, None, None, "unknown", "live", False, T0, T0)
    lib = Library.of(
        spark,
        novels=[novel(1, "Alpha"), novel(2, "Beta"), novel(3, "Gamma"), novel(4, "Delta"), novel(5, "Eps")],
        sources=[(i, i, "old", f"https://www.old.x/novel/{s}", 1, None, None) for i, s in ((1, "alpha"), (2, "bet"), (3, "gamma"), (4, "delta"), (5, "eps"))] + [(6, 3, "alive", "https://z.x/g", 2, None, None)],
        chapters=[(3, 1, "t", "x", 3, T0, False, None)],
    )
    cat = spark.createDataFrame([("alpha", "ALPHA", True), ("beta", "beta!", True), ("gamma", "Other Book", True), ("eps", None, False)], "slug string, title string, reachable boolean")
    plan = maintenance.migration_plan(lib.sources, lib.novels, cat, "old.x", lambda s: F.concat(F.lit("https://new.x/novel/"), s))
    assert rows(plan, "source_id", "outcome", "via_title_search") == [(1, "moved", False), (2, "moved", True), (3, "not_found", False), (4, "not_found", False), (5, "undetermined", False)]
    out = maintenance.apply_migration(lib, plan, "new")
    got = {r.id: (r.url, r.priority) for r in out.sources.collect()}
    assert got[1] == ("https://new.x/novel/alpha", 1) and got[2][0] == "https://new.x/novel/beta"
    assert got[6][1] == 1 and got[3][1] == 2 and got[4][1] == 1
    assert rows(out.chapters, "source_id") == [(6,)]


def test_reports(lib):
    line = reports.subscription_lines(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps).orderBy("novel_id").collect()
    assert line[0].line == "#1  First — Ann  [1 chapters, live]" and line[0].gap_line is None
    assert line[1].gap_line == "1 unavailable at source (404): ch. 3"
    assert line[1].source_lines == ["[primary] b — u2 (last seen ch.3)"]
    assert reports.subscription_lines(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps, gaps_only=True).count() == 1


def test_books(lib, tmp_path):
    docs = export.book_documents(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps)
    got = export.write_books(docs, str(tmp_path)).collect()
    assert sorted((r.path, r.chapters) for r in got) == [("Ann/First/First.epub", 1), ("Bo/Second/Second.epub", 2)]
    with zipfile.ZipFile(tmp_path / "Bo/Second/Second.epub") as z:
        assert z.namelist()[0] == "mimetype"
        assert "<p>By number: 3</p>" in z.read("OEBPS/missing.xhtml").decode()
        assert "<h1>Chapter 1: t</h1>" in z.read("OEBPS/chapter_00001.xhtml").decode()
    vols = export.volumes(lib.chapters, 1)
    assert rows(vols, "novel_id", "volume") == [(1, 1), (5, 1), (5, 2)]


def test_numbering(spark):
    e = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 0), (1, 2, "c", 1)], "novel_id bigint, pos bigint, title string, visible int")
    assert rows(gaps.number_visible(e), "number", "title") == [(1, "a"), (2, "c")]
    assert rows(gaps.number_reversed(e, 5), "number", "title") == [(5, "c"), (6, "b"), (7, "a")]
    d = spark.createDataFrame([(1, 1, 0, 7, "x"), (1, 1, 1, 7, "y")], "novel_id bigint, source_id bigint, pos bigint, number bigint, title string")
    assert rows(gaps.dedupe(d, last=False), "title") == [("x",)] and rows(gaps.dedupe(d, last=True), "title") == [("y",)]
    n = spark.createDataFrame([(1, 2), (2, 0)], "novel_id bigint, n int")
    assert rows(gaps.generated(n, lambda k: F.concat(F.lit("u"), k.cast("string"))), "novel_id", "url") == [(1, "u1"), (1, "u2")]


def test_config_and_profiles(spark, tmp_path):
    c = config.read_config("retention_days = 5\nauto_export = no\npoll_interval_mins = x\n")
    assert (c.retention_days, c.auto_export, c.poll_interval_mins) == (5, False, 60)
    assert config.read_config(config.write_config(c)) == c
    (tmp_path / "a.ini").write_text("name = A\nhost = A.org\nchapter_marker = chapter-\n")
    (tmp_path / "b.ini").write_text("name = B\n")
    with pytest.warns(UserWarning, match="b.ini"):
        got = config.profiles(spark, str(tmp_path))
    assert rows(got, "name", "host", "max_toc_pages") == [("A", "a.org", 500)]


def test_books_with_equal_names_stay_apart(spark, tmp_path):
    from serialloom.operators.export import write_books

    rows = [("a/b.epub", n, "B", "A", 1, "c.xhtml", "h", "<p/>") for n in (1, 2)] + [("a/c.epub", 3, "C", "A", 1, "c.xhtml", "h", "<p/>")]
    docs = spark.createDataFrame(rows, "path string, novel_id bigint, title string, author string, place bigint, file string, heading string, xhtml string")
    got = {r.path: r.chapters for r in write_books(docs, str(tmp_path)).collect()}
    assert got == {"a/b (1).epub": 1, "a/b (2).epub": 1, "a/c.epub": 1}


def test_listings(lib, spark):
    status = {r.novel_id: (r.line, r.gap_line) for r in reports.status_lines(lib.novels, lib.sources, lib.chapters, lib.chapter_gaps).collect()}
    assert status == {1: ("#1 First — 1 chapters [live]", None), 5: ("#5 Second — 2 chapters [likely_complete]", "gaps: 3")}
    seen = spark.createDataFrame([(1, 1, 0, 4, "d"), (1, 1, 1, 2, "b"), (1, 1, 2, 2, "again"), (1, 1, 3, 4, "late")], "novel_id bigint, source_id bigint, pos bigint, number bigint, title string")
    assert reports.list_lines(reports.list_ends(seen)).first().lines == ["2 chapters discovered.", "  first: ch.2 b", "  last:  ch.4 d"]
    told = {r.key: r.value for r in reports.config_lines(spark, config.Config(retention_days=4)).collect()}
    assert told["retention_days"] == "4" and told["auto_export"] == "True" and len(told) == 10
    many = spark.createDataFrame([(1, n, T0) for n in range(40, 20, -1)], "novel_id bigint, number bigint, detected_at timestamp")
    assert reports.gap_summary(many, 3).first().listed == "21, 22, 23, … (+17 more)"


def test_stored_against_remote(spark):
    stored = spark.createDataFrame([(1, n) for n in (*range(1, 6), 3000, 3001, 9000)] + [(2, 1)], "novel_id bigint, number bigint")
    remote = spark.createDataFrame([(1, n) for n in (2, 4, 5, 3000, 3001, 9999, 2)] + [(2, 7), (3, 1)], "novel_id bigint, number bigint")
    got = {r.novel_id: tuple(r)[1:] for r in reports.stored_against_remote(stored, remote).collect()}
    assert got == {1: (8, 5, 3, 9000, 9999, [2, 5, 3001]), 2: (1, 0, 1, 1, 7, None), 3: (0, 0, 0, None, 1, None)}
    text = "novel_id bigint, number bigint, paragraphs array<string>"
    mine = spark.createDataFrame([(1, 2, ["Same.", "b"]), (1, 5, ["Log in to continue"]), (1, 3001, ["mine", "c"])], text)
    theirs = spark.createDataFrame([(1, 2, ["same", "B!"]), (1, 5, ["real prose"]), (1, 3001, ["theirs", "c", "d"]), (1, 4, ["x"])], text)
    said = reports.compare_samples(reports.stored_against_remote(stored, remote), mine, theirs)
    assert rows(said, "number", "verdict") == [(2, "same"), (5, "stub"), (3001, "different")]


def test_retitle_pass(lib, spark):
    seen = spark.createDataFrame([(1, 1, 1, "ok", "New"), (5, 2, 1, "ok", "t"), (5, 2, 2, "not_found", None), (1, 3, 1, "ok", "of a fallback"), (1, 1, 9, "ok", "not held")], "novel_id bigint, source_id bigint, number bigint, outcome string, title string")
    out, changed = maintenance.retitle_pass(lib.chapters, lib.sources, seen)
    assert rows(changed, "novel_id", "number", "n_title") == [(1, 1, "New")]
    assert rows(out, "novel_id", "number", "title") == [(1, 1, "New"), (5, 1, "t"), (5, 2, "t")]


def test_a_task_gets_no_more_lines_as_the_table_grows(spark, tmp_path, monkeypatch):
    from serialloom.plans import adapters, library

    spark.range(900).selectExpr("id % 300 AS l_orderkey", "id % 7 AS l_suppkey", "CAST(id % 5 AS INT) AS l_linenumber", "id AS l_partkey", "TIMESTAMP '2000-01-01' AS l_shipdate", "'F' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "TIMESTAMP '2000-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(adapters, "_DEALT", 10)
    lines = lambda: adapters.dealt(spark, str(tmp_path), "lineitem", "l_orderkey", ["l_orderkey"])
    assert lines().rdd.getNumPartitions() == 90
    for query in (library.list_ends, library.remote_samples, library.novel_metadata, library.sources_by_url):
        out = query(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        # lines are grouped where they were dealt; the first three need no other exchange of them
        assert "(l_orderkey" in "".join(x.split("hashpartitioning")[1] for x in dealt) and all(", 90)" in x for x in dealt if "l_orderkey" in x)
        if query in (library.list_ends, library.remote_samples):
            assert len(dealt) == (1 if query is library.list_ends else 2)
        assert out.count() > 0
