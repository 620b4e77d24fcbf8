"""Passes over a library on disk: what they write, what they count, and what happens to two at once."""

import datetime as dt
import glob
import json
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from serialloom.operators import passes
from serialloom.sources import ledger, rebuild
from serialloom.sources.library import Library, open_library, save_library
from serialloom.sources.schemas import SCHEMA, TABLES

T0, NOW = dt.datetime(2001, 1, 1), dt.datetime(2001, 12, 1)


def chapter(novel, number, body="x", exported=False, title="t"):
    return (novel, number, title, body, novel, T0, exported, T0 if exported else None)


@pytest.fixture(scope="module")
def first_version(spark, tmp_path_factory):
    novels = [(i, f"N{i}", "Ann", None, None, "completed", "likely_complete" if i > 30 else "live", i == 3, T0, T0) for i in range(1, 41)]
    sources = [(i, i, "a", f"u{i}", 1, None, None) for i in range(1, 41)]
    chapters = [chapter(i, n, exported=i % 2 == 0) for i in range(1, 41) for n in range(1, 6)]
    lib = Library.of(spark, novels=novels, sources=sources, chapters=chapters, chapter_gaps=[(7, 9, T0), (8, 9, T0)])
    where = str(tmp_path_factory.mktemp("first") / "lib")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share a file
    save_library(lib, where)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return where


@pytest.fixture
def folder(first_version, tmp_path):
    shutil.copytree(first_version, tmp_path / "lib")
    return str(tmp_path / "lib")


def new_chapters(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["chapters"])


def written(folder, version):
    [head, *actions] = [json.loads(x) for x in open(f"{folder}/log/{version:012d}.json")]
    return [a for a in actions if not a.get("gone")], [a for a in actions if a.get("gone")]


def test_an_append_writes_its_rows_and_no_more(spark, folder):
    new = new_chapters(spark, *[chapter(40, n) for n in range(1, 16)], chapter(40, 15, "twice"))
    version, n = ledger.run_pass(spark, folder, lambda p: passes.insert_chapters(p, new), "poll")
    assert (version, n) == (2, 10)
    made, gone = written(folder, 2)
    assert not gone and {a["table"] for a in made} == {"chapters"} and sum(a["rows"] for a in made) == 10
    assert sum(pq.read_metadata(f"{folder}/{a['path']}").num_rows for a in made) == 10
    assert open_library(spark, folder).chapters.count() == 210
    assert open_library(spark, folder, 1).chapters.count() == 200  # the version before is still there
    again, n = ledger.run_pass(spark, folder, lambda p: passes.insert_chapters(p, new))
    assert n == 0 and open_library(spark, folder).chapters.count() == 210


def test_the_second_of_two_writers_is_refused(spark, folder):
    first, second = ledger.begin(spark, folder), ledger.begin(spark, folder)
    passes.insert_chapters(first, new_chapters(spark, chapter(1, 50)))
    passes.insert_chapters(second, new_chapters(spark, chapter(1, 50, "other"), chapter(2, 50)))
    assert first.commit() == 2
    with pytest.raises(ledger.ConflictError):
        second.commit()
    got = open_library(spark, folder).chapters.filter("number = 50").collect()
    assert [(r.novel_id, r.body) for r in got] == [(1, "x")]


def test_a_refused_pass_is_tried_again_on_the_new_version(spark, folder):
    turns = []

    def work(p):
        turns.append(p.base.number)
        if len(turns) == 1:  # another pass comes first
            ledger.run_pass(spark, folder, lambda q: passes.insert_chapters(q, new_chapters(spark, chapter(1, 50))))
        return passes.insert_chapters(p, new_chapters(spark, chapter(1, 50, "other"), chapter(2, 50)))

    version, n = ledger.run_pass(spark, folder, work)
    assert (turns, version, n) == ([1, 2], 3, 1)
    assert sorted((r.novel_id, r.body) for r in open_library(spark, folder).chapters.filter("number = 50").collect()) == [(1, "x"), (2, "x")]


def test_a_change_rewrites_the_files_that_hold_its_rows(spark, folder):
    files = ledger.version_at(spark, folder).of("chapters")
    assert len(files) > 2 and sum(f.rows for f in files) == 200
    assert all(a.hi <= b.lo for a, b in zip(sorted(files, key=lambda f: f.lo), sorted(files, key=lambda f: f.lo)[1:], strict=False))
    fresh = spark.createDataFrame([(5, 2, None, "better", 77), (5, 99, "t", "none there", 77)], "novel_id bigint, number bigint, n_title string, n_body string, n_source bigint")
    version, n = ledger.run_pass(spark, folder, lambda p: passes.replace_content(p, fresh))
    assert n == 1
    made, gone = written(folder, version)
    assert [a["path"] for a in gone] == [f.path for f in files if f.lo <= 5 <= f.hi and any(r == (5, 2) for r in zip(*pq.read_table(f"{folder}/{f.path}", columns=["novel_id", "number"]).to_pydict().values(), strict=True))]
    row = open_library(spark, folder).chapters.filter("novel_id = 5 AND number = 2").first()
    assert (row.title, row.body, row.source_id, row.exported, row.exported_at, row.fetched_at) == ("t", "better", 77, False, None, T0)


def test_counts_of_changes(spark, folder):
    titles = spark.createDataFrame([(1, 1, "t"), (1, 2, "new"), (2, 2, "new"), (99, 1, "new")], "novel_id bigint, number bigint, n_title string")
    some = spark.createDataFrame([(3,), (4,), (4,)], "novel_id bigint")

    def work(p):
        out = [passes.retitle(p, titles), passes.mark_exported(p, some, NOW), passes.clear_gaps(p, spark.createDataFrame([(7, 9), (7, 10)], "novel_id bigint, number bigint"))]
        out += [passes.record_gaps(p, spark.createDataFrame([(8, 9), (8, 10), (8, 10)], "novel_id bigint, number bigint"), NOW), passes.set_pending(p, some)]
        return [*out, passes.repoint_source(p, 6, "b", "u66"), passes.apply_retention(p, NOW), passes.reevaluate(p, NOW)]

    _, counts = ledger.run_pass(spark, folder, work)
    assert counts == [2, 10, 1, 1, 2, 1, 25, 30]
    lib = open_library(spark, folder)
    assert lib.chapters.count() == 175 and lib.chapters.filter("novel_id IN (3, 4) AND exported AND exported_at = '2001-12-01'").count() == 10
    assert sorted((r.novel_id, r.number) for r in lib.chapter_gaps.collect()) == [(8, 9), (8, 10)]
    assert lib.sources.filter("id = 6").first().url == "u66" and lib.novels.filter("export_pending").count() == 2


def test_unsubscribing_counts_and_keeps_the_mark(spark, folder):
    _, gone = ledger.run_pass(spark, folder, lambda p: passes.unsubscribe(p, 40))
    assert gone == {"novels": 1, "sources": 1, "chapters": 5, "chapter_gaps": 0}
    lib = open_library(spark, folder)
    assert lib.novels.count() == 39 and lib.meta.filter("key = 'novels.next_id'").first().value == "41"
    with pytest.raises(ledger.LedgerError, match="no novel 40"):
        passes.unsubscribe(ledger.begin(spark, folder), 40)


def test_rules_are_kept_and_a_refused_pass_changes_nothing(spark, folder):
    def refused(rule, work):
        with pytest.raises(ledger.LedgerError, match=rule):
            ledger.run_pass(spark, folder, work)

    refused("url is unique", lambda p: passes.repoint_source(p, 6, "b", "u7"))
    refused("chapters: novel_id, number", lambda p: p.append("chapters", new_chapters(spark, chapter(1, 1, "again"))))
    refused("chapters have a novel", lambda p: p.append("chapters", new_chapters(spark, chapter(999, 1))))
    refused("have a novel", lambda p: p.delete("novels", spark.createDataFrame([(4,)], "id bigint"), ["id"]))
    assert ledger.version_at(spark, folder).number == 1 and open_library(spark, folder).chapters.count() == 200


def test_full_lists_history_and_vacuum(spark, folder, monkeypatch):
    monkeypatch.setattr(ledger, "FULL_EVERY", 3)
    for k in range(5):
        ledger.run_pass(spark, folder, lambda p, k=k: passes.insert_chapters(p, new_chapters(spark, chapter(1, 100 + k))), f"turn {k}")
    assert sorted(x for x in os.listdir(f"{folder}/log") if x.endswith(".full.json")) == ["000000000003.full.json", "000000000006.full.json"]
    for old in (2, 4):
        assert open_library(spark, folder, old).chapters.count() == 199 + old
    os.remove(f"{folder}/log/000000000001.json")  # not needed behind a full list
    with pytest.raises(ledger.LedgerError, match="no version 1"):
        open_library(spark, folder, 1)
    assert open_library(spark, folder).chapters.count() == 205
    told = {(r.version, r.table): (r.what, r.added, r.removed, r.rows) for r in ledger.history(spark, folder).collect()}
    assert told[4, "chapters"] == ("turn 2", 1, 0, 1)
    lost = ledger.begin(spark, folder)  # a pass that dies leaves files
    passes.insert_chapters(lost, new_chapters(spark, chapter(1, 999)))
    ledger.run_pass(spark, folder, lambda p: p.replace("chapters", p.table("chapters")))
    before = len(glob.glob(f"{folder}/data/chapters/*/*.parquet"))
    assert ledger.vacuum(spark, folder, keep=1) == 0  # all of it is young
    assert ledger.vacuum(spark, folder, keep=1, older_than_s=-60) > 0
    assert len(glob.glob(f"{folder}/data/chapters/*/*.parquet")) < before and open_library(spark, folder).chapters.count() == 205


def test_data_without_versions_is_no_empty_library(spark, folder):
    for x in glob.glob(f"{folder}/log/*.json"):
        os.remove(x)
    with pytest.raises(ledger.LedgerError):
        open_library(spark, folder)


@pytest.fixture
def older(spark, tmp_path):
    """A library as it was first kept: a snapshot without later columns, and a pointer."""
    where = tmp_path / "old"
    drop = {"novels": ["genre", "export_pending"], "chapters": ["exported_at"]}
    lib = Library.of(spark, novels=[(3, "N", None, None, None, "unknown", "live", True, T0, T0), (8, "M", None, None, None, "unknown", "live", True, T0, T0)], sources=[(11, 3, "a", "u", 1, None, None)], chapters=[chapter(3, 1), chapter(8, 1)])
    for table, df in lib.tables().items():
        df.drop(*drop.get(table, [])).write.parquet(str(where / "snapshot-1" / table))
    (where / "CURRENT").write_text("snapshot-1\n")
    return str(where)


def test_a_rebuild_brings_an_older_library_up(spark, older):
    assert rebuild.rebuild(spark, older) == 1
    lib = open_library(spark, older)
    assert [(r.id, r.genre, r.export_pending) for r in lib.novels.orderBy("id").collect()] == [(3, None, False), (8, None, False)]
    assert {r.key: r.value for r in lib.meta.collect()} == {"novels.next_id": "9", "sources.next_id": "12"}
    assert ledger.version_at(spark, older).schema == SCHEMA and rebuild.rebuild(spark, older) is None
    assert rebuild.rebuild(spark, older + "-none") is None


@pytest.mark.parametrize("harm", ["lost", "twice", "orphan"])
def test_a_rebuild_that_loses_something_is_given_up(spark, older, harm):
    assert rebuild.rebuild(spark, older, target=1) == 1
    was = ledger.version_at(spark, older)
    steps = {
        "lost": lambda t: {"chapters": t["chapters"].filter("novel_id <> 8")},
        "twice": lambda t: {"sources": t["sources"].unionByName(t["sources"])},
        "orphan": lambda t: {"novels": t["novels"].withColumn("id", F.when(F.col("id") == 8, 9).otherwise(F.col("id")))},
    }
    with pytest.raises(ledger.LedgerError, match="given up"):
        rebuild.rebuild(spark, older, {1: steps[harm]})
    assert ledger.version_at(spark, older) == was and open_library(spark, older).chapters.count() == 2
